"""Small directed graphs as sets of (source, target) pairs, for one record at a time; operators/graph.py does the same on tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable

Pair = tuple[Hashable, Hashable]


def closure(pairs: Iterable[Pair], seeds: Iterable[Hashable]) -> set:
    """The seeds, and all that can be reached from them along the pairs."""
    step = defaultdict(list)
    for a, b in pairs:
        step[a].append(b)
    seen = set(seeds)
    queue = list(seen)
    for x in queue:  # the list grows while it is read
        fresh = [y for y in step[x] if y not in seen]
        seen.update(fresh)
        queue += fresh
    return seen


def contracted(pairs: Iterable[Pair], via: set) -> set[Pair]:
    """The pairs (a, b) of different nodes outside ``via`` that an edge joins, or a path all of whose inner nodes are in ``via``."""
    pairs = set(pairs)
    if not via:
        return {(a, b) for a, b in pairs if a != b}
    within = [(a, b) for a, b in pairs if a in via]
    ends: dict = {}
    out = set()
    for a, b in pairs:
        if a in via:
            continue
        if b in via and b not in ends:
            ends[b] = closure(within, [b]) - via
        out |= {(a, c) for c in (ends[b] if b in via else (b,)) if a != c}
    return out


def touched(pairs: Iterable[Pair]) -> set:
    return {x for p in pairs for x in p}


def feeding(pairs: Iterable[Pair], outputs: Iterable[Hashable]) -> set:
    """The outputs that something feeds, and all that feeds them."""
    pairs = set(pairs)
    fed = {b for _, b in pairs} & set(outputs)
    return closure(((b, a) for a, b in pairs), fed)
