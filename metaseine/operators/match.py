"""Search over units: a table (entity, unit_ord, label, text) where an entity has units in an order.

Terms compile to Column expressions; quantifiers are aggregates over an entity's units. Partial aggregation runs before the one
shuffle, by entity, and no text but a snippet travels through it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much of a text a snippet shows before and after a match.
BEFORE, AFTER = 140 // 3, 140 // 2


class SearchError(ValueError):
    """A search that cannot be run as asked."""


@dataclass(frozen=True)
class SearchSpec:
    """What to look for.

    ``mode`` is all or any, ``scope`` is image (terms anywhere in an entity), field or node (all in one unit).
    ``fields``, ``node_types`` and ``inputs`` narrow the units; ``connected`` is None, linked or output.
    """

    terms: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    regex: bool = False
    case_sensitive: bool = False
    mode: str = "all"
    scope: str = "image"
    fields: tuple[str, ...] = ()
    connected: str | None = None
    node_types: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    saved_kinds: tuple[str, ...] | None = None
    broken: bool = False
    deep: bool = False
    snippets: bool = True

    def __post_init__(self):
        if self.mode not in ("all", "any"):
            raise SearchError(f"mode {self.mode!r} is neither all nor any")
        if self.scope not in ("image", "field", "node"):
            raise SearchError(f"scope {self.scope!r} is none of image, field, node")
        if self.connected not in (None, "linked", "output"):
            raise SearchError(f"connected {self.connected!r} is neither linked nor output")
        if self.broken and (self.terms or self.excluded):
            raise SearchError("a search for broken files takes no terms")
        if not self.broken and not self.terms:
            raise SearchError("nothing to search for")
        if self.saved_kinds is not None and (self.node_types or self.inputs):
            raise SearchError("stored prompts have no nodes to filter")
        for t in (*self.terms, *self.excluded) if self.regex else ():
            check_pattern(t)


def renamed_groups(term: str) -> str:
    """A regular expression with its named groups as the engine wants them: (?<g1>…), whose names have no underscore."""
    names = {n: f"g{k}" for k, n in enumerate(dict.fromkeys(re.findall(r"\(\?P<(\w+)>", term)))}
    term = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{names[m[1]]}>", term)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{names.get(m[1], m[1])}>", term)


def term_pattern(term: str, regex: bool = False, case_sensitive: bool = False) -> str:
    """The engine's regular expression for a term: dot matches newlines, case by Unicode, classes by Unicode in a regex."""
    term = unicodedata.normalize("NFC", term)
    body = renamed_groups(term) if regex else "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in term)
    return ("(?s" if case_sensitive else "(?ius") + ("U)" if regex else ")") + body


def check_pattern(term: str) -> None:
    """Raise SearchError for a regular expression that cannot run: the engine itself compiles it where there is a session."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    try:
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(term_pattern(term, regex=True))
        else:
            re.compile(term)
    except Exception as x:  # the engine's error comes wrapped
        raise SearchError(f"bad regular expression {term!r}: {str(x).splitlines()[0]}") from None


def matches(text: Column, term: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    return text.rlike(term_pattern(term, regex, case_sensitive))


def snippet(text: Column, pattern: str) -> Column:
    """The text around the first match of ``pattern``, marked where it is cut, on one line."""
    found = F.regexp_extract(text, pattern, 0)
    # offsets count code points; the match is the first occurrence of what was found at the first match of the pattern
    head = F.element_at(F.split(text, pattern, 2), 1)
    start = F.char_length(head)
    end = start + F.char_length(found)
    low = F.greatest(start - BEFORE, F.lit(0))
    high = F.least(end + AFTER, F.char_length(text))
    part = F.substring(text, low + 1, high - low)
    part = F.regexp_replace(F.regexp_replace(part, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", " "), "\n", " ")
    return F.concat(F.when(low > 0, "…").otherwise(""), part, F.when(high < F.char_length(text), "…").otherwise(""))


def hit_columns(text: Column, spec: SearchSpec) -> list[Column]:
    return [matches(text, t, spec.regex, spec.case_sensitive) for t in spec.terms]


def search(units: DataFrame, spec: SearchSpec, entity: str = "entity") -> DataFrame:
    """(entity, hits array<struct<term, label, snippet>>) for each entity that matches ``spec``.

    Scope image gives a hit for each term, from the first unit that has it; with mode any these are the terms of the first unit
    that has one. Scopes field and node give a hit for each unit in which all (any) terms are, that of its first matching term.
    An entity with an excluded term in any unit is left out.
    """
    text = F.col("text")
    rows = units.where(F.coalesce(text, F.lit("")) != "")
    if spec.fields:
        rows = rows.where(F.lower("label").isin([f.lower() for f in spec.fields]))
    flags = hit_columns(text, spec)
    bad = F.lit(False)
    for t in spec.excluded:
        bad = bad | matches(text, t, spec.regex, spec.case_sensitive)
    patterns = [term_pattern(t, spec.regex, spec.case_sensitive) for t in spec.terms]

    def hit(k: int) -> Column:
        shown = snippet(text, patterns[k]) if spec.snippets else F.lit(None).cast("string")
        return F.struct(F.lit(k).alias("term"), F.col("label").alias("label"), shown.alias("snippet"))

    kept = rows.select(entity, "unit_ord", "label", "text", *(f.alias(f"__t{k}") for k, f in enumerate(flags)), bad.alias("__bad"))
    some = F.col("__bad")
    for k in range(len(flags)):
        some = some | F.col(f"__t{k}")
    kept = kept.where(some)  # units that say nothing never reach the shuffle
    excluded = F.bool_or("__bad").alias("__out")
    if spec.scope == "image":
        small = kept.select(entity, "unit_ord", "__bad", *(F.when(F.col(f"__t{k}"), hit(k)).alias(f"__t{k}") for k in range(len(flags))))
        first = [F.min(F.when(F.col(f"__t{k}").isNotNull(), F.struct(F.col("unit_ord"), F.col(f"__t{k}").alias("h")))).alias(f"__t{k}") for k in range(len(flags))]
        found = small.groupBy(entity).agg(*first, excluded).where(~F.col("__out"))
        cols = [F.col(f"__t{k}") for k in range(len(flags))]
        if spec.mode == "all":
            for c in cols:
                found = found.where(c.isNotNull())
            return found.select(entity, F.array(*(c["h"] for c in cols)).alias("hits"))
        least = cols[0]["unit_ord"] if len(cols) == 1 else F.least(*(c["unit_ord"] for c in cols))
        hits = F.transform(F.filter(F.array(*cols), lambda h: h.isNotNull() & (h["unit_ord"] == least)), lambda h: h["h"])
        return found.where(least.isNotNull()).select(entity, hits.alias("hits"))
    whole = F.col("__t0")
    for k in range(1, len(flags)):
        whole = whole & F.col(f"__t{k}") if spec.mode == "all" else whole | F.col(f"__t{k}")
    lead = F.coalesce(*(F.when(F.col(f"__t{k}"), hit(k)) for k in range(len(flags))))
    small = kept.select(entity, "unit_ord", "__bad", F.when(whole, lead).alias("h"))
    listed = F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("unit_ord", "h")))).alias("hits")
    found = small.groupBy(entity).agg(listed, excluded).where(~F.col("__out") & (F.size("hits") > 0))
    return found.select(entity, F.transform("hits", lambda x: x["h"]).alias("hits"))


def unpivot(table: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """(entity, unit_ord, label, text): the named columns of a table as units, in their order."""
    parts = F.array(*(F.struct(F.lit(k).alias("unit_ord"), F.lit(c).alias("label"), F.col(c).cast("string").alias("text")) for k, c in enumerate(columns)))
    return table.select(F.col(entity).alias("entity"), F.explode(parts).alias("u")).select("entity", "u.unit_ord", "u.label", "u.text")


def unpivot_json(table: DataFrame, entity: str, column: str) -> DataFrame:
    """(entity, unit_ord, label, text): the members of a JSON object as units, in their order."""
    members = F.posexplode(F.from_json(column, "map<string,string>")).alias("unit_ord", "label", "text")
    return table.select(F.col(entity).alias("entity"), members)


def distinct_targets(rows: DataFrame, target: str, *order: Column | str) -> DataFrame:
    """One row for each ``target``: the first by ``order`` (a minimum of structs, pre-aggregated before the shuffle)."""
    rest = [c for c in rows.columns if c != target]
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    if len(rest) == len(keys) == 1:  # plain values aggregate by hash, structs by sort
        return rows.groupBy(target).agg(F.min_by(rest[0], keys[0]).alias(rest[0])).select(*rows.columns)
    picked = rows.groupBy(target).agg(F.min_by(F.struct(*rest), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))).alias("__r"))
    return picked.select(*(F.col(target) if c == target else F.col(f"__r.{c}").alias(c) for c in rows.columns))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each ``key``: the last by ``order``."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*(F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns))


def histogram(rows: DataFrame, kind: Column, name: str = "kind") -> DataFrame:
    return rows.groupBy(kind.alias(name)).agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, name: str = "kind") -> DataFrame:
    return counts.orderBy(F.desc("n"), name).limit(k)


def completed(rows: DataFrame, keys: Sequence[str], error: Column) -> DataFrame:
    """The groups without an error, with the number of their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(error).alias("__e")).where(~F.coalesce("__e", F.lit(False))).drop("__e")
