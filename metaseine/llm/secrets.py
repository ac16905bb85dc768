"""Secret scans: patterns of known secrets, and a token-efficiency test for random strings.

A vocabulary packs ordinary words into few tokens and random strings into many. Each candidate, a run of letters, digits
and ``+/_=-`` that has letters, is encoded with a tiktoken vocabulary; with fewer than ``MAX_RATIO``
characters a token it is held to be random. Runs without digits must be longer, and those of one case have a lower limit, for
some compound words come near it. Known digests (hex of a digest's length, SRI digests) and identifiers (UUIDs,
runs that are hyphenated or underscored words with numbers, dates) are left out first.

Null and empty texts have no spans. Spans count in code points, the end exclusive. The spans of the patterns stay as they
are; the test adds spans of kind ``random`` for what the patterns leave of a run: a long stretch is tested by itself, and one that goes
on from a hex or access span without a separator is random where the whole run is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, slices

#: The patterns of the base kinds, in their order; the limit is for the group named or the whole match.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A candidate of the test: its least length with and without digits, and the characters a token below which it is random.
MIN_RUN, MIN_LETTERS, MAX_RATIO = 12, 16, 2.0
#: The part of the limit for runs without digits that are lower case, upper case or capitalised.
ONE_CASE = 0.9
#: Lengths of hex digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}

_assign, _access, _hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(f"[0-9a-f]{{{MIN_HEX},}}")
_keyword = re.compile(r"(?ai:passw|secret|token|api_?key)")
_run = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_uuid = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
_words = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))+[-_/+=]*")
_date = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2,6}Z?")
_one_case = re.compile(r"[A-Z]?[^A-Z]*|[^a-z]*")
_sri = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a rank file: base64 of the token and its rank on each line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Whether a run is a digest or an identifier rather than a secret."""
    bare = run.strip("+/_=-")
    if len(bare) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare):
        return True
    return bool(bare.isdigit() or _uuid.fullmatch(bare) or _words.fullmatch(bare) or _date.fullmatch(bare) or _sri.fullmatch(run))


def is_random(run: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    return len(run) < max_ratio * len(encoding.encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches in ``text``, kinds in order; those of one kind do not overlap."""
    found = []
    if _keyword.search(text):
        found += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return found


def is_candidate(run: str, encoding, max_ratio: float) -> bool:
    """Whether a run or a stretch of one is random: with letters, long enough, not known, and below its limit."""
    if len(run) < MIN_RUN or not re.search("[A-Za-z]", run) or is_known(run):
        return False
    if not re.search("[0-9]", run):
        if len(run) < MIN_LETTERS:
            return False
        max_ratio *= ONE_CASE if _one_case.fullmatch(run) else 1
    return is_random(run, encoding, max_ratio)


def random_spans(text: str, base: list[tuple[int, int, str]], encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    found = []
    base = sorted(base)
    for m in _run.finditer(text):
        start, end = m.span()
        inside = [s for s in base if s[0] < end and start < s[1]]
        if not inside:
            if is_candidate(m[0], encoding, max_ratio):
                found.append((start, end, "random"))
            continue
        if is_known(m[0]):
            continue
        whole = None
        joints = {x for a, b, k in inside if k in ("hex", "access") for x in (a, b)}
        at = start
        for a, b in [*((a, b) for a, b, _ in inside), (end, end)]:
            if a > at:
                near = (at in joints and text[at].isalnum()) or (a in joints and text[a - 1].isalnum())
                if near and whole is None:
                    whole = is_candidate(m[0], encoding, max_ratio)
                if (near and whole) or is_candidate(text[at:a], encoding, max_ratio):
                    found.append((at, a, "random"))
            at = max(at, b)
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch that spans cover replaced once."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO, redacted: bool = True) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_random, redacted) for every row of ``documents``.

    ``redacted`` is the text without what the spans cover, null for null; it is left out where it isn't asked for. Null and repeated ids stay.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", *["redacted"] * redacted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", base, encoding, max_ratio)
                count = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more), *[redact(text, base + more) if base or more else text] * redacted))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * redacted
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long" + ", redacted string" * redacted
    return bounded(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_column(documents: DataFrame, path: str, text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``documents``, all columns and rows, with the secrets of ``text_col`` replaced."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for b in slices(batches):
            clean = []
            for text in b.column(at).to_pylist():
                base = base_spans(text or "")
                spans = base + random_spans(text or "", base, encoding, max_ratio)
                clean.append(redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return bounded(documents).mapInArrow(run, documents.schema)
