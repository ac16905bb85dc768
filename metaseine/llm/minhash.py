"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct 2-word shingles. Equal sets become one class. Each class posts its signature: one entry
per coordinate-value pair. Two classes match if they collide in at least ``THRESHOLD`` of ``COORDINATES`` entries, so they
must meet in the prefix of each, the entries left when the THRESHOLD - 1 most frequent ones are skipped (entries in order
of their frequency over all classes). Only prefix lists are merged; the skipped ones are looked up in the signatures, where
collisions are counted in full. What passes is confirmed on full sets.

Pairs are never sent anywhere. A list names its members that have a match there (each pair counts in the first list that
both are posted to), their full sets come to the list, and all intersections of its members are counted at once as a matrix
product. It gives back a spanning forest of the links that hold, at most a row a member. Long lists are dealt with in blocks.
Classes far apart in size are not compared, for their similarity is bounded by the ratio of their sizes.

Null, empty and blank texts have the empty set and are linked with nothing. A text of one word has that word as its one
shingle. Rows without an id are returned with a null component and are linked with nothing. Repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, components, cut, likely, may_hold, placed, slices

WORDS, SIMILARITY = 2, 0.8
COORDINATES, THRESHOLD, SEED = 48, 25, 2011
#: Classes that a block of a list holds, pairs that are compared at a time, and columns of a matrix product.
BLOCK, PAIRS, COLUMNS = 512, 400_000, 8192
#: Ids up to which those to drop are broadcast; more of them are joined.
BROADCAST_ROWS = 1_000_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes. Words are runs without ASCII white space, A-Z in lower case."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in parts], np.uint64)
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _C1
        out ^= out >> np.uint64(29)
    return np.unique(out * _C2)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 2**64, COORDINATES, np.uint64) | np.uint64(1), r.integers(0, 2**64, COORDINATES, np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions over a set that isn't empty, as 32-bit integers."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[at : at + 2048, None] * a + b).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, key, sig) for every row: the size of its set, a 128-bit name of it and its signature, null where empty."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for batch in slices(batches):
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, words)
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sigs.append(signature(h, a, b).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "key", "sig"])

    return bounded(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, key binary, sig binary")


def _entries(classes: DataFrame) -> DataFrame:
    """(rep, entry): the coordinate-value pairs of each class as one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(COORDINATES, dtype=np.int64) << 32
        for b in slices(batches, 8192):
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), COORDINATES)), pa.array((sig.astype(np.int64) + base).ravel())], names=["rep", "entry"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, entry long")


def postings(classes: DataFrame) -> DataFrame:
    """(list, low, high, side, rep, n, sig): the prefix lists, in blocks; a row for each block pair that its block is in."""
    entries = _entries(classes)
    often = entries.groupBy("entry").agg(F.count("*").alias("c")).where("c > 1")
    shared = entries.join(often, "entry").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "entry"))).alias("e"))
    prefix = COORDINATES - THRESHOLD + 1
    rare = F.greatest(F.lit(0), F.size("e") - (COORDINATES - prefix))  # entries that no other class has come first
    kept = shared.select("rep", F.slice("e", 1, rare).alias("e")).where(F.size("e") > 0)
    mask = F.aggregate("e", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x["entry"], 32).cast("int"))))
    kept = kept.withColumn("mask", mask).join(classes.select("rep", F.col("n_shingles").alias("n"), "sig"), "rep").select("rep", "mask", "n", "sig", F.explode("e").alias("e"))
    kept = kept.select("rep", "mask", "n", "sig", F.col("e.entry").alias("list"), F.ceil(F.col("e.c") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    return kept.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"), "rep", "mask", "n", "sig")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (list, low, high) from batches in their order."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        same = np.logical_and.reduce([table.column(k).to_numpy() == table.column(k)[-1].as_py() for k in ("list", "low", "high")])
        at = int(np.argmax(same))  # the last group may go on in the next batch
        held = table.slice(at)
        if at:
            yield table.slice(0, at).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _starts(table: pa.Table) -> np.ndarray:
    """Where the group of each row begins."""
    new = np.logical_or.reduce([np.diff(table.column(k).to_numpy()) != 0 for k in ("list", "low", "high")])
    return np.maximum.accumulate(np.where(np.concatenate(([True], new)), np.arange(table.num_rows), 0))


def _matched(rows: dict[str, np.ndarray], start: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each row has a match in its group that no earlier list of both rows has."""
    n = len(start)
    index = np.arange(n)
    before = index - start
    ends = np.cumsum(before)
    found = np.zeros(n, bool)
    bit = np.arange(COORDINATES)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = before[at:to]
        j = np.repeat(index[at:to], k)
        i = np.repeat(start[at:to], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
        good = (rows["low"][i] == rows["high"][i]) | (rows["side"][i] != rows["side"][j])
        good &= np.minimum(rows["n"][i], rows["n"][j]) >= similarity * np.maximum(rows["n"][i], rows["n"][j]) - 1e-9
        i, j = i[good], j[good]
        for p in range(0, len(i), 65536):
            x, y = i[p : p + 65536], j[p : p + 65536]
            same = rows["sig"][x] == rows["sig"][y]
            enough = same.sum(axis=1) >= THRESHOLD
            x, y, same = x[enough], y[enough], same[enough]
            posted = (((rows["mask"][x] & rows["mask"][y])[:, None] >> bit) & 1).astype(bool) & same
            first = posted.argmax(axis=1) == rows["list"][x] >> 32
            found[x[first]] = found[y[first]] = True
        at = to
    return found


def matched_members(posted: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(list, low, high, side, rep): the members of lists that collide often enough with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            rows = {k: table.column(k).to_numpy() for k in ("list", "low", "high", "side", "n", "mask")}
            rows["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.int32).reshape(-1, COORDINATES)
            yield from table.select(["list", "low", "high", "side", "rep"]).filter(pa.array(_matched(rows, _starts(table), similarity))).to_batches()

    ordered = posted.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "rep")
    return ordered.mapInArrow(run, "list long, low int, high int, side boolean, rep long")


def _forest(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Edges (root, member) of a spanning forest of the links among ``sets``; with ``side``, of those between its two sides."""
    size = np.array([len(x) for x in sets])
    every, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, member = np.unique(column[shared], return_inverse=True)[1], member[shared]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        part[member[a:b], column[a:b] - at] = 1
        common += part @ part.T
    links = 100 * common >= percent * (size[:, None] + size - common)
    if side is not None:
        links &= side[:, None] != side
    left = np.ones(len(sets), bool)
    edges = []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        edge = np.array([root])
        while len(edge):
            edge = np.flatnonzero(links[edge].any(axis=0) & left)
            left[edge] = False
            edges += [(root, int(x)) for x in edge]
    return edges


def confirmed_links(members: DataFrame, documents: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b): for each list a spanning forest of the pairs whose full sets are similar enough.

    Texts are picked and hashed in one pass: a second one in the same tasks would need workers of its own, which live on through later stages.
    """
    held = documents.sparkSession.sparkContext.broadcast(likely(members.select("rep").distinct(), "rep"))
    texts = documents.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("rep is not null")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(may_hold(held.value, b) for b in batches):
            sets = [shingle_hashes(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(piece for b in batches for piece in slices(iter([b]), 4096)):
            start = _starts(table)
            heads = np.flatnonzero(start == np.arange(len(start)))
            reps, column = table.column("rep").to_numpy(), table.column("set").combine_chunks()
            offset, flat = column.offsets.to_numpy(), column.values.to_numpy()
            low, high, sides = (table.column(k).to_numpy() for k in ("low", "high", "side"))
            out: list[tuple[int, int]] = []
            for a, b in zip(heads, [*heads[1:], len(start)]):
                if b - a > 1:
                    sets = [flat[offset[i] : offset[i + 1]] for i in range(a, b)]
                    out += [(reps[a + x], reps[a + y]) for x, y in _forest(sets, None if low[a] == high[a] else sides[a:b], round(100 * similarity))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    sets = placed(bounded(texts), "rep").mapInArrow(hashed, "rep long, set array<long>")
    listed = members.join(sets, "rep").select("list", "low", "high", "side", "rep", "set").repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "rep")
    return listed.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, keep_key: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept[, key]) for every row of ``documents``.

    ``component_id`` is the smallest id that links reach, ``kept`` whether that is the row's own; ``key`` names the row's set.
    """
    slim = cut(signatures(documents, id_col, text_col, words), "signatures")
    usable = slim.where("key is not null and id is not null")
    classes = cut(usable.groupBy("key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    posted = cut(postings(classes), "postings")
    members = cut(matched_members(posted, similarity), "members")
    comps = components(confirmed_links(members, documents, id_col, text_col, words, similarity))
    named = usable.select("id", "n_shingles", "key").join(classes.select("key", "rep"), "key").join(comps, F.col("rep") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "key")
    rest = slim.where("key is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"), "key")
    return named.unionByName(rest).select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), *["key"] * keep_key)


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` without those whose group has a document of a smaller id; all columns stay.

    Rows without an id stay, and so do rows without words. Rows that share an id are judged by their own texts: of those with one set one stays
    if the set's group has no smaller id.
    """
    found = near_duplicates(documents, id_col, text_col, words, similarity, keep_key=True).where(F.col(id_col).isNotNull())
    found = cut(found.select(F.col(id_col).alias("__id"), "kept", "key"), "kept")
    ids = cut(found.groupBy("__id").agg(F.min(F.col("kept").cast("int")).alias("__kept"), F.count("*").alias("__n")).where("__kept = 0 or __n > 1"), "dropped")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rest = documents.join(small.select("__id"), F.col(id_col) == F.col("__id"), "left_anti")
    again = ids.where("__n > 1").select("__id")
    if again.isEmpty():
        return rest
    rows = documents.join(again, F.col(id_col) == F.col("__id"))
    keyed = _keyed(rows, text_col, words)
    good = found.where("kept and key is not null").join(again, "__id").select("__id", F.col("key").alias("__key")).distinct()
    same = keyed.where("__key is not null").join(good, ["__id", "__key"], "left_semi")
    # pre-aggregated, for one id may have very many rows
    one = same.groupBy("__id", "__key").agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*documents.columns)).alias("__r")).select("__r.*")
    return rest.unionByName(one).unionByName(keyed.where("__key is null").select(*documents.columns))


def _keyed(rows: DataFrame, text_col: str, words: int) -> DataFrame:
    """``rows`` with __key: the name of each text's set, as in ``signatures``."""
    from .langid import _schema

    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = (shingle_hashes(t, words) for t in b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary())], names=[*b.schema.names, "__key"])

    return rows.mapInArrow(run, _schema(rows, "__key binary"))
