"""Embedding near-dedup with spherical-cap filters.

Filters are directions of structured random product codes, ``CODES`` of them. In each, after a random rotation a unit vector
is cut into ``BLOCKS`` parts, each part has a book of ``WORDS`` random directions, and a filter is a choice of one word a part.
A vector belongs to every filter whose direction it exceeds a limit with, one that a random vector passes with ``LISTS`` filters
of a code. Words and lists grow with the label of the most vectors (``books``), so a vector meets a shrinking share of them. As a filter's score is the sum of its parts' scores, these are list-decoded from the sorted part scores, without going through all filters.

Vectors of equal labels that meet in a filter are compared by 8-bit sketches with proven error bounds, so that no link is lost,
and a filter gives back a spanning forest of what may be links. Its components are then verified in double precision, in
blocks; a block pair gives back numbers of links and a spanning forest of them. Pairs are never sent anywhere. Equal vectors of
a label are one class with a size, so copies of one vector cost nothing.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing; nor do
vectors of different lengths. Rows without an id take no part in links, and have neither component nor mark. The search is
probabilistic: at the cosine of the threshold two codes find a pair with a probability of about 0.999 (tested), and the more
surely the closer the vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, cut, slices

COSINE = 0.93
CODES, BLOCKS, WORDS, LISTS, SEED = 2, 2, 256, 50, 31
#: Words at most, and the vectors of a label that a word stands for.
MOST_WORDS, PER_WORD = 4096, 64


def books(vectors: int) -> tuple[int, int]:
    """(words, lists) of a code for labels of up to so many vectors. At the cosine of the threshold lists must grow as the root of the
    words for the same recall, while two random vectors share a filter as often as lists**2 / words**2."""
    words = WORDS
    while words < MOST_WORDS and words * PER_WORD < vectors:
        words *= 2
    return words, math.ceil(LISTS * math.sqrt(words / WORDS))
#: Vectors that a block holds, and pairs of sketches that are compared at a time.
BLOCK, PAIRS = 512, 200_000


class ProductCode:
    """The filters of one code for one length of vectors."""

    def __init__(self, length: int, which: int = 0, words: int = WORDS, lists: int = LISTS):
        self.words = words
        r = np.random.default_rng((SEED, length, which))
        self.rotation = np.linalg.qr(r.standard_normal((length, length)))[0]
        self.parts = np.array_split(np.arange(length), min(BLOCKS, length))
        self.books = []
        for p in self.parts:
            book = r.standard_normal((words, len(p)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
        if length < 8:  # too few directions to tell vectors apart by
            self.limit = -np.inf  # all in one filter, which is exact
            return
        trial = r.standard_normal((64, length))
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        # the greatest sums are of words that score high in each part
        total = np.zeros((len(trial), 1))
        for p, book in zip(self.parts, self.books):
            best = -np.sort(-(trial[:, p] @ book.T), axis=1)[:, : 8 * lists]
            total = (total[:, :, None] + best[:, None, :]).reshape(len(trial), -1)
        self.limit = float(np.partition(total.ravel(), -lists * len(trial))[-lists * len(trial)])

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for each filter that a row of unit vectors exceeds the limit with."""
        turned = unit @ self.rotation
        rows, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        scores = [turned[:, p] @ b.T for p, b in zip(self.parts, self.books)]
        best = [s.max(axis=1) for s in scores]
        for k, s in enumerate(scores):
            order = np.argsort(-s, axis=1)
            rest = sum(best[k + 1 :]) if k + 1 < len(scores) else np.zeros(len(unit))
            got = []
            alive = np.arange(len(rows))
            for j in range(self.words if self.limit > -np.inf else 1):  # codes of a part in the order of their scores, as long as any can do
                code = order[rows[alive], j]
                more = total[alive] + s[rows[alive], code]
                ok = more + rest[rows[alive]] >= self.limit
                alive, code, more = alive[ok], code[ok], more[ok]
                if not len(alive):
                    break
                got.append((rows[alive], number[alive] * self.words + code, more))
            if not got:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            rows, number, total = (np.concatenate(x) for x in zip(*got))
            if self.limit == -np.inf:
                number[:] = 0
        return rows, number


@lru_cache(maxsize=64)
def code_for(length: int, which: int, words: int = WORDS, lists: int = LISTS) -> ProductCode:
    return ProductCode(length, which, words, lists)


def filters(classes: DataFrame) -> DataFrame:
    """(label, filter, rep): a row for each filter of each class; a filter's number tells code and length too."""
    words, lists = books(classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            label, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            vectors = b.column(2)
            sizes = pa.compute.list_value_length(vectors).to_numpy()
            for length in np.unique(sizes):
                at = np.flatnonzero(sizes == length)
                x = vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                for which in range(CODES):
                    row, number = code_for(int(length), which, words, lists).decode(x)
                    yield pa.RecordBatch.from_arrays([pa.array(label[at[row]]), pa.array((int(length) * CODES + which) * words**BLOCKS + number), pa.array(rep[at[row]])], names=["label", "filter", "rep"])

    return classes.select("label", "rep", "vector").mapInArrow(run, "label long, filter long, rep long")


def sketches(classes: DataFrame) -> DataFrame:
    """(rep, sketch, scale, error): the unit vector in 8-bit steps of ``scale``, and the norm of what that leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            raw, scale, error = [], [], []
            for v in b.column(1):
                x = np.array(v.as_py(), np.float64)
                x /= np.abs(x).max()
                x /= np.sqrt(x @ x)
                step = float(np.abs(x).max()) / 127
                q = np.rint(x / step).astype(np.int8)
                raw.append(q.tobytes())
                scale.append(step)
                error.append(float(np.linalg.norm(x - q * step)) + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(scale), pa.array(error)], names=["rep", "sketch", "scale", "error"])

    return classes.select("rep", "vector").mapInArrow(run, "rep long, sketch binary, scale double, error double")


def _by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, start): whole groups from batches in their order, and where the group of each row begins."""

    def done(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.logical_or.reduce([np.diff(table.column(k).to_numpy()) != 0 for k in keys])
        return table.combine_chunks(), np.maximum.accumulate(np.where(np.concatenate(([True], new)), np.arange(table.num_rows), 0))

    held: pa.Table | None = None
    for b in slices(batches, rows):
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        same = np.logical_and.reduce([table.column(k).to_numpy() == table.column(k)[-1].as_py() for k in keys])
        at = int(np.argmax(same))
        held = table.slice(at)
        if at:
            yield done(table.slice(0, at))
    if held is not None:
        yield done(held)


def in_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` of groups of two at least, with low, high and side: a row for each block pair that its block is in."""
    crowd = rows.groupBy(*key).agg(F.count("*").alias("crowd")).where("crowd > 1").select(*key, F.ceil(F.col("crowd") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    both = rows.join(crowd, key).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return both.select(*rows.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"))


def possible_links(placed: DataFrame, cosine: float) -> DataFrame:
    """(a, b): for each filter a spanning forest of the pairs that may reach ``cosine``."""
    keys = ("label", "filter", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _by_group(batches, keys, 16384):
            n = len(start)
            low, high, side, rep, scale, error = (table.column(k).to_numpy() for k in ("low", "high", "side", "rep", "scale", "error"))
            raw = table.column("sketch").to_pylist()
            width = np.array([len(x) for x in raw])
            q = np.zeros((n, width.max()), np.float32)  # vectors of one filter have one length
            for w in np.unique(width):
                q[width == w, :w] = np.frombuffer(b"".join(x for x in raw if len(x) == w), np.int8).reshape(-1, w)
            index = np.arange(n)
            before = index - start
            ends = np.cumsum(before)
            root = index.copy()
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                k = before[at:to]
                j = np.repeat(index[at:to], k)
                i = np.repeat(start[at:to], k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
                good = ((low[i] == high[i]) | (side[i] != side[j])) & (root[i] != root[j])
                i, j = i[good], j[good]
                for p in range(0, len(i), 65536):
                    x, y = i[p : p + 65536], j[p : p + 65536]
                    about = np.einsum("ij,ij->i", q[x], q[y]).astype(np.float64) * scale[x] * scale[y]
                    near = about + error[x] + error[y] + error[x] * error[y] + 1e-6 >= cosine
                    x, y = x[near], y[near]
                    while True:  # labels go down along the pairs until they stay
                        u, v = root[x], root[y]
                        if (u == v).all():
                            break
                        less = np.minimum(u, v)
                        np.minimum.at(root, u, less)
                        np.minimum.at(root, v, less)
                        while (root[root] != root).any():
                            root = root[root]
                at = to
            while (root[root] != root).any():
                root = root[root]
            tied = root != index
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[root[tied]]), pa.array(rep[tied])], names=["a", "b"])

    return placed.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a long, b long").distinct()


def verified(placed: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, other): links of a class within a block pair, with no other; and a spanning forest, with no links."""
    keys = ("comp", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _by_group(batches, keys, 8192):
            low, high, side, rep, n = (table.column(k).to_numpy() for k in ("low", "high", "side", "rep", "n"))
            column = table.column("vector").combine_chunks()
            flat, offset = column.values.to_numpy(), column.offsets.to_numpy()
            heads = np.flatnonzero(start == np.arange(len(start)))
            out: list[list[np.ndarray]] = [[rep[:0]], [rep[:0]], [rep[:0]]]
            for a, b in zip(heads, [*heads[1:], len(start)]):
                raw = flat[offset[a] : offset[b]].reshape(b - a, -1)
                counts, edges = _links(raw, side[a:b] if low[a] != high[a] else None, n[a:b], cosine)
                got = np.flatnonzero(counts)
                out[0] += [rep[a + got], rep[a + edges[:, 1]]]
                out[1] += [counts[got], np.zeros(len(edges), np.int64)]
                out[2] += [rep[a + got], rep[a + edges[:, 0]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["rep", "links", "other"])

    return placed.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "rep long, links long, other long")


def _links(raw: np.ndarray, side: np.ndarray | None, n: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of vectors linked with, edges (root, member) of a spanning forest) of the rows of ``raw``."""
    norm = np.sqrt((raw * raw).sum(axis=1))
    score = raw @ raw.T / norm[:, None] / norm
    links = score >= cosine
    for i, j in np.argwhere(np.triu(np.abs(score - cosine) < 1e-12, 1)):  # at the very limit the order of a sum must not decide
        exact = math.fsum(raw[i] * raw[j]) / (math.sqrt(math.fsum(raw[i] * raw[i])) * math.sqrt(math.fsum(raw[j] * raw[j])))
        links[i, j] = links[j, i] = exact >= cosine
    np.fill_diagonal(links, False)
    if side is not None:
        links &= side[:, None] != side
    counts = links @ n
    left, edges = counts > 0, []
    for root in np.flatnonzero(left):
        if left[root]:
            left[root] = False
            edge = np.array([root])
            while len(edge):
                edge = np.flatnonzero(links[edge].any(axis=0) & left)
                left[edge] = False
                edges += [(root, i) for i in edge]
    return counts.astype(np.int64), np.array(edges, np.int64).reshape(-1, 2)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: other vectors linked directly, the smallest id that links reach."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = F.coalesce(good & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    key = F.when(good, F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    slim = rows.select("id", "label", key.alias("key"))
    classes = cut(rows.withColumn("key", key).where("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    spread = cut(filters(classes), "filters")
    placed = in_blocks(spread, ["label", "filter"]).join(sketches(classes), "rep")
    maybe = components(possible_links(placed, cosine))
    close = classes.select("rep", "n", "vector").join(maybe, F.col("rep") == F.col("node")).select("rep", "n", "vector", F.col("component").alias("comp"))
    found = cut(verified(in_blocks(close, ["comp"]), cosine), "links")
    comps = components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.select("label", "key", "rep", "n").join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = slim.where("key is not null").join(by_class, ["label", "key"]).select("id", "n_links", "component_id")
    rest = slim.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return named.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
