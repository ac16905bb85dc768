"""Exact top-k search by integer inner product with M-trees.

Rows are dealt to the nearest of a few pivots (from a bounded sample by a hash of the id); a pivot, its covering radius and its
rows are a page of the top level. A page of more than ``UNIT`` rows is split by a hash. Each unit is bulk-loaded as an M-tree:
nodes have a centre, a covering radius and the distance to the parent's centre, and leaf entries the distance to theirs.

Search is best first: a query opens the nodes of the greatest bounds among all that it has reached, in rounds of 1, 2, 4, ... nodes, and ends when none
reaches the k-th best score found so far. With d the Euclidean distance, <q, x> <= <q, c> + |q| d(c, x), so a node is bounded by its centre, radius and
stored distances alone, and children and entries whose stored distance shows that they cannot reach the k-th best score are passed over without computing
anything. Queries that open a node in the same round share one matrix product, and only scores that reach a query's k-th best are looked at one by one.
Where no bound excludes anything, as with random vectors of many components, this is one product of all queries with all rows, so time grows with
rows times queries. Bounds are compared with a margin for rounding, scores are exact
integers. A query first visits a unit of its nearest pivot, and then, with the k-th score found there, only units of pages whose bound
reaches it. Units lie in groups; a group's trees are built once and its queries stream past them, a row a query.

Components become floor(256 x), exact for all floats; those of doubles are bounded by 2**400. Scores beyond 64 bits are ``MOST`` or -``MOST``, and rank
as such. Rows with a null id, null vectors and those that hold null or non-finite components take no part; vectors of different lengths are not
compared. Ties go to the smaller id. Rows that share an id are different rows: each is a candidate of the other, and as a query has ranks of
its own. Vectors without components score 0 with each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, slices

SCALE, K, EVERY = 256, 5, 50
#: The greatest score, and the greatest component.
MOST, LARGEST = 2**63 - 1024, 2.0**400
#: The bound of the sample that pivots come from, pivots at most, rows a pivot stands for, rows of a unit, units of a group at most.
SAMPLE, PIVOTS, PER_PIVOT, UNIT, GROUP = 4096, 256, 4096, 4096, 16
LEAF, FANOUT = 256, 16


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, integers as doubles: as floats where these hold them, else within 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(a).max(initial=1) * np.abs(b).max(initial=1) * max(1, a.shape[1])
        if most < 2**53:  # the type holds every component and every partial sum
            narrow = np.float32 if most < 2**24 else np.float64
            return a.astype(narrow, copy=False) @ b.astype(narrow, copy=False).T
        about = a @ b.T
        high = np.abs(a).max(axis=1, initial=0)[:, None] * np.abs(b).max(axis=1, initial=0) * max(1, a.shape[1]) >= 2**53
    out = np.where(high, 0, about).astype(np.int64)
    rows, columns = np.flatnonzero(high.any(axis=1)), np.flatnonzero(high.any(axis=0))
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a[rows]) @ whole(b[columns]).T
    out[np.ix_(rows, columns)] = np.clip(exact, -MOST, MOST).astype(np.int64)
    return out


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` from ``c``."""
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Node:
    __slots__ = ("centre", "norm", "radius", "parent", "children", "centres", "rows", "ids", "numbers", "away")

    def __init__(self, centre: np.ndarray, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, parent: float):
        self.centre, self.parent, self.children = centre, parent, []
        self.norm = float(np.sqrt(centre @ centre))
        away = apart(rows, centre)
        self.radius = float(away.max(initial=0))
        if len(rows) <= LEAF:
            self.rows, self.ids, self.numbers, self.away = rows, ids, numbers, away
            return
        # as few parts as make leaves at least half full on average
        picks = rows[np.linspace(0, len(rows) - 1, min(FANOUT, -(-2 * len(rows) // LEAF))).astype(int)]
        nearest = np.stack([((rows - p) ** 2).sum(axis=1) for p in picks], axis=1).argmin(axis=1)
        parts = [np.flatnonzero(nearest == k) for k in range(len(picks))]
        if max(map(len, parts)) > 0.9 * len(rows):  # nearly all in one place: halves make progress
            parts = np.array_split(np.argsort(away, kind="stable"), 2)
            picks = [rows[p[len(p) // 2]] for p in parts]
        for p, c in zip(parts, picks):
            if len(p):
                self.children.append(Node(c, rows[p], ids[p], numbers[p], float(np.sqrt(((c - centre) ** 2).sum()))))
        self.centres = np.stack([c.centre for c in self.children])

    def all(self) -> list[Node]:
        return [self, *(x for c in self.children for x in c.all())]


def above(product: np.ndarray, span: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An upper bound of product + span with room for rounding; ``size`` bounds the terms of the product."""
    return product + span + 1e-9 * (size + span) + 1e-6


LEAST = np.iinfo(np.int64).min


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, m: int, k: int, floor: np.ndarray):
        self.scores, self.ids, self.floor = np.full((m, k), LEAST), np.zeros((m, k), np.int64), floor.copy()

    def take(self, q: np.ndarray, got: np.ndarray, ids: np.ndarray) -> None:
        """Put single entries, each a score and an id, to the queries ``q``."""
        k = self.scores.shape[1]
        last, name = self.scores[q, -1], self.ids[q, -1]
        new = (got > last) | ((got == last) & (ids < name))
        q, got, ids = q[new], got[new], ids[new]
        if not len(q):
            return
        to = np.unique(q)
        who = np.concatenate((np.repeat(to, k), q))
        both, names = np.concatenate((self.scores[to].ravel(), got)), np.concatenate((self.ids[to].ravel(), ids))
        order = np.lexsort((names, ~both, who))
        first = np.searchsorted(who[order], to)
        best = order[first[:, None] + np.arange(k)]  # a query has its k places at least
        self.scores[to], self.ids[to] = both[best], names[best]
        last = self.scores[to, -1]
        self.floor[to] = np.where(last > LEAST, np.maximum(self.floor[to], last.astype(np.float64)), self.floor[to])


def search(root: Node, queries: np.ndarray, own: np.ndarray, best: Best, who: np.ndarray) -> None:
    """Improve ``best`` at the places ``who`` by a tree's entries but each query's own row (by its number).

    In a round a query opens the nodes of the greatest bounds among all that it has reached, one at first and then twice as many
    each time, so that queries meet at the nodes and share matrix products; a node that better scores rule out meanwhile stays shut.
    """
    nodes = root.all()
    place = {id(n): i for i, n in enumerate(nodes)}
    norm, k = norms(queries), best.scores.shape[1]
    front = np.full((len(queries), len(nodes)), -np.inf)  # bounds of the nodes reached and not yet opened
    width = 1
    with np.errstate(over="ignore"):
        at = np.zeros((len(queries), len(nodes)))  # products with the centres
        at[:, 0] = queries @ root.centre
        front[:, 0] = above(at[:, 0], norm * root.radius, norm * root.norm)
        while True:
            chosen = (front >= best.floor[who][:, None]) & (front > -np.inf)
            if not chosen.any():
                return
            if width < len(nodes):
                chosen &= front >= np.partition(front, len(nodes) - width, axis=1)[:, -width, None]
            top = np.where(chosen, front, -np.inf).max(axis=0)
            for n in np.argsort(-top)[: (top > -np.inf).sum()]:
                q = np.flatnonzero(chosen[:, n])
                q, bound = q[front[q, n] >= best.floor[who[q]]], front[q, n]
                front[chosen[:, n], n] = -np.inf
                if not len(q):
                    continue
                node, floor = nodes[n], best.floor[who[q]]
                if node.children:
                    parent, radius, size = (np.array([getattr(c, x) for c in node.children]) for x in ("parent", "radius", "norm"))
                    # by the stored distance alone
                    near = above(at[q, n][:, None], norm[q][:, None] * (parent + radius), (norm[q] * node.norm)[:, None]) >= floor[:, None]
                    some, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    if len(some):
                        q, near, to = q[some], near[np.ix_(some, c)], np.array([place[id(node.children[i])] for i in c])
                        product = queries[q] @ node.centres[c].T
                        at[np.ix_(q, to)] = product
                        front[np.ix_(q, to)] = np.where(near, above(product, norm[q][:, None] * radius[c], norm[q][:, None] * size[c]), -np.inf)
                    continue
                # entries that no query needs are not computed: those less far from the centre than the least that any query asks
                lack, reach = floor - above(at[q, n], 0.0, norm[q] * node.norm), norm[q] * (1 + 1e-9)
                least = np.divide(lack, reach, out=np.where(lack > 0, np.inf, -np.inf), where=reach > 0).min()
                near = np.flatnonzero(node.away >= least)
                if len(near):
                    got = dots(queries[q], node.rows[near])
                    if got.shape[1] > 4 * k:  # no more than these and their ties, for each query and its own row
                        weak = np.flatnonzero(best.scores[who[q], -1] == LEAST)
                        floor[weak] = np.maximum(floor[weak], np.partition(got[weak], -k - 1, axis=1)[:, -k - 1].astype(np.float64))
                    # a floor that a narrow type rounds is beyond all scores of that type
                    i, j = np.nonzero(got >= (floor.astype(got.dtype) if got.dtype.kind == "f" else floor)[:, None])
                    other = node.numbers[near[j]] != own[q[i]]
                    i, j = i[other], j[other]
                    best.take(who[q[i]], got[i, j].astype(np.int64), node.ids[near[j]])
            width *= 2


class Pages:
    """Pivots by length of vector, with the covering radius and the number of units of each page."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radius: dict[tuple[int, int], float] = {}
        self.units: dict[tuple[int, int], int] = {}

    def centre(self, length: int) -> np.ndarray:
        """The pivots of a length; the origin where the sample had none."""
        return self.pivots.get(length, np.zeros((1, length)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of each row."""
        c = self.centre(x.shape[1])
        at = ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        return at, norms(x - c[at])


def _matrix(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length of the lists of an Arrow column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, offset = column.values.to_numpy(), column.offsets.to_numpy()
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield at, flat[(offset[:-1][at][:, None] + np.arange(length))].reshape(len(at), length)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(row, id, v): the rows that take part, numbered, with whole components as doubles."""
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def whole(x):
        y = x.cast("double") * scale  # from 2**53 on every double is whole
        return F.greatest(F.least(F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y), F.lit(LARGEST)), F.lit(-LARGEST))

    return vectors.where(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v"))


def _visit(rows: DataFrame, k: int) -> DataFrame:
    """Search groups of units: rows (group, kind, unit, row, id, v, floor, units) hold a group's index rows (kind 0) before its queries (kind 1),
    which name the units they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, trees = None, {}, {}
        for b in slices(batches, 2048):
            groups, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            names, number, ident, floor = b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(6).to_numpy()
            flat, offset = b.column(5).values.to_numpy(), b.column(5).offsets.to_numpy()
            at = 0
            while at < len(names):  # a run of rows of one group, kind and unit
                to = at
                while to < len(names) and groups[to] == groups[at] and kind[to] == kind[at] and (kind[at] == 1 or names[to] == names[at]):
                    to += 1
                if groups[at] != group:
                    group, parts, trees = groups[at], {}, {}
                if kind[at] == 0:
                    length = (offset[to] - offset[at]) // (to - at)
                    parts.setdefault(names[at], []).append((flat[offset[at] : offset[to]].reshape(to - at, length).copy(), ident[at:to].copy(), number[at:to].copy()))
                else:
                    for name, held in parts.items():
                        x, ids, numbers = (np.concatenate(c) for c in zip(*held))
                        trees[name] = Node(x[len(x) // 2], x, ids, numbers, 0.0)
                    parts = {}
                    found = Best(to - at, k, floor[at:to])
                    asked: dict[str, list[int]] = {}
                    for i, units in enumerate(b.column(7).slice(at, to - at).to_pylist()):
                        for name in units:
                            asked.setdefault(name, []).append(i)
                    for name, who in asked.items():
                        if name in trees:
                            q = np.stack([flat[offset[at + i] : offset[at + i + 1]] for i in who])
                            search(trees[name], q, number[at:to][who], found, np.array(who))
                    i, column = np.nonzero(found.scores > LEAST)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(number[at:to][i]), pa.array(ident[at:to][i]), pa.array(found.ids[i, column]), pa.array(found.scores[i, column])], names=["row", "query_id", "vec_id", "score"])
                at = to

    return rows.repartition("group").sortWithinPartitions("group", "kind", "unit", "row").mapInArrow(run, "row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = cut(integers(vectors, id_col, vec_col, scale), "integers")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, max(1, min(PIVOTS, n // PER_PIVOT + 1)))).collect()
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    pages = Pages({length: np.array(p, np.float64).reshape(len(p), length) for length, p in pivots.items()})
    held = spark.sparkContext.broadcast(pages)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            length, page, away = (np.zeros(b.num_rows, t) for t in (np.int32, np.int32, np.float64))
            for at, x in _matrix(b.column(2)):
                length[at] = x.shape[1]
                page[at], away[at] = held.value.nearest(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), pa.array(page), pa.array(away)], names=["row", "id", "v", "length", "page", "away"])

    placed = cut(rows.mapInArrow(place, "row long, id long, v array<double>, length int, page int, away double"), "placed")
    for r in placed.groupBy("length", "page").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():
        pages.radius[r["length"], r["page"]] = r["r"] * (1 + 1e-9)
        pages.units[r["length"], r["page"]] = -(-r["n"] // UNIT)
    full = spark.sparkContext.broadcast(pages)
    # units of a group: one where there are few, so that all cores have work
    groups = max(1, max(sum(pages.units.values()) // GROUP, min(sum(pages.units.values()), 4 * spark.sparkContext.defaultParallelism)))
    sizes = placed.groupBy("length", "page").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"))
    name = F.concat_ws("/", "length", "page", "part")
    group_of = lambda unit: (F.crc32(F.col(unit).cast("binary")) % groups).alias("group")
    none = F.lit(None).cast("array<string>").alias("units")
    index = placed.join(sizes, ["length", "page"]).withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), "units").cast("int")).select(name.alias("unit"), "row", "id", "v")
    entries = index.select(group_of("unit"), F.lit(0).alias("kind"), "unit", "row", "id", "v", F.lit(0.0).alias("floor"), none)
    queries = placed.where(F.col("id") % every == 0)
    home = queries.withColumn("part", F.lit(0)).withColumn("home", name)
    asked = home.select(group_of("home"), F.lit(1).alias("kind"), F.lit("").alias("unit"), "row", "id", "v", F.lit(float("-inf")).alias("floor"), F.array("home").alias("units"))
    first = cut(_visit(entries.union(asked), k), "first")
    floors = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("floor"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = full.value
        for b in slices(batches, 1024):
            floor, own = b.column(4).to_numpy(), b.column(3).to_numpy()
            where: list[dict[int, list[str]]] = [{} for _ in range(b.num_rows)]
            for at, q in _matrix(b.column(2)):
                length, norm, centre = q.shape[1], norms(q), p.centre(q.shape[1])
                with np.errstate(over="ignore"):
                    product, size = q @ centre.T, norm[:, None] * norms(centre)
                for page in range(len(centre)):
                    if (length, page) in p.radius:
                        limit = above(product[:, page], norm * p.radius[length, page], size[:, page])
                        for i in np.flatnonzero(limit >= floor[at]):
                            for u in range(int(page == own[at[i]]), p.units[length, page]):
                                unit = f"{length}/{page}/{u}"
                                where[at[i]].setdefault(zlib.crc32(unit.encode()) % groups, []).append(unit)
            listed = pa.array([[{"group": g, "units": u} for g, u in x.items()] for x in where], pa.list_(pa.struct([("group", pa.int64()), ("units", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), listed], names=["row", "id", "v", "floor", "units"])

    open_ = queries.select("row", "id", "v", "page").join(floors, "row", "left").select("row", "id", "v", "page", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    # a query goes to a group once, with all units that it visits there
    routed = open_.mapInArrow(route, "row long, id long, v array<double>, floor double, units array<struct<group:long,units:array<string>>>")
    again = routed.select("row", "id", "v", "floor", F.inline("units")).select("group", F.lit(1).alias("kind"), F.lit("").alias("unit"), "row", "id", "v", "floor", "units")
    found = first.union(_visit(entries.union(again), k))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
