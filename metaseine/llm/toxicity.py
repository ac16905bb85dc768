"""Toxicity from class-conditional Kneser-Ney bigram models.

Toxic and ordinary documents have a model each. How often a pair of words was met counts the distinct texts that hold it, so copies weigh once;
a word's own count is the number of different words before it (its continuations). With c the pair's count in a class, C that of its
first word and d the absolute discount,

    p(w | v, class) = max(c - d, 0) / C  +  b(v) p(w | v, both) p(w | class) / p(w | both)
    p(w | v, both)  = max(n - d, 0) / N  +  b(v) p(w | both)
    p(w | class)    = max(k - d, 0) / K  +  b p(w | both)

so a class backs off to counts that both classes share, which its words' marginals scale (as in adaptation by marginals), and the weight b(v) of the
backoff is shared too: that a smaller class has not shown a pair says nothing. Discounts are the modified ones, estimated from counts of counts, but
for d(1) = 1: what was met in one text, or after one word only, carries no evidence.

A word in its place has the difference of the two log-likelihoods. A document's measures are length-normalised: the mean over all its
words, the mean over its three most toxic words and the greatest one, for toxic passages are short and texts long. A logistic curve makes a score of
them. It is fitted on a bounded sample of a part of the learned texts, with counts that leave this part out; where the part lacks a class, the
curve is a fixed one (``CURVE``). The counts of the final scores are those of all learned texts.

Counts stand in written tables that grow with the corpus. Up to ``HELD`` entries are sent to the executors; more of them are joined to the distinct
words and pairs of each document. Labels of rows that are not learned from are dropped before anything is counted. Null, empty and blank
texts score as texts without evidence. Where either class could not be learned, every score is 0. Labels of a document given twice count as
toxic if one does; labels without a document, null labels and rows without an id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, cut, give_back, keep_likely, likely, slices

#: Entries of the tables up to which they are broadcast (more are joined), and labels up to which these are.
HELD, BROADCAST_ROWS = 1 << 22, 1_000_000
#: The words that the second measure averages over.
TOP = 3
#: The bound of the sample of learned texts that the curve is fitted on, of each class, and one text in so many may be in it.
PER_CLASS, PART = 3000, 4
#: Pairs that a task gathers before it sends them on.
BUFFER = 1 << 20
#: Weights of the three measures and 1, where no curve can be fitted.
CURVE = (2.0, 4.0, 2.0, -17.0)
_words = re.compile(r"[^\W_]+").findall
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_ids(text: str | None) -> np.ndarray:
    """48-bit hashes of the words of a text, in lower case."""
    return (np.array([xxhash.xxh64_intdigest(w) for w in _words((text or "").lower())], np.uint64) >> np.uint64(16)).view(np.int64)


def before(ids: np.ndarray) -> np.ndarray:
    """The word before each word; the first stands after a mark of its own (0)."""
    return np.concatenate(([0], ids[:-1])).astype(np.int64) if len(ids) else ids


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair."""
    with np.errstate(over="ignore"):
        x = (v.view(np.uint64) * _M1) ^ (w.view(np.uint64) + _M2)
        x *= _M2
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def pairs_of(texts: list[str | None], kinds: list[int]) -> np.ndarray:
    """Rows (w, v, kind, n): in how many of the texts of a kind each pair stands."""
    found = [np.empty((0, 4), np.int64)]
    for text, k in zip(texts, kinds):
        w = word_ids(text)
        v = before(w)
        at = np.unique(pair_key(v, w), return_index=True)[1]
        found.append(np.column_stack((w[at], v[at], np.full((len(at), 2), (k, 1)))))
    return summed(found)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (w, v, kind, n) with the numbers of equal pairs and kinds added up."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    at = np.flatnonzero(new)
    out = rows[at]
    if len(at):
        out[:, 3] = np.add.reduceat(rows[:, 3], at)
    return out


#: What is known of a word: different words before it in ordinary, toxic and both kinds of texts; as a first word, the sums of its pairs' counts in
#: ordinary and in toxic ones, and its pairs, of them those counted once and twice.
RECORD = ("k_o", "k_t", "k", "c_o", "c_t", "types", "ones", "twos")
WORD, PAIR = 0, 1


def discounts(n: list[int]) -> np.ndarray:
    """Absolute discounts of counts 0, 1, 2 and 3 or more from the numbers of entries counted once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    two = 2 - 3 * y * n3 / n2 if n2 else 2.0
    three = 3 - 4 * y * n4 / n3 if n3 else 3.0
    return np.array([0.0, 1.0, min(max(two, 0.0), 2.0), min(max(three, 0.0), 3.0)])


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - d[np.minimum(counts, 3)], 0.0)


@dataclass
class Totals:
    """Discounts of words' and pairs' counts by class (o, t; pairs also n, of both), sums of words' counts, and the classes' shares of the backoff."""

    word: dict[str, np.ndarray]
    pair: dict[str, np.ndarray]
    total: dict[str, float]
    back: dict[str, float]


@dataclass
class Counts:
    """Words and pairs in the order of their ids, with their records; what is not among them was met once at most."""

    totals: Totals
    words: np.ndarray
    records: np.ndarray  # words x RECORD
    pairs: np.ndarray
    counts: np.ndarray  # pairs x (ordinary, toxic)

    def prepared(self) -> Counts:
        """With what ``ratios`` needs of the words; made where it is used first, for it is larger than the counts."""
        if hasattr(self, "weight"):
            return self
        t, r = self.totals, self.records
        k = {c: np.append(r[:, RECORD.index(f"k_{c}")], 0) for c in "ot"}
        shared = np.append(np.maximum(r[:, RECORD.index("k")], 1), 1) / max(t.total["k"], 1.0)  # the last entry: all other words
        self.shared = shared
        self.scale = {c: (kept(k[c], t.word[c]) / t.total[c] + t.back[c] * shared) / shared for c in "ot"}
        self.alone = np.log(self.scale["t"]) - np.log(self.scale["o"])
        self.sums = {c: np.append(r[:, RECORD.index(f"c_{c}")], 0) for c in "ot"}
        types, ones, twos = (np.append(r[:, RECORD.index(x)], 0) for x in ("types", "ones", "twos"))
        d, both = t.pair["n"], self.sums["o"] + self.sums["t"]
        self.weight = np.where(both > 0, (d[1] * ones + d[2] * twos + d[3] * (types - ones - twos)) / np.maximum(both, 1), 1.0)
        return self

    def ratios(self, ids: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) for each word of a text in its place."""
        if not len(ids):
            return np.zeros(0)
        self.prepared()
        w = find(ids, self.words)
        out = self.alone[w]
        p = find(pair_key(before(ids), ids), self.pairs)
        at = np.flatnonzero(p < len(self.pairs))
        if len(at):
            v = np.concatenate(([find(np.zeros(1, np.int64), self.words)[0]], w[:-1]))[at]
            w, p = w[at], p[at]
            t, n = self.totals, self.counts[p].sum(axis=1)
            pooled = kept(n, t.pair["n"]) / np.maximum(self.sums["o"][v] + self.sums["t"][v], 1) + self.weight[v] * self.shared[w]
            part = [np.log(kept(self.counts[p, i], t.pair[c]) / np.maximum(self.sums[c][v], 1) + self.weight[v] * pooled * self.scale[c][w]) for i, c in enumerate("ot")]
            out = out.copy()
            out[at] = part[1] - part[0]
        return out


def find(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each id, or one past the last."""
    if not len(among):
        return np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(among, ids), len(among) - 1)
    return np.where(among[at] == ids, at, len(among))


def measures(r: np.ndarray) -> tuple[float, float, float]:
    """(the greatest, the mean of the TOP greatest, the mean) of the words' log ratios."""
    if not len(r):
        return 0.0, 0.0, 0.0
    best = np.sort(np.partition(r, len(r) - TOP)[-TOP:] if len(r) > TOP else r)
    return float(best[-1]), float(best.sum() / TOP), float(r.mean())


@dataclass
class Tables:
    """The tables of a model: (id, RECORD) of words and (v, w, o, t) of pairs, and their totals; ``held`` are the Counts, broadcast, where they are
    few, so that the driver keeps none."""

    words: DataFrame
    pairs: DataFrame
    totals: Totals
    held: Broadcast | None = None

    @staticmethod
    def of(words: DataFrame, pairs: DataFrame) -> Tables | None:
        """From the counts of all words (id, RECORD) and pairs (w, v, o, t); None where a class has none."""
        sums = [F.sum(c).alias(f"sum_{c}") for c in ("k_o", "k_t", "k")]
        numbers = [F.count_if(F.col(f"k_{c}") == i).alias(f"{c}{i}") for c in "ot" for i in (1, 2, 3, 4)]
        above = [x for c in "ot" for x in (F.count_if(F.col(f"k_{c}") > 2).alias(f"many_{c}"), F.sum(F.when(F.col(f"k_{c}") > 2, F.col(f"k_{c}"))).alias(f"high_{c}"))]
        a = words.agg(*sums, *numbers, *above).first().asDict()
        if not a["sum_k_o"] or not a["sum_k_t"]:
            return None
        b = pairs.agg(*(F.count_if(x == i).alias(f"{c}{i}") for c, x in (("o", F.col("o")), ("t", F.col("t")), ("n", F.col("o") + F.col("t"))) for i in (1, 2, 3, 4))).first().asDict()
        word, pair = ({c: discounts([x[f"{c}{i}"] for i in (1, 2, 3, 4)]) for c in cs} for x, cs in ((a, "ot"), (b, "otn")))
        total = {c: float(a[f"sum_{k}"]) for c, k in (("o", "k_o"), ("t", "k_t"), ("k", "k"))}
        back = {}
        for c in "ot":
            left = a[f"{c}2"] * (2 - word[c][2]) + (a[f"high_{c}"] or 0) - a[f"many_{c}"] * word[c][3]
            back[c] = (total[c] - left) / total[c]
        out = Tables(words.where("k > 1 or types > ones"), pairs.where("o > 1 or t > 1"), Totals(word, pair, total, back))
        if out.words.count() + out.pairs.count() <= HELD:
            out.held = words.sparkSession.sparkContext.broadcast(out.gathered())
            give_back()
        return out

    def gathered(self) -> Counts:
        w = _small(self.words.select("id", *RECORD), RECORD)
        ids = w.column("id").to_numpy()
        rows = np.argsort(ids)
        ids = ids[rows]
        records = np.empty((len(ids), len(RECORD)), w.column(RECORD[0]).to_numpy().dtype)
        for k, c in enumerate(RECORD):
            records[:, k] = w.column(c).to_numpy()[rows]
        del w
        p = _small(self.pairs.select("v", "w", "o", "t"), "ot")
        keys = pair_key(p.column("v").to_numpy(), p.column("w").to_numpy())
        rows = np.argsort(keys)
        counts = np.empty((len(rows), 2), p.column("o").to_numpy().dtype)
        for k, c in enumerate("ot"):
            counts[:, k] = p.column(c).to_numpy()[rows]
        return Counts(self.totals, ids, records, keys[rows], counts)

    def entries(self) -> DataFrame:
        """(kind, key, values) of all words and pairs."""

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(pair_key(b.column(0).to_numpy(), b.column(1).to_numpy())), b.column(2)], names=["key", "value"])

        words = self.words.select(F.lit(WORD).alias("kind"), F.col("id").alias("key"), F.array(*RECORD).alias("value"))
        pairs = self.pairs.select("v", "w", F.array("o", "t").alias("value")).mapInArrow(named, "key long, value array<long>")
        return words.unionByName(pairs.select(F.lit(PAIR).alias("kind"), "key", "value"))


def _small(table: DataFrame, columns) -> pa.Table:
    """``table`` on the driver, its counts with 32 bits where these do."""
    most = table.agg(F.max(F.greatest(*columns))).first()[0] or 0
    return table.withColumns({c: F.col(c).cast("int") for c in columns} if most < 1 << 31 else {}).toArrow()


NAMES = ("__most", "__top", "__mean")


def measured(documents: DataFrame, tables: Tables, text_col: str) -> DataFrame:
    """``documents`` without the text and with its measures, which replace columns of their names."""
    from .langid import _schema

    rows = bounded(documents).drop(*NAMES)
    more = ", ".join(f"{n} double" for n in NAMES)
    if tables.held is not None:
        held = tables.held
        at = rows.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                got = [measures(held.value.ratios(word_ids(t))) for t in b.column(at).to_pylist()]
                rest = [i for i in range(b.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], names=[*(b.schema.names[i] for i in rest), *NAMES])

        return rows.mapInArrow(run, _schema(rows.drop(text_col), more))
    totals = tables.totals

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word_ids(text)
                keys = [np.unique(np.append(w, 0)) if len(w) else w, np.unique(pair_key(before(w), w))]
                kind = np.repeat(np.array([WORD, PAIR], np.int32), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), row, np.int64)), pa.array(kind), pa.array(np.concatenate(keys))], names=["__row", "kind", "key"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = [sorted((x["key"], x["value"]) for x in found or () if x["kind"] == k) for k in (WORD, PAIR)]
                ids = [np.array([k for k, _ in p], np.int64) for p in parts]
                values = [np.array([v for _, v in p], np.int64).reshape(-1, n) for p, n in zip(parts, (len(RECORD), 2))]
                got.append(measures(Counts(totals, ids[0], values[0], ids[1], values[1]).ratios(word_ids(text))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], names=["__row", *NAMES])

    # the numbers of the rows must stay: they are written once
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("__row", F.col(text_col).alias("text"))
    known = texts.mapInArrow(asked, "__row long, kind int, key long").join(tables.entries().hint("merge"), ["kind", "key"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "key", "value")).alias("found"))
    both = texts.join(known.hint("merge"), "__row", "left").select("__row", "text", "found").mapInArrow(answered, "__row long, " + more)
    return rows.drop(text_col).join(both.hint("merge"), "__row").drop("__row")


@dataclass
class ToxicityModel:
    tables: Tables | None = None  # none: nothing was learned
    weights: tuple[float, ...] = CURVE

    def curve(self, x: np.ndarray) -> np.ndarray:
        """Scores from rows of measures."""
        w = np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of (x, 1) by Newton's method."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learned_texts(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """((text, h, y), (h, y)): the distinct learned texts of each class, and their hashes alone, which are written."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    known = cut(known.groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y")), "labels")
    few = known.count() <= BROADCAST_ROWS
    rows = documents.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # labels have no bound: where they are many, a filter of a fixed size keeps texts without one out of the shuffle
    rows = rows if few else keep_likely(rows, "id", likely(known, "id"))
    some = rows.join(F.broadcast(known) if few else known.hint("merge"), "id").select("id", F.xxhash64("text").alias("h"), "y")
    # of equal texts one row stands for all; only rows that share id and text need their texts compared
    chosen = some.groupBy("y", "h", "id").agg(F.count("*").alias("n")).groupBy("y", "h").agg(F.min_by("n", "id").alias("n"), F.min("id").alias("id"))
    chosen = cut(chosen, "texts")
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen) if few else chosen.hint("merge"), ["id", "h"])
    single, repeated = found.where("n = 1"), found.where("n > 1")
    if not chosen.where("n > 1").isEmpty():
        single = single.unionByName(repeated.dropDuplicates(["id", "h", "y"]))
    return single.select("text", "h", "y"), chosen.select("h", "y")


def fit(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn from the documents with a label where ``learn``, a condition on ``id_col`` of both tables, holds."""
    texts, names = learned_texts(bounded(documents), labels, learn, id_col, text_col, label_col)
    part = F.pmod(F.xxhash64("h", F.lit(23)), F.lit(PART)) == 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []

        def sent() -> Iterator[pa.RecordBatch]:
            rows = summed(gathered)
            gathered.clear()
            for at in range(0, len(rows), 65536):
                some = rows[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(some[:, 3] * 4 + some[:, 2])], names=["w", "v", "n"])

        for b in slices(batches, 2048, 4):
            gathered.append(pairs_of(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if sum(map(len, gathered)) >= BUFFER:
                yield from sent()
        if gathered:
            yield from sent()

    # kinds: 0 ordinary, 1 toxic; 2 and 3 the same in the part that the curve is fitted on
    kind = (F.col("y") + F.when(part, 2).otherwise(0)).cast("int")
    found = texts.select("text", kind.alias("kind")).mapInArrow(counted, "w long, v long, n long").repartition("w", "v")
    count = lambda *kinds: F.sum(F.when(F.col("n").bitwiseAND(3).isin(*kinds), F.shiftright("n", 2)).otherwise(0))
    pairs = cut(found.groupBy("w", "v").agg(count(0, 2).alias("o"), count(1, 3).alias("t"), count(0).alias("fit_o"), count(1).alias("fit_t")), "pairs")

    def record(o: Column, t: Column, first: bool) -> list[Column]:
        n, zero = o + t, F.lit(0)
        return [zero, zero, zero, o, t, (n > 0).cast("int"), (n == 1).cast("int"), (n == 2).cast("int")] if first else [(o > 0).cast("int"), (t > 0).cast("int"), (n > 0).cast("int"), *[zero] * 5]

    def role(first: bool) -> Column:
        # what the part adds is 0 for most pairs, and such columns cost little in a shuffle
        full, without = record(F.col("o"), F.col("t"), first), record(F.col("fit_o"), F.col("fit_t"), first)
        return F.struct(F.col("v" if first else "w").alias("id"), *(x.alias(f"fit_{c}") for c, x in zip(RECORD, without)), *((x - y).alias(f"more_{c}") for c, x, y in zip(RECORD, full, without)))

    sums = pairs.select(F.explode(F.array(role(False), role(True))).alias("r")).select("r.*").groupBy("id").agg(*(F.sum(p + c).alias(p + c) for p in ("fit_", "more_") for c in RECORD))
    words = cut(sums.select("id", *((F.col(f"fit_{c}") + F.col(f"more_{c}")).alias(c) for c in RECORD), *(f"fit_{c}" for c in RECORD)), "words")
    weights = CURVE
    fitted = Tables.of(words.select("id", *(F.col(f"fit_{c}").alias(c) for c in RECORD)).where("k > 0 or types > 0"), pairs.select("w", "v", F.col("fit_o").alias("o"), F.col("fit_t").alias("t")).where("o + t > 0"))
    if fitted is not None:
        sizes = {r["y"]: r["n"] for r in names.groupBy("y").agg(F.count("*").alias("n")).collect()}
        u = F.shiftrightunsigned(F.xxhash64("h", F.lit(29)), 11) / F.lit(float(1 << 53))
        rate = {k: min(1.0, 1.7 * PART * per_class / max(1, sizes.get(k, 0))) for k in (0, 1)}
        wanted = texts.where(part & (u < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))).select(F.xxhash64("h", F.lit(29)).alias("at"), "text", "y")
        got = measured(wanted, fitted, "text").toPandas()
        if len(set(got["y"])) == 2:
            got = got.sort_values(["at", "y", *NAMES]).groupby("y").head(per_class)
            w = logistic(got[list(NAMES)].to_numpy(), got["y"].to_numpy(np.float64))
            # the bounded sample may hold other shares of the classes than the learned texts do
            true, mine = sizes[1] / (sizes[0] + sizes[1]), (got["y"] == 1).mean()
            w[-1] += np.log(true / (1 - true)) - np.log(mine / (1 - mine))
            weights = tuple(float(x) for x in w)
        if fitted.held is not None:
            fitted.held.destroy()
    return ToxicityModel(Tables.of(words.select("id", *RECORD), pairs.select("w", "v", "o", "t")), weights)


def _graded(rows: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """``rows``, which end with the measures, with score and predicted in their place."""
    from .langid import _schema

    curve = ToxicityModel(None, model.weights).curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = curve(np.column_stack([b.column(b.num_columns - 3 + k).to_numpy() for k in range(3)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*b.schema.names[:-3], "score", "predicted"])

    return rows.mapInArrow(run, _schema(rows.drop(*NAMES), "score double, predicted int"))


def score(documents: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """``documents`` with score and predicted, which replace columns of these names; without the text where it isn't asked for."""
    rows = documents.drop("score", "predicted")
    if model.tables is None:
        return (rows if keep_text else rows.drop(text_col)).withColumns({"score": F.lit(0.0), "predicted": F.lit(int(0 >= threshold))})
    if keep_text:  # the measures take a text away
        rows, text_col = rows.withColumn("__text", F.col(text_col)), "__text"
    return _graded(measured(rows, model.tables, text_col), model, threshold)


def detect(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", buckets: int = 3, held_out: int = 1) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row; learned from labelled rows that are not held out."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets
    model = fit(documents, labels, rest != held_out, id_col, text_col, label_col)
    slim = documents.select(F.col(id_col), F.coalesce(rest == held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return score(slim, model, keep_text=False)
