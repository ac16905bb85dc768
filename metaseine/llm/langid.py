"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Letters in lower case, all else one space; n-grams of 1 to 3 characters hashed to 2**16 features; log term frequency times
inverse document frequency, length 1. Document frequencies cover all rows that may be learned from. Weights come from the
follow-the-regularised-leader update with elastic-net penalties, over a bounded sample of labelled rows (``PER_LANGUAGE``
of each language, chosen by a hash of the id), the rest of which fits the temperature of the softmax.

Null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing could be learned.
Predictions see the text alone. Rows without an id are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, slices

BITS, ORDERS = 16, (1, 2, 3)
#: The bound of the sample that weights and temperature are fitted on, and the share of it kept for the temperature.
PER_LANGUAGE, HELD = 1000, 0.2
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """code point -> its letter in lower case, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x40000):  # the planes above have no letters
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_table: np.ndarray | None = None


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text; none where it has no letter."""
    global _table
    if _table is None:
        _table = _letters()
    c = _table[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
    blank = c == 32
    if blank.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate(([32], c[~(blank & np.concatenate(([True], blank[:-1])))], [32])).astype(np.uint64)
    total = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in ORDERS:
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(repr=False)  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text)
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, seed: int = 7) -> LanguageModel:
    """Fit on (features, counts, language) rows in their order; the temperature on those that the weights did not see."""
    languages = sorted({r[2] for r in rows})
    index = {c: k for k, c in enumerate(languages)}
    model = LanguageModel(languages, idf, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)))
    if not languages:
        return model
    order = np.random.default_rng(seed).permutation(len(rows))
    held, seen = order[: int(len(rows) * HELD)], order[int(len(rows) * HELD) :]
    size = (1 << BITS) + 1  # the last feature is the bias, without penalties
    z, n = np.zeros((size, len(languages))), np.zeros((size, len(languages)))
    made = [(np.append(rows[i][0], size - 1), np.append(model.vector(*rows[i][:2]), 1.0), index[rows[i][2]]) for i in seen]

    def weights(at: np.ndarray, zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size - 1, 0.0, L1)[:, None]
        l2 = np.where(at == size - 1, 0.0, L2)[:, None]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + l2))

    for _ in range(EPOCHS):
        for at, x, y in made:
            zs, ns = z[at], n[at]
            w = weights(at, zs, ns)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    every = np.arange(size)
    w = weights(every, z, n)
    model.weights, model.bias = w[:-1], w[-1]
    if len(held) and len(languages) > 1:
        logits = np.array([model.logits(*rows[i][:2]) for i in held])
        truth = np.array([index[rows[i][2]] for i in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(10), 200))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and language, text and id are not null.

    Document frequencies are summed over all of them; the sample for the weights is bounded by ``per_language``.
    """
    rows = bounded(documents).where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(11)).alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(1 << BITS, np.int64), 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                at, _ = features(text)
                total[at] += 1
                docs += len(at) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["f", "n"])

    found = rows.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    real = found["f"].to_numpy() >= 0
    df[found["f"].to_numpy()[real]] = found["n"].to_numpy()[real]
    n_docs = float(found["n"].to_numpy()[~real].sum())
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    # a row is in the sample by its hash alone, at a rate that gives each language a little over its bound
    rate = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 1.1 * per_language / n)))))
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([f.astype(np.int32) for f, _ in got], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))], names=["lang", "h", "f", "c"])

    sample = rows.where(share < F.element_at(rate, F.col("lang"))).select("text", "lang", "h").mapInArrow(extract, "lang string, h long, f array<int>, c array<int>").toPandas()
    sample = sample.sort_values(["lang", "h"], kind="stable").groupby("lang").head(per_language).sort_values(["h", "lang"], kind="stable")
    return train([(np.asarray(f, np.int64), np.asarray(c, np.int64), lang) for lang, f, c in zip(sample["lang"], sample["f"], sample["c"]) if len(f)], idf)


def predict(documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score, which replace columns of these names."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    kept = bounded(documents).drop("lang_pred", "score")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [held.value.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, _schema(kept, "lang_pred string, score double"))


def _schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 4, held_out: int = 2) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row; learned from the rows that are not held out."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets
    model = fit(documents, rest != held_out, id_col, text_col, lang_col)
    slim = documents.select(F.col(id_col), F.coalesce(rest == held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(slim, model).drop("text")
