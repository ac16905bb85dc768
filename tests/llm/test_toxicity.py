"""The toxicity models against a plain version of their formulas, and what they must not see."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from metaseine.llm import toxicity

DOCS = "doc_id long, text string"


def rows_and_labels(n=500, seed=1):
    r = random.Random(seed)
    plain = [f"w{int(300 * r.random() ** 3)}" for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randrange(3, 40))
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words[r.randrange(len(words)):0] = r.choice([["lump"], ["hinaus", "mit", "dir"], ["schuft"]])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(n + i, rows[4 * i][1]) for i in range(20)]  # copies
    labels += [(n + i, 1) for i in range(20)]
    return rows, labels


def plain_ratios(texts, asked):
    """The formulas of the module, by dictionaries of strings."""
    pairs = {c: defaultdict(int) for c in "ot"}
    for c in "ot":
        for t in set(texts[c]):
            w = t.split()
            for p in set(zip(["", *w], w)):
                pairs[c][p] += 1
    both = defaultdict(int)
    for c in "ot":
        for p, n in pairs[c].items():
            both[p] += n

    def disc(values):
        n = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [0, 1, min(max(2 - 3 * y * n[2] / n[1], 0), 2) if n[1] else 2, min(max(3 - 4 * y * n[3] / n[2], 0), 3) if n[2] else 3]
        return lambda x: max(x - d[min(x, 3)], 0.0)

    def per(table, at):
        out = defaultdict(list)
        for p, n in table.items():
            out[p[at]].append(n)
        return out

    cont = {c: {w: len(x) for w, x in per(pairs[c], 1).items()} for c in "ot"}
    k = {w: len(x) for w, x in per(both, 1).items()}
    total = sum(k.values())
    word = {}
    for c in "ot":
        keep, size = disc(cont[c].values()), sum(cont[c].values())
        left = sum(map(keep, cont[c].values()))
        word[c] = lambda w, c=c, keep=keep, size=size, left=left: keep(cont[c].get(w, 0)) / size + (size - left) / size * max(k.get(w, 1), 1) / total
    keep = {c: disc(pairs[c].values()) for c in "ot"}
    keep_both = disc(both.values())
    after = {c: {v: sum(x) for v, x in per(pairs[c], 0).items()} for c in "ot"}
    after_both = per(both, 0)

    def ratio(v, w):
        if v not in after_both:
            return math.log(word["t"](w) / word["o"](w))
        n = sum(after_both[v])
        weight = (n - sum(map(keep_both, after_both[v]))) / n
        shared = max(k.get(w, 1), 1) / total
        pooled = keep_both(both.get((v, w), 0)) / n + weight * shared
        p = {c: keep[c](pairs[c].get((v, w), 0)) / max(after[c].get(v, 0), 1) + weight * pooled * word[c](w) / shared for c in "ot"}
        return math.log(p["t"] / p["o"])

    return [[ratio(v, w) for v, w in zip(["", *t.split()], t.split())] for t in asked]


def test_the_models_are_their_formulas(spark):
    rows, labels = rows_and_labels()
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    truth = dict(labels)
    texts = {"o": [t for i, t in rows if not truth[i]], "t": [t for i, t in rows if truth[i]]}
    asked = [t for _, t in rows[:60]] + ["unseen words alone", "w1 unseen hinaus mit dir", "lump"]
    for text, want in zip(asked, plain_ratios(texts, asked)):
        got = model.tables.held.value.ratios(toxicity.word_ids(text))
        assert np.allclose(got, want, atol=1e-9), text
    # an expression of ordinary words tells by its order
    first, second = (toxicity.measures(model.tables.held.value.ratios(toxicity.word_ids(t)))[2] for t in ("hinaus mit dir", "dir mit hinaus"))
    assert first > second


def test_held_out_labels_have_no_effect(spark):
    rows, labels = rows_and_labels(400, 2)
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "lump schuft")], DOCS)

    def scores(labels):
        return {x["doc_id"]: (x["score"], x["predicted"]) for x in toxicity.detect(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    without = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    assert flipped != labels and scores(labels) == scores(flipped) == scores(without)


def test_labels_given_twice_and_rows_given_twice(spark):
    rows, labels = rows_and_labels(300, 3)
    learn = F.lit(True)
    schema = "doc_id long, toxic int"
    one = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, schema), learn)
    two = toxicity.fit(spark.createDataFrame(rows + rows[:40], DOCS), spark.createDataFrame(labels + [(i, 0) for i, _ in labels[:50]], schema), learn)
    assert one.weights == two.weights and (one.tables.held.value.counts == two.tables.held.value.counts).all()


def test_a_part_without_a_class_has_the_fixed_curve(spark):
    rows = [(i, f"a b c{i} d") for i in range(12)] + [(20, "x lump y")]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i == 20)) for i, _ in rows], "doc_id long, toxic int"), F.lit(True))
    assert model.weights == toxicity.CURVE and toxicity.score(spark.createDataFrame(rows, DOCS), model).count() == 13
