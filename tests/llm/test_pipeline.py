import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    a = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day in early spring while birds sing"
    b = "der schnelle braune fuchs springt ueber den faulen hund am ufer des flusses an einem sonnigen tag im fruehling"
    out = [(i, f"{a} number {i} with more {i * 7} words and {i * i} ends", "en", "web" if i % 3 else "books", 1) for i in range(40)]
    out += [(100 + i, f"{b} nummer {i} mit {i * 7} mehr woertern und {i * i} ende", "de", "web", 1) for i in range(40)]
    out += [(200, None, None, None, None), (201, "", "en", "web", 0), (202, "12345 !!!", "en", "web", 9), (203, f"{a} password=abcdef123456", "en", "web", 5)]
    return out


def test_stages_take_effect(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_dedup", "secret_scan", "mix_sources", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language_id"](spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {200, 201, 202}
    copies = docs.union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(999).cast("long")))
    once = stage["minhash_dedup"](spark, copies, "")
    assert once.columns == corpus_pipeline.COLUMNS and 999 not in {r["doc_id"] for r in once.collect()} and 5 in {r["doc_id"] for r in once.collect()}
    clean = {r["doc_id"]: r for r in stage["secret_scan"](spark, docs, "").collect()}
    assert clean[203]["text"].endswith(" [SECRET]") and clean[203]["n_chars"] == len(clean[203]["text"]) and clean[0]["n_chars"] == 1 and clean[200]["text"] is None
    assert stage["mix_sources"](spark, docs, "").columns == corpus_pipeline.COLUMNS
    final = corpus_pipeline.run(spark, str(tmp_path))
    got = final.collect()
    assert got and all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows()} - {200, 201, 202}


def python_passes(plan):
    """(most Python passes that one task of the plan runs at once, those of its last stage)."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return python_passes(plan.initialPlan())
    below = [python_passes(plan.children().apply(i)) for i in range(plan.children().size())]
    own = sum(n for _, n in below) + (plan.nodeName() == "MapInArrow")
    return max([own, *(n for n, _ in below)]), 0 if plan.nodeName().endswith("Exchange") else own


def test_tasks_run_one_python_worker_at_a_time(spark, tmp_path, monkeypatch):
    from metaseine.llm import _shared, minhash, mixing

    near = [(300 + i, f"{rows()[i][1]} again", "en", "web", 1) for i in range(40)]
    spark.createDataFrame(rows() + near, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    plans, cut = [], _shared.cut

    def noted(df, *args, **more):
        plans.append(df._jdf.queryExecution().executedPlan())
        return cut(df, *args, **more)

    for module in (_shared, minhash, mixing, corpus_pipeline):
        monkeypatch.setattr(module, "cut", noted)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()}.isdisjoint(r[0] for r in near)
    most = [python_passes(p)[0] for p in [*plans, final._jdf.queryExecution().executedPlan()]]
    assert len(most) > 8 and max(most) == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
