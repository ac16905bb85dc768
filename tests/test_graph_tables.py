"""Graphs as tables give what graphs as values give; searches relate to each other as they must."""

import random

import pytest
from pyspark.sql import functions as F

from metaseine.functions.nodegraph import is_output, is_relay
from metaseine.functions.wiring import contracted, feeding, touched
from metaseine.operators import graph
from metaseine.operators.match import SearchError, SearchSpec, search, snippet, term_pattern

TYPES = ["Load", "Scale", "SaveImage", "Reroute", "PreviewImage", "Mix"]


@pytest.fixture(scope="module")
def graphs():
    r = random.Random(4)
    nodes, edges = [], []
    for g in range(12):
        n = r.randrange(1, 12)
        nodes += [(g, str(i), r.choice(TYPES)) for i in range(n)]
        edges += [(g, str(r.randrange(n + 2)), str(r.randrange(n + 2))) for _ in range(r.randrange(0, 2 * n))]
    return nodes, edges


@pytest.mark.parametrize("mode", ["linked", "output"])
def test_connected_tables(spark, graphs, mode):
    nodes, edges = graphs
    want = set()
    for g in {n[0] for n in nodes}:
        known = {i for h, i, _ in nodes if h == g}
        pairs = {(a, b) for h, a, b in edges if h == g and a != b and a in known and b in known}
        outputs = {i for h, i, kind in nodes if h == g and is_output(kind)} if mode == "output" else set()
        want |= {(g, i) for i in feeding(pairs, outputs) or touched(pairs)}
    table = spark.createDataFrame(nodes, "graph int, node string, type string").withColumn("is_output", graph.is_output(F.col("type")))
    got = graph.connected(table, spark.createDataFrame(edges, "graph int, src string, dst string"), mode)
    assert {(r["graph"], r["node"]) for r in got.collect()} == want


def test_contraction_of_chains_and_cycles(spark):
    r = random.Random(9)
    edges, via = [(0, "a", "v1"), (0, "v1", "v2"), (0, "v2", "b")], [(0, "v1"), (0, "v2")]
    for g in range(1, 15):
        n = r.randrange(2, 14)
        edges += [(g, str(r.randrange(n)), str(r.randrange(n))) for _ in range(r.randrange(0, 3 * n))]
        via += [(g, str(i)) for i in range(n) if r.random() < 0.5]
    want = {(g, a, b) for g in range(15) for a, b in contracted({(s, d) for h, s, d in edges if h == g}, {v for h, v in via if h == g})}
    got = graph.contract(spark.createDataFrame(edges, "graph int, src string, dst string"), spark.createDataFrame(via, "graph int, node string"))
    assert {tuple(x) for x in got.collect()} == want and (0, "a", "b") in want and got.count() == len(want)


@pytest.mark.parametrize("block, edges", [(2048, 1 << 23), (3, 40), (1, 1)])
def test_names_join_setters_to_getters(spark, monkeypatch, block, edges):
    monkeypatch.setattr(graph, "BLOCK", block, raising=False)
    monkeypatch.setattr(graph, "TASK_EDGES", edges, raising=False)
    r = random.Random(5)
    nodes = [(r.choice([0, 1, None]), r.choice([None, *map(str, range(90))]), r.choice(["SetNode", "GetNode", "GetNode", "Load", None]), r.choice(["a", "a", "a", "b", "", None])) for _ in range(600)]
    nodes += [(2, "s", "SetNode", "a"), (2, "g", "GetNode", "b"), (3, "s", "SetNode", "a")]
    want = [(g, s, d) for g, s, k, x in nodes if k == "SetNode" for h, d, m, y in nodes if m == "GetNode" and g == h is not None and x == y is not None]
    got = graph.named_edges(spark.createDataFrame(nodes, "graph int, node string, type string, name string"))
    assert got.columns == ["graph", "src", "dst"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 1000
    none = graph.named_edges(spark.createDataFrame(nodes[-3:], "graph int, node string, type string, name string"))
    assert none.collect() == []


def test_one_name_is_work_for_many_tasks(spark):
    """Also where all nodes are read by one task, as from a small file."""
    kind = F.when(F.col("id") < 3000, "SetNode").otherwise("GetNode").alias("type")
    nodes = spark.range(0, 13_000, 1, 1).select(F.lit(0).alias("graph"), F.col("id").cast("string").alias("node"), kind, F.lit("a").alias("name"))
    shares = [x["count"] for x in graph.named_edges(nodes).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 3000 * 10_000 and max(shares) <= sum(shares) / 2


def test_predicates_agree(spark):
    kinds = ["SaveImage", "my_PREVIEW", "VideoCombine", "video_combine", "Reroute (x)", "SetNode", "GetNode", "setnode", "Load", None, "WebSocketOut", "Comparer"]
    rows = spark.createDataFrame([(k,) for k in kinds], "k string").select("k", graph.is_output(F.col("k")).alias("o"), graph.is_relay(F.col("k")).alias("r")).collect()
    assert [(r["o"], r["r"]) for r in rows] == [(is_output(k), is_relay(k)) for k in kinds]


def test_searches_relate(spark):
    r = random.Random(1)
    rows = [(e, u, r.choice("fg"), " ".join(r.choice(["Ähre", "ähre", "bee", "cow", "dog\n", "a.b"]) for _ in range(3))) for e in range(60) for u in range(3)]
    units = spark.createDataFrame(rows, "entity int, unit_ord int, label string, text string")

    def found(*args, **kw):
        return {x["entity"] for x in search(units, SearchSpec(*args, **kw)).collect()}

    both, one = found(("ÄHRE", "cow")), found(("ÄHRE", "cow"), mode="any")
    assert found(("ÄHRE", "cow"), scope="field") <= both <= one
    assert found(("ÄHRE",), ("cow",)) == found(("ÄHRE",)) - found(("cow",))
    assert both == found(("ÄHRE",)) & found(("cow",)) and one == found(("ÄHRE",)) | found(("cow",))
    assert found(("a.b",)) == {e for e, _, _, t in rows if "a.b" in t} and found(("ähre",), case_sensitive=True) == {e for e, _, _, t in rows if "ähre" in t}
    assert found(("bee",), fields=("F",)) == {e for e, _, label, t in rows if label == "f" and "bee" in t}
    assert found((r"(?P<x>c)ow\b",), regex=True) == found(("cow",))


def test_snippet_counts_code_points(spark):
    text = "😀" * 60 + "\x01\x02needle\n" + "é" * 90
    got = spark.createDataFrame([(text,), ("needle",)], "t string").select(snippet(F.col("t"), term_pattern("NEEDLE")).alias("s")).collect()
    assert got[0]["s"] == "…" + "😀" * 44 + " needle " + "é" * 69 + "…" and got[1]["s"] == "needle"
    again = spark.createDataFrame([("x" * 60 + "abab" + "y" * 90,)], "t string").select(snippet(F.col("t"), term_pattern(r"(ab)\1", regex=True)).alias("s")).collect()
    assert again[0]["s"] == "…" + "x" * 46 + "abab" + "y" * 70 + "…"


def test_terms_are_checked_before_they_run(spark):
    units = spark.createDataFrame([(1, 0, "f", "a bb")], "entity int, unit_ord int, label string, text string")
    assert search(units, SearchSpec((r"(?P<my_n>b)(?P=my_n)",), regex=True)).count() == 1
    for bad in (r"(a)?(?(1)b|c)", "(", "a**b", r"(?P<x>a)(?P=y)"):
        with pytest.raises(SearchError):
            SearchSpec((bad,), regex=True)


def test_records_store_the_whole_prompt(spark):
    import json

    from metaseine.plans.fixtures_queries import _records

    sf = "/root/testdata/sf0.001"
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["path"]: json.loads(r["fields"][1]["text"]).get("prompt") for r in _records(spark, sf).collect()}
    assert got == texts and max(len(t or "") for t in texts.values()) > 40
