import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from metaseine.operators import scan as s
from metaseine.operators import sinks
from metaseine.operators.match import SearchError, SearchSpec
from metaseine.sources import walk
from metaseine.sources.results_log import ParameterMismatch, ResultsLog

from . import build
from .test_nodegraph import PROMPT


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    (root / "sub").mkdir()
    (root / ".cache").mkdir()
    graph = json.dumps(PROMPT)
    (root / "a.png").write_bytes(build.png(build.text("prompt", graph), build.text("note", "Sunset café")))
    (root / "_b.png").write_bytes(build.png(build.text("parameters", "a dog\nNegative prompt: bad\nSteps: 9, Model: m1")))
    (root / "sub" / "c.mp4").write_bytes(build.mp4({"comment": "sunset film"}))
    (root / "sub" / "empty.png").write_bytes(b"")
    (root / "sub" / "page.jpg").write_bytes(b"<html>no</html>")
    (root / ".cache" / "h.png").write_bytes(build.png(build.text("note", "sunset")))
    (root / "alias.png").write_bytes(s.ALIAS_MAGIC + b"x" * 50)
    (root / "notes.txt").write_text("sunset")
    os.symlink(root / "a.png", root / "sub" / "link.png")
    os.symlink(root / "gone.png", root / "sub" / "dead.png")
    return str(root)


def names(df, column="path"):
    return sorted(os.path.basename(r[column]) for r in df.collect())


def test_walk(spark, folder):
    assert names(walk.files(spark, folder)) == ["_b.png", "a.png", "alias.png", "c.mp4", "dead.png", "empty.png", "link.png", "page.jpg"]
    assert "h.png" in names(walk.files(spark, folder, hidden=True))
    assert names(walk.files(spark, folder, recursive=False)) == ["_b.png", "a.png", "alias.png"]
    assert names(walk.files(spark, folder, exclude=["SU*"])) == ["_b.png", "a.png", "alias.png"]
    assert names(walk.files(spark, folder, exclude=["x,sub", "y"], ext=["mp4"])) == ["c.mp4"]
    assert names(walk.files(spark, folder, ext=[".MP4"])) == ["c.mp4"]
    assert names(walk.files(spark, folder).where("ext = 'jpg'")) == ["page.jpg"]


def test_search_counts_and_sinks(spark, folder, tmp_path):
    tables = s.scan(spark, folder, SearchSpec(("SUNSET",)))
    assert names(tables["results"]) == ["a.png", "c.mp4"]
    assert s.report(tables).first().asDict() == {"scanned": 5, "matched": 2, "duplicates": 0, "unreadable": 2, "cached": 0, "read": 6, "skipped_links": 3}
    out = io.StringIO()
    sinks.write_csv(sinks.csv_rows(tables["results"]), out)
    rows = list(csv.reader(io.StringIO(out.getvalue())))
    assert rows[0] == ["path", "field", "snippet", "link"] and [r[1] for r in rows[1:]] == ["note", "comment"]
    made = sinks.link_all(tables["results"], folder, str(tmp_path / "found"), "copy", flatten=True)
    assert names(made.select("link"), "link") == ["a.png", "sub__c.mp4"]
    out = io.StringIO()
    sinks.write_json(tables["results"], {"matched": 2}, out)
    report = json.loads(out.getvalue())
    assert report["results"][0]["matches"] == [{"field": "note", "snippet": "Sunset café"}]


def test_unicode_graph_and_exclusion(spark, folder):
    assert names(s.scan(spark, folder, SearchSpec(("CAFÉ",)))["results"]) == ["a.png"]
    assert names(s.scan(spark, folder, SearchSpec(("stray",)))["results"]) == ["a.png"]
    assert names(s.scan(spark, folder, SearchSpec(("stray",), connected="linked"))["results"]) == []
    assert names(s.scan(spark, folder, SearchSpec(("sunset",), ("film",)))["results"]) == ["a.png"]
    hit = s.scan(spark, folder, SearchSpec(("cat",), inputs=("text",)))["results"].first()
    assert [h["label"] for h in hit["hits"]] == ["prompt#2"]


def test_saved_prompts_and_summary(spark, folder):
    got = s.scan(spark, folder, SearchSpec(("dog",), saved_kinds=("prompt",)), show=True)["results"].first()
    assert got["hits"][0]["label"] == "parameters:prompt" and json.loads(got["summary"])["models"] == ["m1"] and got["flat"]["negative"] == "bad"


def test_links_are_followed_once(spark, folder):
    tables = s.scan(spark, folder, SearchSpec(("sunset",)), follow_links=True)
    assert names(tables["results"]) == ["a.png", "c.mp4"] and s.report(tables).first()["duplicates"] == 1


def test_broken(spark, folder):
    tables = s.scan(spark, folder, SearchSpec(broken=True))
    got = {os.path.basename(r["path"]): r["hits"][0]["snippet"] for r in tables["results"].collect()}
    assert set(got) == {"empty.png", "page.jpg"} and "[empty file; 0 B]" in got["empty.png"] and "HTML or XML" in got["page.jpg"]
    assert {r["kind"]: r["n"] for r in s.error_kinds(tables, True).collect()} == {"empty file": 1, "HTML or XML text (an error page saved as an image?)": 1}


def test_index(spark, folder, tmp_path):
    place = str(tmp_path / "index")
    cold = s.report(s.scan(spark, folder, SearchSpec(("sunset",)), index=place)).first()
    warm = s.scan(spark, folder, SearchSpec(("cat",)), index=place)
    again = s.report(warm).first()
    assert (cold["cached"], cold["read"]) == (0, 6) and (again["cached"], again["read"]) == (3, 3) and names(warm["results"]) == ["a.png"]
    deep = s.report(s.scan(spark, folder, SearchSpec(("cat",), deep=True), index=place)).first()
    assert deep["cached"] == 0


def test_resume(spark, folder, tmp_path):
    log = ResultsLog(spark, str(tmp_path / "log"), {"terms": ["sunset"]})
    log.record(s.scan(spark, folder, SearchSpec(("sunset",))))
    assert [os.path.basename(r["dir"]) for r in log.done().collect()] == [os.path.basename(folder)]  # sub has errors
    rest = s.scan(spark, folder, SearchSpec(("sunset",)), skip_dirs=log.done())
    assert names(rest["results"]) == ["c.mp4"]
    log.record(rest)
    assert log.hits().count() == 2
    with pytest.raises(ParameterMismatch):
        ResultsLog(spark, str(tmp_path / "log"), {"terms": ["other"]})


def test_a_stopped_search_keeps_its_waves(spark, tmp_path, monkeypatch):
    root = tmp_path / "media"
    for d in range(12):
        (root / str(d)).mkdir(parents=True)
        for k in range(3):
            (root / str(d) / f"{k}.png").write_bytes(build.png(build.text("note", f"sunset {d}")))
    monkeypatch.setattr(s, "FILES", 1)
    monkeypatch.setattr(s, "FILLS", 3)
    log = ResultsLog(spark, str(tmp_path / "log"), {})
    record, calls = log.record, []

    def stopping(tables):
        if calls:
            raise KeyboardInterrupt
        record(tables)
        calls.append(1)

    monkeypatch.setattr(log, "record", stopping)
    with pytest.raises(KeyboardInterrupt):
        s.scan(spark, str(root), SearchSpec(("sunset",)), log=log)
    kept = log.done().count()
    assert 0 < kept < 12 and log.hits().count() == 3 * kept
    again = ResultsLog(spark, str(tmp_path / "log"), {})
    tables = s.scan(spark, str(root), SearchSpec(("sunset",)), log=again)
    assert s.report(tables).first()["matched"] == 36 - 3 * kept and again.hits().count() == 36 and again.done().count() == 12
    assert s.report(s.scan(spark, str(root), SearchSpec(("sunset",)), log=again)).first()["scanned"] == 0


def test_a_flat_folder_is_many_tasks(spark, folder, monkeypatch):
    rows = walk.files(spark, folder, recursive=False)
    assert s.spread(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(s, "FEWEST", 1)
    assert s.spread(rows).rdd.getNumPartitions() == 3


def test_graphs_are_not_passed_over(spark, tmp_path):
    (tmp_path / "g.png").write_bytes(build.png(build.text("prompt", json.dumps({"1": {"class_type": "T", "inputs": {"text": 'a café "called" x\ny'}}}))))
    for terms, regex in (("cafe\u0301",), False), (('"CALLED" x',), False), ((r"\p{L}{4} ..called",), True), ((r"(?<w>l)\k<w>ed",), True):
        for scope in ("image", "node"):
            spec = SearchSpec(terms, regex=regex, scope=scope, connected=None, inputs=("text",))
            found = [h["label"] for r in s.scan(spark, str(tmp_path), spec)["results"].collect() for h in r["hits"]]
            assert found == ([] if "CALLED" in terms[0] else ["prompt#1"]), (terms, found)


def test_usage():
    for bad in ({"terms": ()}, {"terms": ("a",), "broken": True}, {"terms": ("(",), "regex": True}, {"terms": ("a",), "saved_kinds": (), "inputs": ("x",)}, {"terms": ("a",), "scope": "page"}):
        with pytest.raises(SearchError):
            SearchSpec(**bad)
    assert F is not None


def test_streaming_and_command_line(spark, folder, tmp_path):
    from metaseine import cli
    from metaseine.streaming.landing import watch

    watch(spark, folder, SearchSpec(("sunset",)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {os.path.basename(r["path"]) for r in spark.read.parquet(str(tmp_path / "out" / "hits")).collect()} >= {"a.png", "c.mp4"}
    out = io.StringIO()
    assert cli.main([folder, "sunset", "-r", "--json"], out) == 0
    assert json.loads(out.getvalue())["matched"] == 2
    assert cli.main([folder, "nowhere to be found", "-0"], io.StringIO()) == 1
    assert cli.main([folder], io.StringIO()) == 2 and cli.main([folder, "(", "--regex"], io.StringIO()) == 2
    assert cli.main([folder, "a", "-r", "--link-dir", folder + "/sub"], io.StringIO()) == 2
    out = io.StringIO()
    assert cli.main([folder, "dog", "-v", "--show", "--errors"], out) == 0 and "models" in out.getvalue() and "unreadable" not in out.getvalue()
