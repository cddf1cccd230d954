"""Workspaces, manifests and the command line."""

import json

import pytest

from tracewarden.__main__ import main
from tracewarden.operators import coverage
from tracewarden.plans import rule_queries
from tracewarden.plans import workspace as w


def test_workspace_round_trip(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(json.dumps({"EventID": "1", "Image": "x"}) + "\nnot json\n")
    case = w.Workspace(str(tmp_path / "case"), (w.Source("hosts", "jsonl", str(tmp_path / "e.jsonl")),), "rules", "v1", ("recipe",))
    case.save(spark)
    assert w.Workspace.load(spark, case.root) == case
    assert [r.fields for r in case.read(spark, "hosts").collect()] == [{"EventID": "1", "Image": "x"}]
    with pytest.raises(KeyError):
        case.read(spark, "nowhere")
    with pytest.raises(FileNotFoundError):
        w.Workspace.load(spark, str(tmp_path / "other"))
    assert case.learnt(spark, "baseline") is None
    case.learn(spark, "baseline", {"n": 1})
    case.learn(spark, "baseline", {"n": 2})
    assert case.learnt(spark, "baseline") == {"n": 2}


def test_findings_are_addressed_by_content(spark, tmp_path):
    case = w.Workspace(str(tmp_path), ())
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    cid = case.keep(d, "x")
    assert cid == case.keep(d.repartition(3).select("v", "k"), "x")  # neither order of rows nor of columns counts
    assert cid != case.keep(d.union(d), "x") and cid != case.keep(d.where("k = 1"), "x") and cid != case.keep(d, "y")
    assert sorted(map(tuple, case.derived(spark, cid).collect())) == [(1, "a"), (2, None)]
    assert w.table_id(d.where("false")) == w.table_id(d.where("k > 5"))


def test_coverage_is_stored_and_compared(spark, tmp_path):
    hits = spark.createDataFrame([("a", 1), ("b", 2)], "rule_id string, event_id int")
    tags = spark.createDataFrame([("a", "T1"), ("b", "T1"), ("c", "T2")], "rule_id string, technique string")
    at = spark.createDataFrame([(1,)], "event_id int")
    one, cid = w.Workspace(str(tmp_path), (), "rules", "v1").cover(hits, at, tags, "T1", "event_id")
    two, other = w.Workspace(str(tmp_path), (), "rules", "v2").cover(hits.union(spark.createDataFrame([("b", 1)], hits.schema)), at, tags, "T1", "event_id")
    assert cid != other and sorted(map(tuple, one.collect())) == [("a", "witness"), ("b", "gap")]
    assert [tuple(r) for r in coverage.coverage_changes(one, two).collect()] == [("b", "gap", "witness")]


def test_manifests(spark):
    raw = [*rule_queries.EVENT_RULES, {"id": "broken"}, "text"]
    one, out = w.treat(spark, raw, ["T1046", "t9999"])
    two, _ = w.treat(spark, list(reversed(raw)), ["T1046", "t9999"])
    assert one == two and w.changed_stages(one, two) == [] and one.stages["behaviour"] is None
    got = {r.technique: (r.rules, r.gap) for r in out["coverage"].collect()}
    assert got == {"T1046": (3, False), "T9999": (0, True)}
    fewer, _ = w.treat(spark, raw[:-4], ["T1046", "t9999"])
    assert {"ingest", "compile"} <= set(w.changed_stages(one, fewer)) and fewer.result != one.result


def test_command_line(spark, sf, tmp_path, capsys):
    assert main(["list"]) == 0 and "fanout_conformal" in capsys.readouterr().out
    assert main(["sql", "token_idf"]) == 0 and main(["sql", "nothing"]) == 2
    assert main(["run", "token_idf", "--data", sf, "--out", str(tmp_path / "o"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() > 0
    (tmp_path / "r.yml").write_text("id: a\nlogsource: {}\ndetection:\n  s: {x: 1}\n  condition: s\n")
    assert main(["rules", str(tmp_path)]) == 0
