from pyspark.sql import functions as F

from tracewarden.functions import belnap as b
from tracewarden.functions.chronicle import Before, Either, Every, Never, Occurs, recognise
from tracewarden.operators import assessment, rules
from tracewarden.plans.registry import Registry


def rule(i, **detection):
    return rules.compile_rule({"id": i, "detection": detection})


def test_chronicles(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 5.0), ("b", "y", 1.0), ("b", "x", 2.0)], "trace string, label string, t double")
    live = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["x"]), ("d", [])], "trace string, labels array<string>")
    got = lambda p: [r["code"] for r in sorted(recognise(t, live, p).collect())]
    T, F_, N = b.TRUE, b.FALSE, b.NONE
    assert got(Occurs("x")) == [T, T, F_, N]
    assert got(Occurs("x", 1.5, 3.0)) == [F_, T, F_, N]
    assert got(Before("x", "y")) == [T, F_, N, N]
    assert got(Never(Occurs("y"))) == [F_, F_, N, N]
    assert got(Every((Occurs("x"), Occurs("y")))) == [T, T, b.t_meet(F_, N), N]
    assert got(Either(())) == [F_] * 4 and got(Every(())) == [T] * 4


def test_faults():
    shared, own = {"a": "1"}, {"z": "9"}
    rs = [rule("r1", s={**shared}, f={"q": "bad"}, condition="s and not f"), rule("r2", s=shared, t=own, condition="s and t"), rule("r3", k=["needle"], condition="k")]
    reuse = assessment.atom_reuse(rs)
    d = lambda i, e: assessment.diagnose(rs[i], e, reuse)
    assert d(0, {"a": "1"}) == "fires"
    assert d(0, {"a": "1", "q": "bad"}) == "filter-excluded"
    assert d(0, {"a": "2"}) == "variant-miss"
    assert d(0, {"n": "1"}) == "wrong-channel"
    assert d(1, {"a": "1", "z": "8"}) == "unvouched-miss"
    assert d(1, {"a": "1"}) == "field-absent-gap"
    assert d(2, {"a": "hay"}) == "keyword-miss"
    assert assessment.diagnose(rule("r4", s={"a": "1"}, condition="s and not s"), {"a": "1"}, reuse) == "filter-excluded"


def test_fidelity_and_admission(spark):
    hits = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1), ("r2", 9)], "rule_id string, id int")
    labels = spark.createDataFrame([(1, True), (2, True), (9, False)], "id int, positive boolean")
    got = {r["rule_id"]: r["coverage"] for r in assessment.fidelity(hits, labels, "id", ["r1", "r2", "r3"]).collect()}
    assert got == {"r1": "true", "r2": "both", "r3": "false"}
    a, c = rule("r1", s={"a": "1"}, condition="s"), rule("r2", s={"a": "1", "b": "2"}, condition="s")
    out = assessment.admit(a, [c], hits, labels.where("positive"), "id")
    assert out == {"relations": {"r2": "subsumes"}, "coverage": "true", "novel": 1, "neighbour_only": 0, "admit": True}
    assert not assessment.admit(a, [a], hits, labels.where("positive"), "id")["admit"]


def test_registry(spark):
    reg = Registry()

    @reg.add("count", "T1", "access", {"user"})
    def count(events):
        return events.groupBy("user").agg(F.count("*").alias("n"))

    reg.add("other", "T2", "impact", {"nothing"})(lambda e: e)
    found, skipped = reg.run(spark.createDataFrame([("u",), ("u",)], "user string"))
    assert skipped == ["other"] and found["count"].first()["n"] == 2
    t = spark.createDataFrame([("access", "impact", 0.7), ("access", "exfil", 0.3), ("impact", "x", 1.0)], "from string, to string, p double")
    assert {(r["to"], r["covered"]) for r in reg.frontier(["count"], t).collect()} == {("impact", True), ("exfil", False)}


def test_store_and_report(spark, tmp_path):
    import json

    import pytest

    from tracewarden.plans import lineage as li
    from tracewarden.plans import store

    root = li.derive("store-test", lambda x: x, [li.source(b"e", evidence=True)])
    v = li.assemble(root, "T1", {root.id: li.Confidence.detector(True, 0.9, 0.01)}, {}, attestations=None)
    path = str(tmp_path / "v")
    store.save_verdicts(spark.createDataFrame([store.verdict_row(v), ("x", "{}")], "cid string, record string"), path, "run1")
    assert store.load_verdict(spark, path, root.id) == json.loads(json.dumps(v.contract()))
    assert store.load_verdicts(spark, path, "run1").where("intact").count() == 2
    assert "decision: true" in store.report(v.contract()) and "->" in store.dot(root)
    spark.createDataFrame([("y", "{}", "bad")], "cid string, record string, digest string").write.parquet(path + "/tag=run2")
    with pytest.raises(store.DigestMismatch):
        store.load_verdict(spark, path, "y")
    a, c = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert {tuple(r) for r in store.diff(a, c).collect()} == {(1, "removed"), (3, "added")}


def test_permutation_null(spark):
    from tracewarden.operators import detectors as d

    rows = [(h, t) for h in ("p", "q") for t in range(0, 200, 10)] + [("r", t) for t in range(3, 200, 13)] + [("r", 199), ("p", 7)]
    act = spark.createDataFrame(rows, "entity string, bin long")
    got = {(r["a"], r["b"]): r["p_value"] for r in d.coordination_null(act, d.coordination(act)).collect()}
    assert got[("p", "q")] == 1 / 200 and all(p > 0.01 for k, p in got.items() if "r" in k)
