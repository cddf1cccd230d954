"""Closed-form, exhaustive and brute-force checks of the detectors, rules, logic, lineage and signal kernels."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewarden.functions import belnap as b
from tracewarden.functions import cid, stats
from tracewarden.operators import corpus, detectors, fca, graph, rules, signal, structural
from tracewarden.plans import lineage

# ---------------------------------------------------------------- rules

#: (rule's clause, field value, expected)
LANDMINES = [
    ({"f": "ABC"}, "abc", True),
    ({"f": "É"}, "é", False),
    ({"f": "RENÉ"}, "renÉ", True),
    ({"f": "a*c"}, "aXXc", True),
    ({"f": "a.c"}, "abc", False),
    ({"f": "a\\*c"}, "a*c", True),
    ({"f": "a\\*c"}, "abc", False),
    ({"f|contains": "x"}, None, False),
    ({"f|contains": ""}, None, True),
    ({"f": ""}, None, True),
    ({"f": "true"}, True, True),
    ({"f": 4624}, "4624", True),
    ({"f|contains": "ñ"}, "mañana", True),
    ({"f|endswith": "\\cmd.exe"}, "C:\\Windows\\CMD.exe", True),
    ({"f|startswith": "c:\\\\x"}, "C:\\x\\y", True),
    ({"f": "a?c"}, "a\nc", True),
    ({"f|contains|all": ["a", "b"]}, "xbxa", True),
    ({"f|contains|all": ["a", "b"]}, "xbx", False),
    ({"f": []}, "a", False),
    ({"f|all": []}, "a", True),
    ({"f|re": "^A"}, "abc", False),
    ({"f|re|i": "^A"}, "abc", True),
    ({"f|re": "(unclosed"}, "(unclosed", False),
    ({"f|re": "(?P<n>a)b"}, "xab", True),
    ({"f|re": "\\wé"}, "éé", True),
    ({"f|cidr": "10.0.0.0/8"}, "10.2.3.4", True),
    ({"f|cidr": "10.0.0.0/8"}, "11.2.3.4", False),
    ({"f|cidr": "10.0.0.0/8"}, "not an address", False),
    ({"f|cidr": "2001:db8::/32"}, "2001:DB8::1", True),
    ({"f|cidr": "2001:db8::/32"}, "2001:db9::1", False),
    ({"f|cidr": "nonsense"}, "10.0.0.1", False),
    ({"f|gte": "5"}, "5.0", True),
    ({"f|gt": "5"}, "5", False),
    ({"f|lt": "5"}, "abc", False),
    ({"f|lt": "5"}, "nan", False),
    ({"f|gt": "x"}, "7", False),
    ({"f|windash|contains": " -enc"}, "x –enc y", True),
    ({"f|windash|contains": " -enc"}, "x /ENC y", True),
]


def one(detection):
    return rules.compile_rule({"id": "r", "detection": {**detection, "condition": detection.get("condition", "sel")}})


@pytest.mark.parametrize("clause, value, want", LANDMINES)
def test_landmines_in_python(clause, value, want):
    assert rules.matches(one({"sel": clause}), {} if value is None else {"f": value}) is want


def test_landmines_in_columns(spark):
    rows = [(i, None if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for i, (_, v, _) in enumerate(LANDMINES)]
    d = spark.createDataFrame(rows, "i int, f string")
    access, values = rules.column_access({"f": "f"})
    cols = [rules.rule_column(one({"sel": c}), lambda a: rules.atom_column(a, access, values)).alias(f"r{i}") for i, (c, _, _) in enumerate(LANDMINES)]
    got = d.select("i", *cols).collect()
    assert [r[f"r{r['i']}"] for r in sorted(got)] == [w for _, _, w in LANDMINES]


CONDITIONS = ["a and b or not c", "not (a or b) and c", "1 of s*", "all of s*", "all of zz*", "2 of them", "0 of them", "9 of them", "a and missing", "not missing", "all of them or a", "not not a"]


@pytest.mark.parametrize("text", CONDITIONS)
def test_conditions_agree_between_engines(spark, text):
    names = ["a", "b", "c", "s1", "s2"]
    rule = one({**{n: {n: "1"} for n in names}, "condition": text})
    rows = [tuple(str(x) for x in bits) for bits in itertools.product((0, 1), repeat=5)]
    d = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    access, values = rules.column_access({n: n for n in names})
    out = d.select("*", rules.rule_column(rule, lambda a: rules.atom_column(a, access, values)).alias("hit")).collect()
    assert all(r["hit"] == rules.matches(rule, {n: r[n] for n in names}) for r in out)


@pytest.mark.parametrize("text", ["", "a and", "(a", "a b", "1 of", "or a", "a)", "1 of ("])
def test_bad_conditions(text):
    assert not rules.condition_parses(text)


def test_fire_twice_gives_the_same(spark):
    d = spark.createDataFrame([(1, {"x": "Alpha", "y": "7"}), (2, {"x": "beta"}), (3, {})], "id int, fields map<string,string>")
    raw = [{"id": "k", "detection": {"kw": ["ALP"], "condition": "kw"}}, {"id": "n", "detection": {"s": {"y|lt": 9}, "condition": "not s"}}]
    compiled = [rules.compile_rule(r) for r in raw]
    for engine in (rules.fire, rules.fire_direct):
        got = sorted(tuple(r) for r in engine(d, compiled, ["id"], *rules.map_access()).collect())
        assert got == [(1, "k"), (2, "n"), (3, "n")]


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?\\.", max_size=6), st.text("ab.*", max_size=6))
def test_globs_against_a_plain_matcher(pattern, text):
    def glob(p, s):
        if not p:
            return not s
        head = p[0]
        if head is ...:
            return any(glob(p[1:], s[i:]) for i in range(len(s) + 1))
        if head is None:
            return bool(s) and glob(p[1:], s[1:])
        return s.startswith(head) and glob(p[1:], s[len(head) :])

    assert rules.matches(one({"sel": {"f": pattern}}), {"f": text}) == glob(rules.pattern_pieces(pattern), text)


def test_implication_respects_strict_bounds():
    c = lambda mods, v, f="x": rules.Clause(f, (mods,) if mods else (), (v,))
    assert rules.implies(c("gt", "5"), c("gte", "5")) and not rules.implies(c("gte", "5"), c("gt", "5"))
    assert rules.implies(c("", "abc"), c("contains", "B")) and rules.implies(c("startswith", "abc"), c("startswith", "ab"))
    assert not rules.implies(c("contains", "abc"), c("startswith", "ab")) and not rules.implies(c("", "a*"), c("contains", "a"))
    assert rules.excludes(c("", "a"), c("", "b")) and not rules.excludes(c("", "a"), c("", "A"))
    r = rules.atom_relations([c("", "abc"), c("contains", "b"), c("", "xyz")])
    assert r == {"implications": [(0, 1)], "exclusions": [(0, 2)], "generators": [0, 2]}


def test_evaluability_reasons():
    from tracewarden.plans.rule_queries import AUDIT_RULES

    got = {r["id"]: rules.evaluability(r)[1] for r in AUDIT_RULES if r["id"].startswith("x")}
    assert list(got.values()) == ["correlation", "no-detection", "no-condition", "aggregation", "no-blocks", "nested-selection", "unsupported-modifier", "unsupported-block", "condition-unsupported"]


# ---------------------------------------------------------------- four values


def test_belnap_laws():
    v = range(4)
    for x, y, z in itertools.product(v, v, v):
        for op in (b.k_join, b.k_meet, b.t_join, b.t_meet):
            assert op(x, y) == op(y, x) and op(x, x) == x and op(op(x, y), z) == op(x, op(y, z))
        assert b.negate(b.t_join(x, y)) == b.t_meet(b.negate(x), b.negate(y))
        assert b.k_join(x, b.k_meet(x, y)) == x and b.t_join(x, b.t_meet(x, y)) == x
    assert b.k_monotone(b.t_meet, 2) and b.k_monotone(b.negate, 1) and not b.k_monotone(lambda x: int(x == b.NONE), 1)


def test_belnap_columns(spark):
    d = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x int, y int")
    cols = {"kj": b.col_k_join, "km": b.col_k_meet, "tj": b.col_t_join, "tm": b.col_t_meet}
    for r in d.select("x", "y", b.col_negate(F.col("x")).alias("n"), *[f(F.col("x"), F.col("y")).alias(k) for k, f in cols.items()]).collect():
        assert r["n"] == b.negate(r["x"])
        assert [r[k] for k in cols] == [f(r["x"], r["y"]) for f in (b.k_join, b.k_meet, b.t_join, b.t_meet)]
    g = d.groupBy("x").agg(b.agg_t_meet(F.col("y")).alias("m"), b.agg_t_join(F.col("y")).alias("j")).collect()
    assert {(r["m"], r["j"]) for r in g} == {(b.FALSE, b.TRUE)}


# ---------------------------------------------------------------- statistics


def test_entropy_and_concentration(spark):
    d = spark.createDataFrame([(1, [1, 1, 1, 1]), (2, [5]), (3, []), (4, [0, 3, 3])], "i int, c array<long>")
    got = {r["i"]: (r["h"], r["q"]) for r in d.select("i", stats.entropy_of_counts(F.col("c")).alias("h"), stats.herfindahl_of_counts(F.col("c")).alias("q")).collect()}
    assert got == {1: (2.0, 0.25), 2: (0.0, 1.0), 3: (0.0, 0.0), 4: (1.0, 0.5)}


@pytest.mark.parametrize("tail", ["upper", "lower"])
def test_conformal_against_its_definition(spark, tail):
    rng = np.random.default_rng(1)
    cal, ask = rng.integers(0, 20, 60).tolist(), rng.integers(-3, 24, 40).tolist()
    c = spark.createDataFrame([(float(x),) for x in cal], "s double")
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(ask)] + [(99, float("nan")), (98, None)], "i int, s double")
    got = {r["i"]: r["p_value"] for r in detectors.conformal(d, "s", c, tail).collect()}
    for i, x in enumerate(ask):
        n = sum(y >= x if tail == "upper" else y <= x for y in cal)
        assert got[i] == pytest.approx((1 + n) / 61)
    assert math.isnan(got[99]) and math.isnan(got[98])
    assert detectors.conformal_bound(19, 0.05) == 0.05


@pytest.mark.parametrize("method", ["bh", "by"])
def test_fdr_against_its_definition(spark, method):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34, 0.041]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(50, float("nan"))], "i int, p double")
    got = {r["i"]: r["q_value"] for r in detectors.fdr(d, "p", 0.05, method).collect()}
    m = len(p)
    c = 1 if method == "bh" else sum(1 / k for k in range(1, m + 1))
    order = sorted(range(m), key=lambda i: p[i])
    run, want = 1.0, {}
    for rank in range(m, 0, -1):
        run = min(run, m * c / rank * p[order[rank - 1]])
        want[order[rank - 1]] = min(1.0, run)
    assert all(got[i] == pytest.approx(want[i]) for i in range(m)) and math.isnan(got[50])


def test_fanout_finds_the_sprayer(spark):
    rows = [(float(t * 600 + i), f"n{i}", "v") for t in range(50) for i in range(5)] + [(100.0 + k, "spray", f"acct{k}") for k in range(30)]
    d = spark.createDataFrame(rows, "t double, e string, v string")
    got = detectors.fanout_detect(d, "e", "v", F.col("t"), 600, alpha=0.01).where("flagged").collect()
    assert [(r["entity"], r["bin"], r["distinct_values"]) for r in got] == [("spray", 0, 30)]
    with pytest.raises(ValueError):
        detectors.time_bin(F.col("t"), 0)


def test_negative_times_are_floored(spark):
    assert spark.createDataFrame([(-1.0,)], "t double").select(detectors.time_bin(F.col("t"), 10)).first()[0] == -1


def test_coordination_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    act = {h: sorted(set(rng.integers(0, 40, 15).tolist()) | {0, 39}) for h in "abcd"}
    d = spark.createDataFrame([(h, t) for h, ts in act.items() for t in ts], "entity string, bin long")
    for r in detectors.coordination(d).collect():
        x, y = (np.isin(np.arange(40), act[r[k]]).astype(int) for k in ("a", "b"))
        h = lambda *v: -sum(p * math.log2(p) for p in np.unique(np.stack(v), axis=1, return_counts=True)[1] / 40)
        assert r["mi"] == pytest.approx(max(0, h(x) + h(y) - h(x, y)), abs=1e-9)
        assert r["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_circular_mean_wraps(spark):
    m = stats.circular(F.col("h"), 24.0)
    r = spark.createDataFrame([(23.0,), (1.0,)], "h double").agg(m["mean"].alias("m"), m["resultant"].alias("r")).first()
    assert min(r["m"], 24 - r["m"]) < 1e-9 and r["r"] == pytest.approx(math.cos(math.pi / 12))


def test_ks_and_chi2():
    rng = np.random.default_rng(0)
    assert stats.ks_two_sample(rng.normal(size=200), rng.normal(size=200))[1] > 0.05
    assert stats.ks_two_sample(rng.normal(size=200), rng.normal(1, 1, 200))[1] < 1e-6
    assert stats.chi2_quantile(0.05, 10) == pytest.approx(18.307038, abs=1e-5)
    assert stats.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


# ---------------------------------------------------------------- structure and graphs


def test_chain_reports_order_and_stand_alone_truth(spark):
    rows = [("a", 1.0, "x"), ("a", 2.0, "y"), ("a", 2.0, "z"), ("b", 5.0, "x"), ("b", 3.0, "y"), ("b", 9.0, "z"), (None, 1.0, "x")]
    d = spark.createDataFrame(rows, "who string, t double, k string")
    got = {r["actor"]: r for r in structural.chain(d, "who", "t", [(k, F.col("k") == k) for k in "xyz"]).collect()}
    assert got["a"]["complete"] and got["a"]["stages_met"] == 3
    assert not got["b"]["complete"] and got["b"]["stages_met"] == 1 and got["b"]["y"] == 3.0


def test_gap_without_channel_is_none(spark):
    a = spark.createDataFrame([("k1",), ("k2",), (None,)], "k string")
    e = spark.createDataFrame([("k1",)], "k string")
    got = lambda ch: {r["k"]: r["outcome"] for r in structural.gap_classify(a, e, "k", ch).collect()}
    assert got(e) == {"k1": "CONFIRMED", "k2": "GAP"} and got(e.limit(0)) == {"k1": "CONFIRMED", "k2": "NONE"}


def test_ticket_tiers(spark):
    issued = spark.createDataFrame([("h1", "u", "ip1", 1), ("h1", "u", "ip2", 2), (None, "v", "ip3", 3)], "hash string, account string, ip string, seq int")
    shown = spark.createDataFrame([(1, "h1", "u", "ip1"), (2, "h1", "u", "ip2"), (3, "hx", "u", "ip1"), (4, None, "v", "ip9"), (5, None, "ghost", "ip9")], "id int, hash string, account string, ip string")
    assert {r["id"]: r["tier"] for r in structural.ticket_tiers(issued, shown).collect()} == {2: "pass-the-ticket", 3: "golden", 5: "possible-golden"}


def test_completeness(spark):
    d = spark.createDataFrame([(1, ["a", "c"]), (2, []), (3, ["a", "b", "c"])], "i int, stages array<string>")
    got = {r["i"]: (r["coverage"], r["reach"], r["frontier"], r["gaps"]) for r in structural.completeness(d, ["a", "b", "c"]).collect()}
    assert got == {1: (0.6667, 1.0, None, ["b"]), 2: (0.0, 0.0, "a", []), 3: (1.0, 1.0, None, [])}


def test_closure_and_components_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {tuple(r) for r in graph.closure(e, spark.createDataFrame([("a",), ("x",)], "node string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}
    comp = graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert {tuple(r) for r in comp.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_counters(spark):
    sub, on, some = graph.SUBCLASS, graph.ON_PROPERTY, graph.SOME_VALUES
    t = [("T1.1", sub, "T1"), ("T1", sub, "_:r1"), ("_:r1", on, "accesses"), ("_:r1", some, "Memory"), ("Memory", sub, "Resource"), ("D1", sub, "Defence"), ("D1", sub, "_:r2"), ("_:r2", on, "analyses"), ("_:r2", some, "Resource"), ("D2", sub, "Defence"), ("D2", sub, "_:r3"), ("_:r3", on, "analyses"), ("_:r3", some, "Network")]
    d = spark.createDataFrame(t, "s string, p string, o string")
    got = graph.counters(d, spark.createDataFrame([("T1.1",)], "node string"), "Defence").collect()
    assert [tuple(r) for r in got] == [("T1.1", "D1", "Resource", "accesses", "analyses")]


def test_lattice_relations(spark):
    sets = {1: "a b", 2: "a b", 3: "a b c", 4: "c d", 5: "e"}
    d = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s.split()], "i int, t string")
    got = {(r["a"], r["b"]): r["rel"] for r in corpus.lattice_edges(d, "i", "t").collect()}
    assert got == {(1, 2): "exact", (1, 3): "broader", (3, 4): "related"}
    # relations of classes, told of all their members, are those of all pairs
    copies = {1: [1] + [b for (a, b), r in got.items() if r == "exact" and a == 1]}
    every = got | {(x, y): r for (a, b), r in got.items() if r != "exact" for x in copies.get(a, [a]) for y in copies.get(b, [b])}
    assert every == {(1, 2): "exact", (1, 3): "broader", (2, 3): "broader", (3, 4): "related"}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_tight_relations_are_all_found_on_rare_tokens(spark, least):
    rng = np.random.default_rng(4)
    rows = [(i, f"t{int(x)}") for i in range(80) for x in set(rng.zipf(1.4, 6) % 30)]
    d = spark.createDataFrame(rows, "i int, t string")
    full = {tuple(r) for r in corpus.lattice_edges(d, "i", "t").collect() if r["tightness"] >= least}
    assert full and full == {tuple(r) for r in corpus.lattice_edges(d, "i", "t", least=least).collect()}


def test_pairs_that_never_meet_are_coordinated(spark):
    rows = [(1, b) for b in range(0, 30, 2)] + [(2, b) for b in range(1, 30, 2)] + [(3, 0), (3, 29)]
    out = {(r["a"], r["b"]): (r["mi"], r["pearson"]) for r in detectors.coordination(spark.createDataFrame(rows, "entity int, bin long")).collect()}
    assert out[1, 2] == (1.0, -1.0) and set(out) == {(1, 2), (1, 3), (2, 3)}
    assert [(r["a"], r["b"]) for r in detectors.coordination(spark.createDataFrame(rows, "entity int, bin long"), least=0.5).collect()] == [(1, 2)]


def test_coordination_joins_no_bins(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(h, int(t)) for h in range(90) for t in set(rng.integers(0, 60, 25).tolist())], "entity int, bin long")
    pairs = detectors.coordination(d, digits=9)
    assert "bin" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # such a join makes a row of each shared bin
    got = {(r["a"], r["b"]): (r["mi"], r["pearson"]) for r in pairs.collect()}
    plain = detectors.coordination(d).select("a", "b", F.round("mi", 9).alias("mi"), F.round("pearson", 9).alias("pearson")).collect()
    assert got == {(r["a"], r["b"]): (r["mi"], r["pearson"]) for r in plain} and len(got) == len(plain) == 90 * 89 / 2
    assert all(a < b for a, b in got) and detectors.coordination(d.where("false")).collect() == []


def test_running_totals_by_ranges(spark):
    rng = np.random.default_rng(1)
    keys = sorted(set(rng.normal(size=500).round(3).tolist()))
    d = spark.createDataFrame([(k, int(n)) for k, n in zip(keys, rng.integers(0, 9, len(keys)), strict=True)], "k double, n long")
    got = {r["k"]: (r["up"], r["low"]) for r in detectors.running(detectors.running(d, "k", "n", "up"), "k", "n", "low", descending=True, agg=F.min).collect()}
    total, up = 0, {}
    for r in d.orderBy("k").collect():
        total += r["n"]
        up[r["k"]] = total
    n = dict(map(tuple, d.collect()))
    assert got == {k: (up[k], min(n[j] for j in keys if j >= k)) for k in keys}
    assert detectors.running(d.limit(0), "k", "n", "up").collect() == []


def test_rows_meet_their_levels_in_many_tasks(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 < 3, 0.5).when(F.col("id") % 8 == 3, F.col("id") / 1000.0).otherwise(F.when(F.col("id") % 16 == 7, float("nan"))).alias("k"))
    levels = rows.where("k IS NOT NULL AND NOT isnan(k)").groupBy("k").agg(F.count("*").alias("_n")).withColumn("_n2", F.col("_n") * 2)
    want = sorted(map(str, rows.join(levels.drop("_n"), "k", "left").collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for few in (0, 100_000):  # dealt out, and sent to all
            got = detectors.at_levels(rows, levels, "k", few)
            assert sorted(map(str, got.collect())) == want and got.columns == ["k", "id", "_n2"]
            assert got.where("k = 0.5").groupBy(F.spark_partition_id()).count().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fanout_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(detectors, "PART", 100)
    d = spark.range(2000).select((F.col("id") % 200).alias("e"), F.col("id").alias("v"), (F.col("id") % 7).cast("double").alias("t"))
    cells = detectors.fanout_cells(d, "e", "v", F.col("t"), 1.0)
    assert cells.rdd.getNumPartitions() == 21 and cells.agg(F.sum("n_events"), F.count("*")).first() == (2000, 1400)


def test_entropy_as_an_aggregate(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5), ("c", 0), ("c", None)], "g string, n long")
    got = {r["g"]: (r["h"], r["c"]) for r in d.groupBy("g").agg(stats.entropy(F.col("n")).alias("h"), stats.herfindahl(F.col("n")).alias("c")).collect()}
    assert got == {"a": (1.5, 0.375), "b": (0.0, 1.0), "c": (0.0, 0.0)}


def test_formal_concepts():
    rows = {"1": "ac", "2": "bc", "3": "abc"}
    ctx = fca.Context(tuple(rows), ("a", "b", "c"), tuple(sum(1 << (2 - "abc".index(x)) for x in s) for s in rows.values()))
    found = fca.concepts(ctx)
    assert {"".join(sorted(i)) for _, i in found} == {"c", "ac", "bc", "abc"}
    assert len(fca.covers(found)) == 4
    assert fca.implication_basis(ctx) == [(frozenset(), frozenset("c"))]


# ---------------------------------------------------------------- lineage


def test_cid_separates_numbers_and_ignores_key_order():
    assert cid.recipe_cid("op", {"a": 1, "b": 2}, []) == cid.recipe_cid("op", {"b": 2, "a": 1}, [])
    assert cid.recipe_cid("op", {"a": 1}, []) != cid.recipe_cid("op", {"a": 1.0}, [])
    assert cid.encode([None, True, -1, 500, "é", b"x", {"b": 1, "a": 2}]).hex() == "87f6f5201901f462c3a94178a2616102616201"
    assert cid.wrap(b"").startswith("bafyrei")
    with pytest.raises(ValueError):
        cid.encode(float("nan"))


def test_dag_computes_once_and_folds():
    calls = []

    def twice(x):
        calls.append(x)
        return 2 * x

    src = lineage.source(b"21", name=None, evidence=True)
    shared = lineage.derive("twice-test", lambda raw: twice(int(raw)), [src])
    root = lineage.derive("add-test", lambda p, q: p + q, [shared, shared])
    assert lineage.evaluate(root) == 84 and calls == [21]
    with pytest.raises(lineage.OperationChanged):
        lineage.derive("add-test", lambda p, q: p * q, [shared, shared])
    leaf = lineage.Confidence.detector(True, 0.9, 0.001)
    assert lineage.confidence(root, {shared.id: leaf})[root.id].log_odds == pytest.approx(2 * math.log(900))
    tiers = lineage.guarantee(root, {root.id: lineage.Tier.BOUNDED, shared.id: lineage.Tier.MACHINE_CHECKED}, {root.id: b.TRUE})
    assert tiers[root.id].tier == lineage.Tier.WELL_FORMED and tiers[shared.id].demotion
    assert lineage.custody(root, {src.id: lineage.Attestation(src.id)})[root.id] == b.TRUE
    assert lineage.custody(root, {src.id: lineage.Attestation("other")})[root.id] == b.FALSE
    v = lineage.assemble(root, "T1", {root.id: leaf}, {}, track_custody=False, check=b.FALSE).contract()
    assert v["decision"] == "true" and v["cross_check"] == "both" and "custody" not in v and v["w_record"]["score"] == 0.4


def test_custody_chain():
    s = lineage.CustodyStep
    good = [s("a", (), "1"), s("b", ("1",), "2")]
    assert lineage.localize(good, "2")["verdict"] == b.TRUE
    assert lineage.localize(good, "3") == {"verdict": b.FALSE, "exonerated": ["a"], "suspect": ["b"], "seam_break": 2}
    assert lineage.localize([good[0], s("b", ("9",), "2")], "2")["seam_break"] == 1


# ---------------------------------------------------------------- signal kernels


def test_filters_on_tones():
    fs, t = 100.0, np.arange(2000) / 100.0
    low, high = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 20 * t)
    for kind, cutoff, want in (("lowpass", 5.0, low), ("highpass", 10.0, high), ("bandpass", [15.0, 25.0], high)):
        y = signal.zero_phase(low + high, signal.butter_sections(4, cutoff, fs, kind))
        assert np.abs(y - want)[200:-200].max() < 0.01
    assert np.abs(signal.zero_phase(low + high, [signal.notch_section(20.0, 5.0, fs)]) - low)[300:-300].max() < 0.01
    amplitude, _ = signal.lock_in_kernel(3 * high, 20.0, 1.0, fs)
    assert amplitude[500:-500].mean() == pytest.approx(3, abs=1e-3)
    f, p = signal.welch_kernel(low, fs)
    assert f[p.argmax()] == pytest.approx(2, abs=fs / 256) and p.sum() * f[1] == pytest.approx(0.5, abs=0.02)


def test_cusum_and_arl():
    # in control without noise: with noise a false alarm is due every 465 samples or so (two sides of 938)
    x = np.concatenate((0.4 * (-1.0) ** np.arange(200), np.full(50, 3.0)))
    _, _, alarm = signal.cusum_kernel(x, 0.0, 1.0)
    assert not alarm[:200].any() and alarm[202] == 1 and not alarm[200:202].any()
    assert signal.cusum_arl(0.5, 5.0) == pytest.approx(938, rel=0.01)


def test_cfar_factors():
    assert signal.ca_alpha(16, 1e-3) == pytest.approx(16 * (1e-3 ** (-1 / 16) - 1))
    a = signal.os_alpha(16, 12, 1e-3)
    assert math.prod((16 - i) / (a + 16 - i) for i in range(12)) == pytest.approx(1e-3, rel=1e-6)


def test_viterbi():
    t = {"A": {"A": 0.9, "B": 0.1}, "B": {"A": 0.1, "B": 0.9}}
    e = {"A": {"x": 0.9, "y": 0.1}, "B": {"x": 0.1, "y": 0.9}}
    assert signal.viterbi(list("xxyyy"), t, e, {"A": 1.0}) == list("AABBB")
    assert signal.viterbi([], t, e, {"A": 1.0}) == []


def test_goertzel_and_blocks(spark):
    x = np.cos(2 * np.pi * 0.25 * np.arange(16))
    d = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, idx long, x double")
    assert [r["power"] for r in signal.goertzel(d, 0.25, 1.0, 8).orderBy("block").collect()] == pytest.approx([16.0] * 3)
    assert signal.blocks(d, 32).count() == 0


def test_keywords_do_not_reach_across_fields(spark):
    rule = rules.compile_rule({"id": "k", "detection": {"words": ["err*r"], "condition": "words"}})
    events = [{"a": "xerr", "b": "zr"}, {"a": "terror", "b": ""}, {"a": None, "b": "ERR or"}]
    d = spark.createDataFrame([(i, e) for i, e in enumerate(events)], "id long, fields map<string,string>")
    got = {r["id"] for r in rules.fire(d, [rule], ["id"], *rules.map_access()).collect()}
    assert got == {i for i, e in enumerate(events) if rules.matches(rule, e)} == {1, 2}


def test_fire_scans_once_whatever_the_number_of_rules(spark, monkeypatch):
    monkeypatch.setattr(rules, "CHUNK", 2)
    raw = [{"id": f"r{i}", "detection": {"s": {"a|contains": f"{i}"}, "condition": "s"}} for i in range(5)]
    raw += [{"id": "net", "detection": {"s": {"ip|cidr": "10.0.0.0/8"}, "condition": "s"}}, {"id": "dash", "detection": {"s": {"a|contains|windash": " -x"}, "condition": "s"}}]
    compiled = [rules.compile_rule(r) for r in raw]
    events = [{"a": "13", "ip": "10.2.3.4"}, {"a": "run /x 4", "ip": "11.0.0.1"}, {"a": "none", "ip": "10.0.0"}]
    d = spark.createDataFrame([(i, e) for i, e in enumerate(events)], "id long, fields map<string,string>")
    out = rules.fire(d, compiled, ["id"], *rules.map_access())
    assert sorted(map(tuple, out.collect())) == sorted((i, r.rule_id) for i, e in enumerate(events) for r in compiled if rules.matches(r, e))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") + out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
