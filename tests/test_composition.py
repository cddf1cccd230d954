"""Composition, coverage, synthetic data and window sizes against small brute-force versions."""

import glob
import itertools
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.functions import belnap as b
from tracewarden.operators import compose, coverage, detectors, structural
from tracewarden.operators import signal as g
from tracewarden.plans import lineage
from tracewarden.sources import synthetic as y


@pytest.fixture(scope="module")
def org(spark):
    return y.organisation(spark, users=30, workstations=10)


@pytest.fixture(scope="module")
def acts(org):
    return y.timeline(org, days=3, roasters=3, variants=("rubeus", "setspn", "aes"), forgeries=True).cache()


def test_timeline_has_what_it_says(acts, org):
    d = acts.toPandas()
    assert d.equals(acts.toPandas())  # nothing is drawn anew
    roast = d[d.label.fillna("").str.startswith("roast:")]
    for label, own in roast.groupby("label"):
        asks = own[own.action == "request_ticket"]
        assert len(asks) == asks.target.nunique() == 10
        late = own[own.action == "logon"].iloc[0]
        assert late.t > asks.t.max() and late.actor.startswith("sa") and late.src == asks.src.iloc[0]
        assert (own.action == "process_create").sum() == 1, label
    weak = roast[roast.action == "request_ticket"].groupby("label").enc.apply(lambda e: (e == y.RC4).sum())
    assert sorted(weak) == [0, 1, 10]
    benign = d[d.label.isna()]
    assert (benign.action == "authenticate").sum() == 90
    asks = benign[benign.action == "request_ticket"]
    assert set(asks.tgt) <= set(benign[benign.action == "authenticate"].tgt)
    goals = {r.host for r in org["hosts"].where("sensitive").collect()}
    assert set(benign[benign.logon_type == "3"].dst) <= goals


def test_forgeries_are_found_and_nothing_else(acts, org):
    e = y.log_events(acts, org, ticket_hashes=True)
    m = F.col("fields")
    issued = e.where(m["EventID"] == "4768").select(m["ResponseTicketHash"].alias("hash"), m["TargetUserName"].alias("account"), m["IpAddress"].alias("ip"), F.col("t").alias("seq"))
    shown = e.where(m["EventID"] == "4769").select(m["ResponseTicketHash"].alias("id"), m["RequestTicketHash"].alias("hash"), m["TargetUserName"].alias("account"), m["IpAddress"].alias("ip"), "label")
    got = structural.ticket_tiers(issued, shown.drop("label")).join(shown.select("id", "label"), "id")
    assert sorted((r.tier, r.label.split(":")[0]) for r in got.collect()) == [("golden", "golden"), ("golden", "golden"), ("pass-the-ticket", "ptt")]
    bare = y.log_events(acts, org).where(F.map_contains_key("fields", "RequestTicketHash"))
    assert bare.isEmpty()


def test_logs_read_back(spark, acts, org, tmp_path):
    e = y.log_events(acts, org)
    y.write_logs(e, str(tmp_path / "logs"))
    lines = [x for p in glob.glob(f"{tmp_path}/logs/**/part-*", recursive=True) for x in open(p)]
    assert len(lines) == e.count()
    assert os.path.isdir(f"{tmp_path}/logs/host=dc00000/channel=Security")
    odd = spark.createDataFrame([(0.0, "h", "Security", {"EventID": "1", "CommandLine": "a <b> & 'c'"}, None)], "t double, host string, channel string, fields map<string,string>, label string")
    assert "<Data Name='CommandLine'>a &lt;b> &amp; &apos;c&apos;</Data>" in y.event_xml(odd).first().value


def test_separability(acts, org):
    e = y.log_events(acts, org)
    r = y.separability(e, org["hosts"].where("sensitive")).first()
    assert r.attack_ips >= 3 and r.benign_flagged > 0  # correlation alone raises false alarms
    ips = {r.account: r.ips for r in y.origins(e).collect()}
    assert len(ips["user00002"]) == 1
    none = y.separability(e.where("false"), org["hosts"]).first()
    assert (none.attack_ips, none.flagged_ips, none.benign_flagged) == (0, 0, 0)


def test_beacons_hide_in_rates_and_show_in_pairs(spark):
    hosts = spark.range(30).select(F.col("id").alias("host"), (F.col("id") < 4).alias("compromised"))
    d = y.beacons(hosts, 400, 0.2, 0.15, 60.0)
    n = {r.host: r.n for r in d.groupBy("host").agg(F.count("*").alias("n")).collect()}
    assert all(50 < n[h] < 110 for h in range(30))
    pairs = detectors.coordination(detectors.activity(d, "host", F.col("t"), 60.0), least=0.05)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, c) for a in range(4) for c in range(a + 1, 4)}
    with pytest.raises(ValueError):
        y.beacons(hosts, 10, 0.1, 0.1, 1.0)


def test_coordinated_tests_every_pair(spark):
    rng = np.random.default_rng(11)
    beat = rng.random(120) < 0.3
    rows = {h: (rng.random(120) < 0.25) | (beat if h < 5 else False) for h in range(40)}
    d = spark.createDataFrame([(h, t) for h, x in rows.items() for t in [*np.flatnonzero(x).tolist()]], "entity int, bin long")
    w = max(int(np.flatnonzero(x)[-1]) for x in rows.values()) - min(int(np.flatnonzero(x)[0]) for x in rows.values()) + 1

    def information(k, a, c):
        cells = [k, a - k, c - k, w - a - c + k]
        return sum(n / w * math.log2(n * w / (r * s)) for n, r, s in zip(cells, (a, a, w - a, w - a), (c, w - c, c, w - c), strict=True) if n)

    p = {}
    for a, c in itertools.combinations(rows, 2):
        na, nb, k = int(rows[a].sum()), int(rows[c].sum()), int((rows[a] & rows[c]).sum())
        mass = {j: math.comb(na, j) * math.comb(w - na, nb - j) / math.comb(w, nb) for j in range(max(0, na + nb - w), min(na, nb) + 1)}
        p[a, c] = sum(m for j, m in mass.items() if information(j, na, nb) >= information(k, na, nb) - 1e-9)
    ranked = sorted(p, key=p.get)
    last = max((i for i, x in enumerate(ranked, 1) if p[x] <= 0.05 * i / len(p)), default=0)
    got = {(r.a, r.b): r.p_value for r in detectors.coordinated(d, 0.05).collect()}
    assert set(got) == set(ranked[:last]) and set(itertools.combinations(range(5), 2)) <= set(got)
    assert all(got[x] == pytest.approx(p[x], rel=1e-6) for x in got)
    chosen = {(r.a, r.b) for r in detectors.coordination(d, least=0.05).collect()}
    assert len(chosen - set(got)) > 0  # what a bound alone lets through, the test turns down
    assert detectors.coordinated(d.where("entity > 4"), 0.001).isEmpty() and detectors.coordinated(d.where("false")).isEmpty()


def test_sessions(spark):
    requests = spark.range(6).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("client"), F.lit("s").alias("spn"), F.lit("ip").alias("ip"), (F.col("id") * 5).alias("clock"))
    forged = spark.createDataFrame([("admin", "s", "ip", 3)], requests.schema)
    x = y.sessions(requests, "k", spark.createDataFrame([("s", "key")], "spn string, key string"), forged, forged)
    found = structural.ledger_classes(x["presented"].select("id", "hash", "ip"), x["issues"].select("hash", "ip", "seq"))
    assert Counter(r.outcome for r in found.collect()) == {"CONFIRMED": 13, "GAP": 2}  # silver, and golden's ticket itself
    keys = spark.createDataFrame([("s", "other")], "target string, key string")
    assert y.valid(y.issue(requests.withColumn("target", F.col("spn")), spark.createDataFrame([("s", "key")], "target string, key string"), "SERVICE"), keys).isEmpty()


def test_signature_against_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(6)) or None, int(rng.integers(12)) or None, bool(rng.integers(2))) for _ in range(150)]
    strong, every = defaultdict(set), defaultdict(set)
    for k, v, s in rows:
        if k and v:
            every[k].add(v)
            strong[k] |= {v} if s else set()
    want = {k: b.TRUE if len(strong[k]) >= 9 else b.FALSE if len(every[k]) >= 10 else b.NONE for k in every}
    d = spark.createDataFrame(rows, "k int, v int, s boolean")
    assert {r.k: r.signature for r in compose.signature(d, "k", "v", F.col("s"), 9, 10).collect()} == want
    assert compose.signature(d.where("false"), "k", "v", F.col("s"), 1).isEmpty()


def test_hex_bits(spark):
    d = spark.createDataFrame([("0x1010",), ("0x20",), ("16",), (None,), ("0xzz",), ("0X10",), ("0x" + "f" * 30,)], "m string")
    assert [r[0] for r in d.select(compose.hex_bits(F.col("m"), 0x10)).collect()] == [True, False, False, False, False, True, False]


def test_spans_against_loops(spark):
    rng = np.random.default_rng(5)
    e = [(int(rng.integers(3)), float(t)) for t in rng.uniform(0, 100, 60)] + [(1, 20.0), (1, 30.0)]
    s = [(int(k), float(a), float(a + w)) for k, a, w in zip(rng.integers(0, 3, 8), rng.uniform(0, 90, 8), rng.uniform(0, 40, 8))] + [(1, 20.0, 30.0), (2, 5.0, 5.0)]
    got = compose.span_events(spark.createDataFrame(e, "who int, t double"), "who", "t", spark.createDataFrame(s, "entity int, t0 double, t1 double"), 7.0)
    want = [(k, t, a, z) for k, t in e for q, a, z in s if k == q and a <= t < z]
    assert sorted((r.who, r.t, r.t0, r.t1) for r in got.collect()) == sorted(want)


def test_chain_hypotheses(spark):
    seen = spark.createDataFrame([(1, ["b"]), (2, ["a", "c"]), (3, []), (4, ["x"])], "id int, stages array<string>")
    moves = spark.createDataFrame([("b", "c", 0.25), ("c", "z", 1.0)], "from string, to string, p double")
    got = {r.id: (r.deepest, r.frontier, r.frontier_p, list(r.gaps)) for r in compose.chain_hypotheses(seen, ["a", "b", "c"], moves).collect()}
    assert got == {1: ("b", "c", 0.25, ["a"]), 2: ("c", None, None, ["b"]), 3: (None, "a", None, []), 4: (None, "a", None, [])}


def test_carriers(spark):
    d = spark.createDataFrame([("CONFIRMED",), ("REFUTED",), ("GAP",), ("NONE",), ("?",)], "c string")
    assert [r[0] for r in d.select(compose.carrier_code(F.col("c"))).collect()] == [b.TRUE, b.FALSE, b.TRUE, b.NONE, None]
    t = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert [tuple(r) for r in t.select(compose.carrier_of_check(F.col("x")), compose.carrier_of_subsumption(F.col("x"))).collect()] == [("CONFIRMED", "CONFIRMED"), ("REFUTED", "NONE"), ("NONE", "NONE")]


def test_verdict_axes(spark):
    d = spark.createDataFrame([(1, 1, 2, "u", None), (2, 2, 1, "", "h"), (3, None, 1, None, None)], "id int, t0 int, t1 int, who string, place string")
    got = {r.id: (r.decision, r.w_score) for r in lineage.pattern_verdicts(d, "T", "x", ["t0", "t1"], ["who"], ["place"]).collect()}
    assert got == {1: ("true", 0.8), 2: ("true", 0.6), 3: ("true", 0.4)}


def test_signature_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(compose, "PART", 100)
    d = spark.range(2000).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    got = compose.signature(d, "k", "v", F.col("v") < 1000, least=50)
    assert "RepartitionByExpression [k" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ", 21" in plan
    assert {r.signature for r in got.collect()} == {b.TRUE}


def test_verdict_of_a_p_value_rounded_to_nothing(spark):
    d = spark.createDataFrame([(1, 0.0, 3.0, True), (2, 0.5, 12.0, False), (3, 0.09, 3.0, True)], "id int, p_value double, hour double, flagged boolean")
    got = {r.id: (r.score, r.decision, r.cross_check) for r in lineage.offhours_verdicts(d, "T", "x").collect()}
    assert got == {1: (1.0, "true", "true"), 2: (0.0, "none", "false"), 3: (pytest.approx(1 / 1.1), "true", "true")}


def test_behaviour_against_structure(spark):
    rng = np.random.default_rng(9)
    catch = {f"r{i}": frozenset(int(x) for x in rng.integers(0, 5, rng.integers(1, 4))) for i in range(25)}
    content = {r: frozenset(str(x) for x in rng.integers(0, 4, rng.integers(0, 3))) for r in catch}
    want = Counter()
    for r in catch:
        for s in catch:
            if r < s:
                x, z = content[r], content[s]
                shape = "none" if not x & z else "exact" if x == z else "nested" if x <= z or z <= x else "related"
                want["co-catch" if catch[r] == catch[s] else "overlap" if catch[r] & catch[s] else "disjoint", shape] += 1
    hits = spark.createDataFrame([(r, e) for r, s in catch.items() for e in s], "rule_id string, e int")
    tokens = spark.createDataFrame([(r, t) for r, s in content.items() for t in s], "rule_id string, token string")
    got = coverage.behaviour_against_structure(hits, tokens, "e")
    assert {(r.behaviour, r.structure): r.pairs for r in got.collect()} == want
    assert coverage.behaviour_against_structure(hits.where("false"), tokens, "e").isEmpty()


def test_behaviour_makes_no_row_of_a_pair(spark, monkeypatch):
    made = []
    monkeypatch.setattr(coverage, "cut", lambda d: made.append(d.count()) or d)
    hits = spark.createDataFrame([(f"r{i:02}", e) for i in range(70) for e in (-1, i)], "rule_id string, e int")
    tokens = spark.createDataFrame([(f"r{i:02}", t) for i in range(70) for t in ("all", f"t{i % 2}")], "rule_id string, token string")
    got = {tuple(r) for r in coverage.behaviour_against_structure(hits, tokens, "e").collect()}
    assert got == {("overlap", "exact", 35 * 34), ("overlap", "related", 35 * 35)}
    assert max(made) <= 140  # as many as hits


def test_coverage_changes_and_selectors(spark):
    old = spark.createDataFrame([("a", "witness"), ("b", "gap"), ("c", "gap")], "rule_id string, role string")
    new = spark.createDataFrame([("a", "witness"), ("b", "witness"), ("d", "gap")], "rule_id string, role string")
    assert sorted(tuple(r) for r in coverage.coverage_changes(old, new).collect()) == [("b", "gap", "witness"), ("c", "gap", None), ("d", None, "gap")]
    tactics = spark.createDataFrame([("T1", "execution"), ("T2", "initial-access"), ("T2", "execution"), ("T3", "impact")], "technique string, tactic string")
    names = lambda d: sorted(r.technique for r in d.collect())
    assert names(coverage.techniques_in(tactics, tactic="execution")) == ["T1", "T2"]
    assert names(coverage.techniques_in(tactics, phase="delivery")) == ["T2"]
    assert names(coverage.techniques_in(tactics, stage="out")) == ["T3"]
    assert names(coverage.techniques_in(tactics, phase="pivoting")) == []


def test_mi_null_keeps_the_bias(spark):
    rng = np.random.default_rng(1)
    x, z = rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    d = spark.createDataFrame([("s", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, z))], "series_id string, idx long, x double, y double")

    def mi(p, q):
        h = lambda v: -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())
        return max(0.0, h(list(p)) + h(list(q)) - h(list(zip(p, q))))

    draws = np.random.default_rng(7)
    codes = np.unique(z, return_inverse=True)[1]
    want = [mi(x[i : i + 20], s[i : i + 20]) for s in (draws.permutation(codes) for _ in range(5)) for i in range(0, 41, 10)]
    got = g.mi_null(d, 20, 10, permutations=5).orderBy("permutation", "window").toPandas()
    assert np.allclose(got.mi, want, atol=1e-9)
    seen = g.sliding_mi(d, 20, 10).orderBy("window").toPandas()
    assert np.allclose(seen.mi, [mi(x[i : i + 20], z[i : i + 20]) for i in range(0, 41, 10)], atol=1e-9)
    assert g.mi_null(d.where("idx < 5"), 20).isEmpty()


def test_scales():
    assert g.divisors(12) == [1, 2, 3, 4, 6, 12] and g.divisors(1) == [1] and g.divisors(49) == [1, 7, 49]
    assert g.prime_factors(360) == {2, 3, 5} and g.prime_factors(1) == set()
    assert g.neighbours(4, 12) == [2, 12] and g.neighbours(1, 12) == [2, 3]
    assert g.scales(12, 4, 0) == {4: 0} and g.scales(12, 4, 2) == {4: 0, 2: 1, 12: 1, 1: 2, 6: 2}
    for bad in (lambda: g.divisors(0), lambda: g.neighbours(5, 12)):
        with pytest.raises(ValueError):
            bad()


def test_drift_edges(spark):
    d = spark.createDataFrame([("few", i, 1.0) for i in range(5)] + [("shift", i, float(i >= 50) * 9 + i % 7) for i in range(100)] + [("same", i, float(i % 7)) for i in range(98)] + [("nan", 0, float("nan"))], "k string, i int, s double")
    got = {r.k: r.verdict for r in detectors.drift(d, "i", "s", ["k"]).collect()}
    assert got == {"few": "none", "shift": "false", "same": "true"}
