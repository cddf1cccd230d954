"""Queries on verdicts, signatures, coverage and synthetic data, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions import belnap as b
from tracewarden.operators import compose as c
from tracewarden.operators import corpus, coverage, detectors, structural
from tracewarden.operators import signal as g
from tracewarden.sources import synthetic as y

from . import lineage, rule_queries
from .detector_queries import DAY, ORACLES as DETECTOR_ORACLES, fanout_conformal, fanout_supplier, offhours_conformal, table
from .signal_queries import _C, _S, _codes, _series, welch, ORACLES as SIGNAL_ORACLES
from .storage import cut
from .structure_queries import ORACLES as STRUCTURE_ORACLES

def _ev(spark, f):
    return table(spark, f, "events").select("event_id", "user_id", "event_type", "value", detectors.seconds("ts").alias("t"))


# ---------------------------------------------------------------- verdicts


def offhours_verdicts(spark, f):
    """Rare hours of users as verdicts, checked against the clock."""
    hours = _ev(spark, f).select("event_id", F.pmod(F.col("t"), F.lit(86400.0)).alias("s")).withColumn("hour", F.col("s") / 3600.0)
    d = offhours_conformal(spark, f).join(hours, "event_id").withColumn("flagged", F.col("p_value") <= 0.05)
    v = lineage.offhours_verdicts(d, "T1078", "events")
    return v.groupBy("user_id", "decision", "cross_check").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"))


def _beacons(spark, f):
    hosts = table(spark, f, "supplier").select(F.col("s_suppkey").alias("host"), (F.col("s_acctbal") < -300).alias("compromised"))
    return y.beacons(hosts, windows=200, rate=0.2, beacon_rate=0.15, grain=60.0)


def beacon_events(spark, f):
    """Suppliers as hosts, those in debt on a shared schedule."""
    e = _beacons(spark, f)
    return e.groupBy("host", "compromised").agg(F.count("*").alias("n"), F.sum("window").alias("windows"), F.round(F.max("t"), 3).alias("last"))


def coordination_verdicts(spark, f):
    """Pairs of suppliers coordinated beyond chance: all shufflings, false discovery rate over all pairs, linear check."""
    active = cut(detectors.activity(_beacons(spark, f), "host", F.col("t"), 60.0))
    d = detectors.coordinated(active, q=0.01).withColumn("rejected", F.lit(True))
    v = lineage.coordination_verdicts(d, "T1071", "suppliers")
    return v.where("rejected").select("a", "b", F.round("mi", 9).alias("mi"), F.round("pearson", 9).alias("pearson"), "decision", "cross_check")


def pattern_verdicts(spark, f):
    """Urgent orders with a returned line: who ordered, and whether the line left after the order came."""
    o = table(spark, f, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    li = table(spark, f, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"), F.when(F.col("l_quantity") > 10, F.col("l_suppkey")).alias("place"))
    m = structural.pattern_join({"order": (o, "o_orderkey"), "line": (li, "l_orderkey")})
    v = lineage.pattern_verdicts(m, "T1003.001", "orders", times=["order_at", "line_at"], who=["order_o_custkey"], where=["line_place"])
    return v.select(F.col("key").cast("long").alias("orderkey"), F.col("line_l_linenumber").alias("linenumber"), F.round("score", 9).alias("score"), "decision", "w_score")


def entailment_carriers(spark, f):
    """Orders: checked closed-world for a returned line, open-world for a dear one; gaps as in gap_classify."""
    li = table(spark, f, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_quantity") > 45).cast("int")).alias("q"))
    d = table(spark, f, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    check, sub = c.carrier_of_check(F.col("r") == 1), c.carrier_of_subsumption(F.col("q") == 1)
    d = d.select(check.alias("model_check"), sub.alias("subsumption"), b.name_of(b.col_k_join(c.carrier_code(check), c.carrier_code(sub))).alias("joined"))
    return d.groupBy("model_check", "subsumption", "joined").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- signatures and composition


def _supplier_signature(spark, f):
    li = table(spark, f, "lineitem")
    return c.signature(li, "l_suppkey", "l_partkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), least=10, floor=60)


def structural_signature(spark, f):
    """Suppliers that sold many parts: in large returned amounts, or otherwise."""
    return _supplier_signature(spark, f).select("l_suppkey", b.name_of(F.col("signature")).alias("signature"))


def orphan_signature(spark, f):
    """Suppliers whose lines hang on orders that were never `issued` (here: not urgent)."""
    issues = table(spark, f, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    d = c.orphan_signature(table(spark, f, "lineitem"), issues, "l_suppkey", "l_partkey", "l_orderkey", least=120, floor=300)
    return d.select("l_suppkey", b.name_of(F.col("signature")).alias("signature"))


def cross_check_verdicts(spark, f):
    cells = fanout_supplier(spark, f).withColumn("flagged", F.lit(True))
    return c.cross_check(cells, _supplier_signature(spark, f), "l_suppkey")


def corroborated_cells(spark, f):
    """Flagged days of users, with the rules that fire on anything the user did that day."""
    rules = {"error": F.col("event_type") == "error", "dear": F.col("value") > 90, "signup": F.col("event_type") == "signup", "never": F.col("value") < -1}
    cells = fanout_conformal(spark, f).where("flagged").select("entity", "bin", "p_value")
    d = c.corroborate(cells, _ev(spark, f), "user_id", "t", DAY, rules)
    return d.select("entity", "bin", "p_value", F.array_join("rules", ",").alias("rules"), "votes")


def span_events(spark, f):
    """What users did in the three days after each sign-up."""
    e = _ev(spark, f)
    spans = e.where("event_type = 'signup'").select(F.col("user_id").alias("entity"), F.col("t").alias("t0"), (F.col("t") + 3 * DAY).alias("t1"))
    d = c.span_events(e, "user_id", "t", spans, 2 * DAY)
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def mask_bits(spark, f):
    """Orders whose key, as a hexadecimal mask, has bit 4 set; every seventh has no mask."""
    o = table(spark, f, "orders").withColumn("mask", F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.concat(F.lit("0x"), F.hex("o_orderkey"))))
    return o.where(c.hex_bits(F.col("mask"), 0x10)).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


_PATH = ["signup", "view", "click", "purchase"]


def chain_hypotheses(spark, f):
    """How far users came on the path to a purchase, what comes next, and how likely."""
    e = _ev(spark, f)
    seen = e.groupBy("user_id").agg(F.collect_set("event_type").alias("stages"))
    d = c.chain_hypotheses(seen, _PATH, structural.transitions(e, "user_id", "t", "event_type", "event_id"))
    return d.select("user_id", "coverage", "reach", "deepest", "frontier", "frontier_p", F.array_join("gaps", ",").alias("gaps"))


# ---------------------------------------------------------------- coverage


def coverage_report(spark, f):
    """Parts as rules, brands as techniques, words of names and sizes as predicates."""
    p = table(spark, f, "part").withColumn("rule_id", F.col("p_partkey").cast("string"))
    tags = p.select("rule_id", F.lower("p_brand").alias("technique"))
    tokens = p.select("rule_id", F.explode(F.array(F.concat(F.lit("s"), F.col("p_size").cast("string")), "p_type")).alias("atom"))
    first = p.groupBy("p_brand", "p_type").agg(F.min(F.struct("p_size", "p_partkey")).alias("m"))
    edges = first.join(p, ["p_brand", "p_type"]).where("p_size > m.p_size").select(F.col("m.p_partkey").cast("string").alias("a"), F.col("rule_id").alias("b"), F.lit("broader").alias("rel"))
    want = p.select(F.col("p_brand").alias("technique")).distinct().union(spark.createDataFrame([("Brand#99",)], "technique string"))
    return coverage.report(tags, tokens, corpus.classes_of(tokens, "rule_id", "atom"), edges, want)


def behaviour_structure(spark, f):
    """Suppliers as rules that fire on brands they returned a lot of, told apart by nation and balance."""
    li = table(spark, f, "lineitem").where("l_returnflag = 'R' AND l_quantity > 47").join(table(spark, f, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    hits = li.select(F.col("l_suppkey").cast("string").alias("rule_id"), "p_brand")
    tokens = table(spark, f, "supplier").select(F.col("s_suppkey").cast("string").alias("rule_id"), F.explode(F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor"))).alias("token"))
    return coverage.behaviour_against_structure(hits, tokens, "p_brand")


def _tags(spark):
    return spark.createDataFrame([(r["id"], t.split(".", 1)[1].upper()) for r in rule_queries.EVENT_RULES for t in r["tags"]], "rule_id string, technique string")


_LABELS = {"error": "T1078", "purchase": "T1110", "signup": "T1087"}


def _labels(spark, f):
    named = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])
    return _ev(spark, f).select("event_id", named[F.col("event_type")].alias("technique"), F.col("event_type").alias("variant"), F.when(F.col("value") > 50, "dear").otherwise("cheap").alias("channel"))


def fidelity_scorecard(spark, f):
    """Rules against events labelled by kind, the rest benign."""
    return coverage.scorecard(rule_queries.rules_events(spark, f), _labels(spark, f), _tags(spark), "event_id")


def variant_coverage(spark, f):
    d = coverage.variant_coverage(rule_queries.rules_events(spark, f), _labels(spark, f).where("technique IS NOT NULL"), _tags(spark), "event_id")
    return d.select("technique", "variant", "channel", F.array_join("catchers", ",").alias("catchers"), "caught")


def location_coverage(spark, f):
    """Rules of a technique at dear errors."""
    at = _ev(spark, f).where("event_type = 'error' AND value > 95").select("event_id")
    return coverage.location_coverage(rule_queries.rules_events(spark, f), at, _tags(spark), "T1078", "event_id")


def candidate_techniques(spark, f):
    """Kinds of parts that the brands and sizes of an order's parts point at; small parts count against."""
    p = table(spark, f, "part")
    atoms = p.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("atom"), F.when(F.col("p_size") > 45, 1).otherwise(-1).alias("sign"))
    tags = p.select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("technique"))
    fired = table(spark, f, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), (F.col("s_suppkey") % 5 + 1).cast("string")).alias("atom"))
    d = coverage.candidate_techniques(fired, atoms, tags, "s_suppkey")
    return d.groupBy("technique").agg(F.count("*").alias("suppliers"), F.sum("s_suppkey").alias("ids"))


def defence_coverage(spark, f):
    """Nations whose suppliers counter a brand through parts they both touch, for brands of a phase."""
    s = table(spark, f, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("defence"))
    p = table(spark, f, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("technique"), F.col("p_type").alias("artefact"))
    counters = table(spark, f, "lineitem").where("l_quantity > 49").join(p, "l_partkey").join(s, "l_suppkey")
    tactics = table(spark, f, "part").select(F.col("p_brand").alias("technique"), F.when(F.col("p_brand") < "Brand#3", "execution").when(F.col("p_brand") < "Brand#4", "collection").otherwise("none").alias("tactic")).distinct()
    d = coverage.defences(counters, coverage.techniques_in(tactics, stage="through"))
    return d.select("technique", "n_defences", F.aggregate("defences", F.lit(0), lambda a, x: a + F.size(x["via"])).alias("artefacts"))


# ---------------------------------------------------------------- signals


def sliding_mi(spark, f):
    """Codes of a series against those of the day before."""
    d = _codes(spark, f).withColumn("y", F.lag("x").over(g._order())).where("y IS NOT NULL").withColumns({"x": F.col("x") % 3, "y": F.col("y") % 3})
    return g.sliding_mi(d, 16, 4).withColumn("mi", F.round("mi", 9))


def dominant_frequencies(spark, f):
    return g.dominant(welch(spark, f).select("series_id", "freq", "power"), 3)


def drift_monitor(spark, f):
    d = detectors.drift(_series(spark, f), "idx", "x", ["series_id"])
    return d.select("series_id", "n", F.round("ks", 9).alias("ks"), F.round("p_value", 6).alias("p_value"), "verdict")


# ---------------------------------------------------------------- synthetic data


def ticket_sessions(spark, f):
    """Tickets for every order, sealed by supplier keys, with forged ones for orders of the largest customers' class; tiers of
    what the centre and the services see."""
    o = table(spark, f, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("client"), F.concat(F.lit("svc"), (F.col("o_orderkey") % 10).cast("string")).alias("spn"), (F.col("o_custkey") % 5).cast("string").alias("ip"), (F.col("o_orderkey") * 10).alias("clock"), "o_totalprice")
    services = spark.range(10).select(F.concat(F.lit("svc"), F.col("id").cast("string")).alias("spn"), F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    x = y.sessions(o.where("o_totalprice <= 400000"), "master", services, o.where("o_totalprice > 400000"), o.where("o_totalprice > 450000"))
    tiers = structural.ticket_tiers(x["issues"], x["presented"].select("id", "hash", "account", "ip"))
    return tiers.join(x["presented"].select("id", "kind"), "id").groupBy("tier", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def roast_verdicts(spark, f):
    """Customers asking for services, those deep in debt sweeping them, some with a tool: flagged cells and what corroborates."""
    kind = F.when(F.col("c_acctbal") < -980, "tool").when(F.col("c_acctbal") < -950, "quiet").otherwise("plain")
    e = y.roast_corpus(table(spark, f, "customer").select(F.col("c_custkey").alias("account"), kind.alias("kind")))
    cells = detectors.fanout_detect(e.where("code = '4769'"), "account", "service", F.col("t"), 3600.0, alpha=0.05).where("flagged")
    rules = {"tickets": F.col("code") == "4769", "tool": F.col("logon_process") == "User32LogonProcesss"}
    d = c.corroborate(cells, e, "account", "t", 3600.0, rules)
    return d.select("entity", "distinct_values", F.round("entropy", 9).alias("entropy"), F.round("p_value", 9).alias("p_value"), F.array_join("rules", ",").alias("rules"))


def synthetic_recall(spark, f):
    """A generated organisation's labelled events, and how many the ticket tiers and the plain correlation find."""
    org = y.organisation(spark, users=200, workstations=60)
    e = cut(y.log_events(y.timeline(org, roasters=6, variants=("rubeus", "setspn", "aes"), forgeries=True), org, ticket_hashes=True))
    m = F.col("fields")
    issued = e.where(m["EventID"] == "4768").select(m["ResponseTicketHash"].alias("hash"), m["TargetUserName"].alias("account"), m["IpAddress"].alias("ip"), F.col("t").alias("seq"))
    shown = e.where(m["EventID"] == "4769").select(m["ResponseTicketHash"].alias("id"), m["RequestTicketHash"].alias("hash"), m["TargetUserName"].alias("account"), m["IpAddress"].alias("ip"), "label")
    tiers = shown.join(structural.ticket_tiers(issued, shown.drop("label")), "id", "left")
    return tiers.groupBy(F.coalesce(F.split("label", ":")[0], F.lit("benign")).alias("label"), F.coalesce("tier", F.lit("-")).alias("tier")).agg(F.count("*").alias("n"))


QUERIES = {x.__name__: x for x in (offhours_verdicts, beacon_events, coordination_verdicts, pattern_verdicts, entailment_carriers, structural_signature, orphan_signature, cross_check_verdicts, corroborated_cells, span_events, mask_bits, chain_hypotheses, coverage_report, behaviour_structure, fidelity_scorecard, variant_coverage, location_coverage, candidate_techniques, defence_coverage, sliding_mi, dominant_frequencies, drift_monitor, ticket_sessions, roast_verdicts, synthetic_recall)}

_T = "epoch_us(ts) / 1e6"
_EV = f"(SELECT event_id, user_id, event_type, value, {_T} AS t FROM events)"
_SIGNATURE = "SELECT l_suppkey, CASE WHEN count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) >= 10 THEN 'true' WHEN count(DISTINCT l_partkey) >= 60 THEN 'false' ELSE 'none' END AS signature FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1"
_TAGS = "(VALUES " + ", ".join(f"('{r['id']}', '{t.split('.', 1)[1].upper()}')" for r in rule_queries.EVENT_RULES for t in r["tags"]) + ") AS tags(rule_id, technique)"
_LABEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " END"
_RULE_HITS = f"h AS ({rule_queries.ORACLES['rules_events']})"
_DRAW = y.draw_sql

ORACLES = {
    "offhours_verdicts": f"""WITH p AS ({DETECTOR_ORACLES["offhours_conformal"]}), e AS (SELECT p.user_id, p_value <= 0.05 AS hit, p_value, fmod({_T}, 86400) / 3600.0 AS h FROM p JOIN events USING (event_id))
SELECT user_id, CASE WHEN hit THEN 'true' ELSE 'none' END AS decision, CASE WHEN h < 8 OR h >= 18 THEN 'true' WHEN hit THEN 'both' ELSE 'false' END AS cross_check, count(*) AS n, round(max(CASE WHEN hit THEN 1 / (1 + p_value / 0.9) ELSE 0.0 END), 6) AS score FROM e GROUP BY ALL""",
    "beacon_events": f"""WITH h AS (SELECT s_suppkey AS host, s_acctbal < -300 AS compromised, w FROM supplier, unnest(range(0, 200)) AS u(w)),
a AS (SELECT * FROM h WHERE (compromised AND {_DRAW(7, "'beacon'", "w")} < 0.15) OR {_DRAW(7, "'own'", "host", "w")} < CASE WHEN compromised THEN (0.2 - 0.15) / (1 - 0.15) ELSE 0.2 END)
SELECT host, compromised, count(*) AS n, CAST(sum(w) AS BIGINT) AS windows, round(max((w + {_DRAW(7, "'jitter'", "host", "w")}) * 60.0), 3) AS last FROM a GROUP BY ALL""",
    "pattern_verdicts": """SELECT o_orderkey AS orderkey, l_linenumber AS linenumber, round(1 / (1 + 1e-6 / 0.9), 9) AS score, 'true' AS decision,
(2 + CAST(o_custkey IS NOT NULL AS INT) + CAST(l_quantity > 10 AS INT) + CAST(o_orderdate <= l_shipdate AS INT)) / 5.0::DOUBLE AS w_score FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'""",
    "entailment_carriers": """WITH l AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_quantity > 45) AS q FROM lineitem GROUP BY 1),
d AS (SELECT CASE r WHEN TRUE THEN 'CONFIRMED' WHEN FALSE THEN 'REFUTED' ELSE 'NONE' END AS model_check, CASE WHEN q THEN 'CONFIRMED' ELSE 'NONE' END AS subsumption FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT *, CASE WHEN model_check = 'REFUTED' THEN CASE subsumption WHEN 'NONE' THEN 'false' ELSE 'both' END WHEN model_check = 'CONFIRMED' OR subsumption = 'CONFIRMED' THEN 'true' ELSE 'none' END AS joined, count(*) AS n FROM d GROUP BY ALL""",
    "structural_signature": _SIGNATURE,
    "orphan_signature": """SELECT l_suppkey, CASE WHEN count(DISTINCT l_partkey) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')) >= 120 THEN 'true'
WHEN count(DISTINCT l_partkey) >= 300 THEN 'false' ELSE 'none' END AS signature FROM lineitem GROUP BY 1""",
    "cross_check_verdicts": f"""WITH c AS ({DETECTOR_ORACLES["fanout_supplier"]}), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p_value, bin) AS k FROM c), s AS ({_SIGNATURE})
SELECT entity, bin, p_value, coalesce(signature, 'none') AS signature, CASE signature WHEN 'false' THEN 'both' ELSE 'true' END AS cross_check FROM r LEFT JOIN s ON l_suppkey = entity WHERE k = 1""",
    "corroborated_cells": f"""WITH c AS (SELECT entity, bin, p_value FROM ({DETECTOR_ORACLES["fanout_conformal"]}) WHERE flagged), e AS (SELECT *, CAST(floor(t / {DAY}) AS BIGINT) AS bin FROM {_EV}),
r AS (SELECT user_id, bin, 'error' AS rule FROM e WHERE event_type = 'error' UNION SELECT user_id, bin, 'dear' FROM e WHERE value > 90 UNION SELECT user_id, bin, 'signup' FROM e WHERE event_type = 'signup')
SELECT entity, c.bin, p_value, coalesce(string_agg(rule, ',' ORDER BY rule), '') AS rules, CAST(count(rule) AS INT) AS votes FROM c LEFT JOIN r ON user_id = entity AND r.bin = c.bin GROUP BY ALL""",
    "span_events": f"SELECT e.user_id, e.event_type, count(*) AS n, CAST(sum(e.event_id) AS BIGINT) AS ids FROM {_EV} s JOIN {_EV} e ON s.event_type = 'signup' AND e.user_id = s.user_id AND e.t >= s.t AND e.t < s.t + {3 * DAY} GROUP BY ALL",
    "mask_bits": "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey >> 4) & 1 = 1 GROUP BY 1",
    "chain_hypotheses": f"""WITH c AS ({STRUCTURE_ORACLES["path_completeness"]}), t AS ({STRUCTURE_ORACLES["transition_matrix"]}),
d AS (SELECT *, CASE WHEN reach > 0 THEN ['signup', 'view', 'click', 'purchase'][CAST(round(reach * 4) AS INT)] END AS deepest FROM c)
SELECT user_id, coverage, reach, deepest, frontier, CASE WHEN deepest IS NOT NULL AND frontier IS NOT NULL THEN round(coalesce(p, 0.0), 4) END AS frontier_p, gaps FROM d LEFT JOIN t ON state = deepest AND next_state = frontier""",
    "coverage_report": """WITH b AS (SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'Brand#99'), e AS (SELECT p_brand, p_type, min(p_size) AS low FROM part GROUP BY ALL HAVING max(p_size) > min(p_size)),
k AS (SELECT p_brand, count(*) AS families FROM e GROUP BY 1), r AS (SELECT p_brand, count(*) AS rules, count(DISTINCT (p_size, p_type)) AS concepts, count(DISTINCT p_size) + count(DISTINCT p_type) AS atoms FROM part GROUP BY 1)
SELECT upper(p_brand) AS technique, coalesce(rules, 0) AS rules, coalesce(concepts, 0) AS concepts, coalesce(round(rules / concepts, 2), 0.0) AS redundancy, coalesce(atoms, 0) AS atoms, coalesce(families, 0) AS families, rules IS NULL AS gap FROM b LEFT JOIN r USING (p_brand) LEFT JOIN k USING (p_brand)""",
    "behaviour_structure": """WITH h AS (SELECT l_suppkey AS r, list_sort(list(DISTINCT p_brand)) AS c FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 47 GROUP BY 1),
x AS (SELECT r, c, s_nationkey AS n, s_acctbal > 5000 AS w FROM h JOIN supplier ON s_suppkey = r)
SELECT CASE WHEN a.c = b.c THEN 'co-catch' WHEN list_has_any(a.c, b.c) THEN 'overlap' ELSE 'disjoint' END AS behaviour, CASE WHEN a.n = b.n AND a.w = b.w THEN 'exact' WHEN a.n = b.n OR a.w = b.w THEN 'related' ELSE 'none' END AS structure, count(*) AS pairs FROM x a JOIN x b ON a.r < b.r GROUP BY ALL""",
    "fidelity_scorecard": f"""WITH {_RULE_HITS}, l AS (SELECT event_id, {_LABEL} AS technique FROM events), t AS (SELECT * FROM {_TAGS}),
c AS (SELECT t.*, EXISTS (SELECT 1 FROM h JOIN l USING (event_id) WHERE h.rule_id = t.rule_id AND l.technique = t.technique) AS caught, EXISTS (SELECT 1 FROM h JOIN l USING (event_id) WHERE h.rule_id = t.rule_id AND l.technique IS NULL) AS alarm FROM t),
n AS (SELECT technique, count(*) AS labelled FROM l WHERE technique IS NOT NULL GROUP BY 1)
SELECT technique, labelled, count(rule_id) AS rules, count(*) FILTER (WHERE caught) AS catching, count(*) FILTER (WHERE NOT caught) AS silent, count(*) FILTER (WHERE alarm) AS false_alarms, count(*) FILTER (WHERE caught AND NOT alarm) AS clean,
round(count(*) FILTER (WHERE caught) / count(rule_id), 3) AS catch_rate FROM n LEFT JOIN c USING (technique) GROUP BY ALL""",
    "variant_coverage": f"""WITH {_RULE_HITS}, l AS (SELECT event_id, {_LABEL} AS technique, event_type AS variant, CASE WHEN value > 50 THEN 'dear' ELSE 'cheap' END AS channel FROM events), t AS (SELECT * FROM {_TAGS}),
c AS (SELECT DISTINCT technique, variant, channel, rule_id FROM h JOIN l USING (event_id) JOIN t USING (rule_id, technique))
SELECT technique, variant, channel, coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') AS catchers, count(rule_id) > 0 AS caught FROM (SELECT DISTINCT technique, variant, channel FROM l WHERE technique IS NOT NULL) LEFT JOIN c USING (technique, variant, channel) GROUP BY ALL""",
    "location_coverage": f"""WITH {_RULE_HITS}, t AS (SELECT * FROM {_TAGS}) SELECT rule_id, CASE WHEN rule_id IN (SELECT rule_id FROM h JOIN events USING (event_id) WHERE event_type = 'error' AND value > 95) THEN 'witness' ELSE 'gap' END AS role FROM t WHERE technique = 'T1078'""",
    "candidate_techniques": """WITH f AS (SELECT s_suppkey, 'Brand#' || (s_nationkey % 5 + 1) || (s_suppkey % 5 + 1) AS b FROM supplier)
SELECT p_type AS technique, count(DISTINCT s_suppkey) AS suppliers, CAST(sum(DISTINCT s_suppkey) AS BIGINT) AS ids FROM f JOIN part ON p_brand = b WHERE p_size > 45 GROUP BY 1""",
    "defence_coverage": """WITH k AS (SELECT DISTINCT p_brand AS technique FROM part WHERE p_brand < 'Brand#3'),
c AS (SELECT DISTINCT p_brand AS technique, s_nationkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 49)
SELECT technique, CAST(count(DISTINCT s_nationkey) AS INT) AS n_defences, CAST(count(s_nationkey) AS INT) AS artefacts FROM k LEFT JOIN c USING (technique) GROUP BY 1""",
    "sliding_mi": f"""WITH {_C}, d AS (SELECT series_id, idx, x % 3 AS x, lag(x) OVER (PARTITION BY series_id ORDER BY idx) % 3 AS y FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 16 AS k FROM d WHERE y IS NOT NULL),
w AS (SELECT a.series_id, CAST(a.k / 4 AS INT) AS win, b.x, b.y FROM e a JOIN e b ON a.series_id = b.series_id AND b.k BETWEEN a.k - 15 AND a.k WHERE a.k >= 0 AND a.k % 4 = 0),
hx AS (SELECT series_id, win, -sum(n / 16.0 * log2(n / 16.0)) AS h FROM (SELECT series_id, win, x, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL), hy AS (SELECT series_id, win, -sum(n / 16.0 * log2(n / 16.0)) AS h FROM (SELECT series_id, win, y, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
hj AS (SELECT series_id, win, -sum(n / 16.0 * log2(n / 16.0)) AS h FROM (SELECT series_id, win, x, y, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL)
SELECT hx.series_id, hx.win AS "window", round(greatest(0.0, hx.h + hy.h - hj.h), 9) + 0.0 AS mi FROM hx JOIN hy USING (series_id, win) JOIN hj USING (series_id, win)""",
    "dominant_frequencies": f'SELECT series_id, freq, power, CAST(k AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, freq) AS k FROM ({SIGNAL_ORACLES["welch"]}) WHERE freq > 0) WHERE k <= 3',
    "drift_monitor": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx, x) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s),
h AS (SELECT *, i <= n // 2 AS a FROM r), v AS (SELECT p.series_id, p.n, p.x, abs(count(*) FILTER (WHERE q.a) / (p.n // 2) - count(*) FILTER (WHERE NOT q.a) / (p.n - p.n // 2)) AS gap FROM (SELECT DISTINCT series_id, n, x FROM h) p JOIN h q ON q.series_id = p.series_id AND q.x <= p.x GROUP BY p.series_id, p.n, p.x),
k AS (SELECT series_id, n, max(gap) AS ks, sqrt((n // 2) * (n - n // 2) / n) AS m FROM v GROUP BY series_id, n), z AS (SELECT *, (m + 0.12 + 0.11 / m) * ks AS x FROM k),
p AS (SELECT *, CASE WHEN n >= 20 THEN CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x))))) END END AS p_value FROM z)
SELECT series_id, n, round(ks, 9) AS ks, round(p_value, 6) AS p_value, CASE WHEN p_value IS NULL THEN 'none' WHEN p_value > 0.05 THEN 'true' ELSE 'false' END AS verdict FROM p""",
    "ticket_sessions": """WITH o AS (SELECT 'c' || o_custkey AS client, 'svc' || (o_orderkey % 10) AS spn, o_custkey % 5 AS ip, o_orderkey * 10 AS clock, o_totalprice AS price, 'key' || (o_orderkey % 10) AS key FROM orders),
t AS (SELECT *, 'TGT|' || client || '|krbtgt|' || clock AS tb, 'SERVICE|' || client || '|' || spn || '|' || (clock + 1) AS sb, 'SERVICE|' || client || '|' || spn || '|' || clock AS fb FROM o),
h AS (SELECT *, substr(sha256(tb || '|' || sha256('master' || chr(31) || tb || chr(31) || 'master')), 1, 16) AS th, substr(sha256(fb || '|' || sha256(key || chr(31) || fb || chr(31) || key)), 1, 16) AS fh FROM t)
SELECT tier, kind, count(*) AS n, min(id) AS first FROM (SELECT 'golden' AS tier, '4769' AS kind, 'tgs:' || th AS id FROM h WHERE price > 400000 UNION ALL SELECT 'golden', '4624', 'ap:' || fh FROM h WHERE price > 450000) GROUP BY ALL""",
    "roast_verdicts": f"""WITH a AS (SELECT c_custkey AS account, CASE WHEN c_acctbal < -980 THEN 'tool' WHEN c_acctbal < -950 THEN 'quiet' ELSE 'plain' END AS kind FROM customer),
n AS (SELECT *, CASE WHEN kind = 'plain' THEN 1 + CAST(floor({_DRAW(7, "'n'", "account")} * 3) AS INT) ELSE 18 END AS n FROM a),
c AS (SELECT account, kind, n AS d, log2(n) AS h FROM n),
p AS (SELECT *, (1 + (SELECT count(*) FROM n m WHERE m.n >= c.d)) / ((SELECT count(*) FROM n) + 1) AS p_value FROM c)
SELECT account AS entity, CAST(d AS BIGINT) AS distinct_values, round(h, 9) AS entropy, round(p_value, 9) AS p_value, CASE WHEN kind = 'tool' THEN 'tickets,tool' ELSE 'tickets' END AS rules FROM p WHERE p_value <= 0.05""",
}
