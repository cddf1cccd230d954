"""Structural, graph, lattice and four-valued queries over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions import belnap as b
from tracewarden.operators import corpus, detectors, graph
from tracewarden.operators import structural as s

from . import lineage
from .detector_queries import DAY, ORACLES as DETECTOR_ORACLES, fanout_conformal, table


def _ev(spark, f):
    return table(spark, f, "events").select("event_id", "user_id", "event_type", "value", detectors.seconds("ts").alias("t"))


def pattern_join(spark, f):
    """Returned lines of an order, the order, and its customer: three motifs with keys of different names."""
    lines = table(spark, f, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, f, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    j = s.pattern_join({"line": (lines, "l_orderkey"), "order": (orders, "o_orderkey")})
    cust = table(spark, f, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    k = s.pattern_join({"hit": (j.select("key", "line_l_linenumber", "order_o_custkey"), "order_o_custkey"), "cust": (cust, "c_custkey")})
    return k.select(F.col("hit_key").cast("long").alias("orderkey"), F.col("hit_line_l_linenumber").alias("linenumber"), F.col("cust_c_custkey").alias("custkey"), F.col("cust_c_mktsegment").alias("segment"))


def orphan_anti(spark, f):
    return s.orphans(table(spark, f, "customer"), table(spark, f, "orders").where("o_totalprice > 250000"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


def orphan_timed(spark, f):
    """Purchases without an earlier view by the same user."""
    e = _ev(spark, f)
    return s.orphans(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "user_id", "t", "t").select("event_id", "user_id")


def gap_classify(spark, f):
    """Orders as anchors, returned lines as what they should entail, any line as the channel."""
    li = table(spark, f, "lineitem")
    return s.gap_classify(table(spark, f, "orders"), li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", li).groupBy("outcome").agg(F.count("*").alias("n"))


def chain_ordered(spark, f):
    e = _ev(spark, f)
    stages = [("signup_t", F.col("event_type") == "signup"), ("view_t", F.col("event_type") == "view"), ("purchase_t", (F.col("event_type") == "purchase") & (F.col("value") > 60))]
    out = s.chain(e, "user_id", "t", stages)
    return out.select("actor", *(F.round(c, 3).alias(c) for c in ("signup_t", "view_t", "purchase_t")), "stages_met", "complete")


def burst_then_later(spark, f):
    """The first day on which a user shows three kinds of events, and the first purchase from then on."""
    e = _ev(spark, f)
    burst = s.bursts(e, "user_id", "event_type", F.col("t"), DAY, 3)
    out = s.burst_then_later(e, burst, "user_id", "t", F.col("event_type") == "purchase", ["event_id"])
    return out.select("key", F.round("burst_t", 3).alias("burst_t"), "n", F.round("later_t", 3).alias("later_t"), "event_id")


def _tickets(spark, f):
    issued = table(spark, f, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("account"), (F.col("o_custkey") % 7).alias("ip"), F.col("o_orderkey").alias("seq"))
    li = table(spark, f, "lineitem")
    presented = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") != 2, F.col("l_orderkey")).alias("hash"), F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 7).alias("ip"))
    return issued, presented


def ticket_tiers(spark, f):
    return s.ticket_tiers(*_tickets(spark, f)).groupBy("tier").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def ledger_classes(spark, f):
    issued, presented = _tickets(spark, f)
    return s.ledger_classes(presented.select("id", "hash", "ip"), issued.select("hash", "ip", "seq")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def path_completeness(spark, f):
    seen = _ev(spark, f).groupBy("user_id").agg(F.collect_set("event_type").alias("stages"))
    out = s.completeness(seen, ["signup", "view", "click", "purchase"])
    return out.select("user_id", "coverage", "reach", "frontier", F.array_join("gaps", ",").alias("gaps"))


def transition_matrix(spark, f):
    out = s.transitions(_ev(spark, f), "user_id", "t", "event_type", "event_id")
    return out.select(F.col("from").alias("state"), F.col("to").alias("next_state"), "n", F.round("p", 9).alias("p"))


# ---------------------------------------------------------------- lattices


def _part_tokens(spark, f):
    p = table(spark, f, "part")
    return p.select("p_partkey", F.explode(F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), F.col("p_size").cast("string")))).alias("token"))


def token_idf(spark, f):
    return corpus.token_idf(_part_tokens(spark, f), "p_partkey", "token").withColumn("idf", F.round("idf", 9))


def lattice_edges(spark, f):
    return corpus.lattice_edges(_part_tokens(spark, f), "p_partkey", "token").groupBy("rel").agg(F.count("*").alias("n"), F.sum(F.col("a") + F.col("b")).alias("ids"), F.round(F.sum("tightness"), 3).alias("tightness"))


def exact_classes(spark, f):
    c = corpus.classes_of(_part_tokens(spark, f), "p_partkey", "token")
    return c.groupBy("class_id").agg(F.count("*").alias("members")).where("members > 1")


def edge_components(spark, f):
    """Components over exact and close lattice edges, by label propagation."""
    t = _part_tokens(spark, f)
    e = corpus.lattice_edges(t, "p_partkey", "token", least=corpus.CLOSE).where("rel IN ('exact', 'close')")
    return graph.components(e.select("a", "b")).groupBy("component").agg(F.count("*").alias("members"))


def fca_concept_groups(spark, f):
    p = table(spark, f, "part")
    t = p.select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("token"))
    return corpus.concept_groups(t, p, "p_partkey", "token")


def over_collapse(spark, f):
    p = table(spark, f, "part")
    out = corpus.over_collapse(p, [F.col("p_type")], [F.col("p_type"), F.col("p_size"), F.col("p_name")], F.col("p_brand"))
    return out.withColumn("ratio", F.round("ratio", 9))


def cross_corpus(spark, f):
    d = table(spark, f, "documents").select("source", F.explode(F.array_distinct(F.split("text", "[\\x20\\x09-\\x0D]+"))).alias("token"))
    return corpus.cross_corpus(d.where("source IS NOT NULL AND token <> ''"), "source", "token")


def coverage_tiers(spark, f):
    n = table(spark, f, "nation")
    sup = table(spark, f, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    rich = table(spark, f, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey"))
    some = table(spark, f, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return corpus.coverage_tiers(n, "n_nationkey", sup, rich, some, n.where("n_regionkey < 3"))


# ---------------------------------------------------------------- graphs


def _edges(spark, f):
    c = table(spark, f, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = table(spark, f, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    o = table(spark, f, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return c.union(n).union(o)


def closure_up(spark, f):
    seeds = table(spark, f, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.closure(_edges(spark, f), seeds).select("start", "node")


def closure_down(spark, f):
    e = _edges(spark, f).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = table(spark, f, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.closure(e, seeds).groupBy("start").agg(F.count("*").alias("reached"))


def flow_taint(spark, f):
    """Orders that derive from a nation named by a source set."""
    sinks = table(spark, f, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    sources = table(spark, f, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.flows(_edges(spark, f).select(F.col("src").alias("child"), F.col("dst").alias("parent")), sinks, sources)


def bridge_compose(spark, f):
    """customer -> nation composed with nation -> region, then inverted and counted."""
    a = table(spark, f, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("source"), F.concat(F.lit("n:"), "c_nationkey").alias("target"))
    n = table(spark, f, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("source"), F.concat(F.lit("r:"), "n_regionkey").alias("target"))
    return graph.invert(graph.compose(a, n)).groupBy("source").agg(F.count("*").alias("targets"))


# ---------------------------------------------------------------- four values and folds


def belnap_folds(spark, f):
    """Labels as evidence on documents' sources: joins and meets on both orders."""
    d = table(spark, f, "documents").join(table(spark, f, "labels"), "doc_id")
    code = b.of(F.col("quality") == 1, F.col("toxic") == 1)
    g = d.groupBy("source").agg(b.agg_k_join(code).alias("k_join"), b.agg_k_meet(code).alias("k_meet"), b.agg_t_join(code).alias("t_join"), b.agg_t_meet(code).alias("t_meet"))
    return g.select("source", *(b.name_of(F.col(c)).alias(c) for c in ("k_join", "k_meet", "t_join", "t_meet")), b.name_of(b.col_negate(F.col("t_meet"))).alias("negated"))


def llr_fuse(spark, f):
    """Log-likelihood ratios of fan-out detections, fused per user."""
    c = fanout_conformal(spark, f).where("flagged")
    return c.groupBy("entity").agg(F.count("*").alias("detections"), F.round(F.sum(F.log(F.lit(0.9) / F.col("p_value"))), 6).alias("log_odds"))


def tier_meet(spark, f):
    """Guarantee tiers: a nation is as good as its weakest customer claims."""
    c = table(spark, f, "customer").withColumn("tier", F.when(F.col("c_acctbal") < -990, 0).when(F.col("c_acctbal") < -900, 1).when(F.col("c_acctbal") < 0, 2).otherwise(3))
    return c.groupBy("c_nationkey").agg(F.min("tier").alias("tier"))


def dag_confidence(spark, f):
    """Confidence folded along order -> customer -> nation -> region lineage."""
    o = table(spark, f, "orders")
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", b.TRUE).otherwise(b.NONE).alias("belnap"), F.when(F.col("o_orderstatus") == "F", F.lit(0.5)).alias("log_odds"))
    for t, k, x in (("customer", "c_custkey", "c"), ("nation", "n_nationkey", "n"), ("region", "r_regionkey", "r")):
        nodes = nodes.union(table(spark, f, t).select(F.concat(F.lit(x), k).alias("node"), F.lit(b.NONE), F.lit(None).cast("double")))
    edges = _edges(spark, f).select(F.col("dst").alias("child"), F.col("src").alias("parent"))
    out = lineage.fold_edges(nodes, edges).where("node LIKE 'n%' OR node LIKE 'r%'")
    return out.select("node", b.name_of(F.col("belnap")).alias("belnap"), F.round("log_odds", 6).alias("log_odds"))


def verdicts(spark, f):
    d = fanout_conformal(spark, f).where("flagged").withColumn("busy", F.col("distinct_values") > 2)
    v = lineage.verdict_rows(d, "T1110.003", "events", check="busy")
    return v.select("entity", "bin", F.round("score", 6).alias("score"), "decision", "cross_check", "w_score", "guarantee")


def prov_triples(spark, f):
    """Lineage of nations and regions as PROV-O triples, counted by predicate, and what breaks a shape."""
    n = table(spark, f, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("load").alias("op"))
    r = table(spark, f, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("op"))
    e = table(spark, f, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    t = lineage.to_triples(n.union(r), e)
    bad = graph.count_violations(t, "http://www.w3.org/ns/prov#Entity", "http://www.w3.org/ns/prov#wasGeneratedBy", least=1)
    return t.groupBy("p").agg(F.count("*").alias("n")).union(bad.agg(F.lit("violations"), F.count("*")))


QUERIES = {x.__name__: x for x in (pattern_join, orphan_anti, orphan_timed, gap_classify, chain_ordered, burst_then_later, ticket_tiers, ledger_classes, path_completeness, transition_matrix, token_idf, lattice_edges, exact_classes, edge_components, fca_concept_groups, over_collapse, cross_corpus, coverage_tiers, closure_up, closure_down, flow_taint, bridge_compose, belnap_folds, llr_fuse, tier_meet, dag_confidence, verdicts, prov_triples)}

_T = "epoch_us(ts) / 1e6"
_EV = f"(SELECT event_id, user_id, event_type, value, {_T} AS t FROM events)"
_TOK = "(SELECT p_partkey, unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) AS token FROM part)"
_LAT = f"""WITH t0 AS (SELECT DISTINCT * FROM {_TOK}), i AS (SELECT token, ln((SELECT count(DISTINCT p_partkey) FROM t0) / count(*)) AS w FROM t0 GROUP BY 1),
c AS (SELECT item, min(item) OVER (PARTITION BY s) AS rep FROM (SELECT p_partkey AS item, list_sort(list(token)) AS s FROM t0 GROUP BY 1)),
d AS (SELECT p_partkey, token, w FROM t0 JOIN c ON p_partkey = item AND item = rep JOIN i USING (token)), p AS (SELECT p_partkey AS item, count(*) AS n, sum(w) AS m FROM d GROUP BY 1),
j AS (SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) AS k, sum(x.w) AS shared FROM d x JOIN d y ON x.token = y.token AND x.p_partkey < y.p_partkey GROUP BY ALL),
e AS (SELECT a, b, k, p.n AS na, q.n AS nb, round(CASE WHEN p.m + q.m - shared > 1e-12 THEN shared / (p.m + q.m - shared) ELSE k / (p.n + q.n - k) END, 3) AS tightness FROM j JOIN p ON p.item = a JOIN p q ON q.item = b),
l AS (SELECT a, b, tightness, CASE WHEN k = na THEN 'broader' WHEN k = nb THEN 'narrower' WHEN tightness >= 0.6 THEN 'close' ELSE 'related' END AS rel FROM e UNION ALL SELECT rep, item, 1.0, 'exact' FROM c WHERE rep < item)"""
_EDGES = "(SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"
_TICKETS = """issued AS (SELECT o_orderkey AS hash, o_custkey AS account, o_custkey % 7 AS ip FROM orders WHERE o_orderpriority <> '1-URGENT'),
presented AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <> 2 THEN l_orderkey END AS hash, l_suppkey AS account, l_partkey % 7 AS ip FROM lineitem)"""
_FLAGGED = f"(SELECT * FROM ({DETECTOR_ORACLES['fanout_conformal']}) WHERE flagged)"


def _name(code: str) -> str:
    return f"['none', 'true', 'false', 'both'][{code} + 1]"


ORACLES = {
    "pattern_join": "SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, c_custkey AS custkey, c_mktsegment AS segment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_quantity > 45 AND o_orderpriority = '1-URGENT' AND c_acctbal > 0",
    "orphan_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "orphan_timed": f"SELECT event_id, user_id FROM {_EV} c WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM {_EV} p WHERE p.event_type = 'view' AND p.user_id = c.user_id AND p.t <= c.t)",
    "gap_classify": "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'CONFIRMED' ELSE 'GAP' END AS outcome FROM orders) GROUP BY 1",
    "chain_ordered": f"""WITH e AS (SELECT * FROM {_EV}), a AS (SELECT user_id, min(t) FILTER (WHERE event_type = 'signup') AS a0, min(t) FILTER (WHERE event_type = 'view') AS a1, min(t) FILTER (WHERE event_type = 'purchase' AND value > 60) AS a2 FROM e GROUP BY 1),
b AS (SELECT a.*, (SELECT min(t) FROM e WHERE e.user_id = a.user_id AND event_type = 'view' AND t >= a0) AS i1 FROM a),
c AS (SELECT b.*, (SELECT min(t) FROM e WHERE e.user_id = b.user_id AND event_type = 'purchase' AND value > 60 AND t >= i1) AS i2 FROM b)
SELECT user_id AS actor, round(a0, 3) AS signup_t, round(coalesce(i1, a1), 3) AS view_t, round(coalesce(i2, a2), 3) AS purchase_t, CAST(a0 IS NOT NULL AS INT) + CAST(i1 IS NOT NULL AS INT) + CAST(i2 IS NOT NULL AS INT) AS stages_met, i2 IS NOT NULL AS complete FROM c""",
    "burst_then_later": f"""WITH e AS (SELECT * FROM {_EV}), c AS (SELECT user_id, floor(t / {DAY}) AS bin, count(DISTINCT event_type) AS n, max(t) AS burst_t FROM e GROUP BY ALL HAVING count(DISTINCT event_type) >= 3),
b AS (SELECT user_id, min(burst_t) AS burst_t, arg_min(n, burst_t) AS n FROM c GROUP BY 1)
SELECT b.user_id AS key, round(burst_t, 3) AS burst_t, n, round(min(e.t), 3) AS later_t, arg_min(e.event_id, e.t) AS event_id FROM b JOIN e ON e.user_id = b.user_id AND e.event_type = 'purchase' AND e.t >= burst_t GROUP BY ALL""",
    "ticket_tiers": f"""WITH {_TICKETS}, x AS (SELECT id, CASE WHEN p.hash IS NOT NULL THEN CASE WHEN i.hash IS NULL THEN 'golden' WHEN i.ip <> p.ip THEN 'pass-the-ticket' END WHEN p.account NOT IN (SELECT account FROM issued) THEN 'possible-golden' END AS tier FROM presented p LEFT JOIN issued i ON i.hash = p.hash)
SELECT tier, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM x WHERE tier IS NOT NULL GROUP BY 1""",
    "ledger_classes": f"""WITH {_TICKETS}, x AS (SELECT id, CASE WHEN i.hash IS NOT NULL AND i.ip <> p.ip THEN 'CONTEXT-DIVERGENCE' WHEN i.hash IS NOT NULL THEN 'CONFIRMED' ELSE 'GAP' END AS outcome FROM presented p LEFT JOIN issued i ON i.hash = p.hash)
SELECT outcome, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM x GROUP BY 1""",
    "path_completeness": """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY 1), p AS (SELECT *, ['signup', 'view', 'click', 'purchase'] AS path FROM s),
q AS (SELECT *, list_filter(path, lambda x: list_contains(s, x)) AS seen FROM p), r AS (SELECT *, coalesce(list_max(list_transform(seen, lambda x: list_position(path, x))), 0) AS deep FROM q)
SELECT user_id, round(len(seen) / 4, 4) AS coverage, round(deep / 4, 4) AS reach, CASE WHEN deep < 4 THEN path[deep + 1] END AS frontier, array_to_string(list_filter(path[1:deep], lambda x: NOT list_contains(seen, x)), ',') AS gaps FROM r""",
    "transition_matrix": f"""WITH x AS (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM {_EV})
SELECT a AS state, b AS next_state, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM (SELECT a, b, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY a, b)""",
    "token_idf": f"WITH t AS (SELECT DISTINCT * FROM {_TOK}) SELECT token, count(*) AS df, round(ln((SELECT count(DISTINCT p_partkey) FROM t) / count(*)), 9) AS idf FROM t GROUP BY 1",
    "lattice_edges": f"{_LAT} SELECT rel, count(*) AS n, CAST(sum(a + b) AS BIGINT) AS ids, round(sum(tightness), 3) AS tightness FROM l GROUP BY 1",
    "exact_classes": f"WITH s AS (SELECT p_partkey, list_sort(list(DISTINCT token)) AS s FROM {_TOK} GROUP BY 1) SELECT min(p_partkey) AS class_id, count(*) AS members FROM s GROUP BY s HAVING count(*) > 1",
    "edge_components": f"""WITH RECURSIVE {_LAT[5:]}, g AS MATERIALIZED (SELECT a, b FROM l WHERE rel IN ('exact', 'close')), h AS MATERIALIZED (SELECT a, b FROM g UNION SELECT b, a FROM g),
r(node, root) AS (SELECT DISTINCT a, a FROM h UNION SELECT h.b, r.root FROM r JOIN h ON h.a = r.node WHERE r.root < h.b)
SELECT component, count(*) AS members FROM (SELECT node, min(root) AS component FROM r GROUP BY 1) GROUP BY 1""",
    "fca_concept_groups": """WITH t AS (SELECT p_partkey, array_to_string(list_sort(list(DISTINCT token)), ' ') AS tokens FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS token FROM part) GROUP BY 1)
SELECT coalesce(tokens, '') AS tokens, count(*) AS members, min(part.p_partkey) AS first FROM part LEFT JOIN t USING (p_partkey) GROUP BY 1""",
    "over_collapse": "SELECT p_brand AS slice, count(*) AS n, count(DISTINCT p_type) AS blind, count(DISTINCT (p_type, p_size, p_name)) AS aware, round(count(DISTINCT (p_type, p_size, p_name)) / count(DISTINCT p_type), 9) AS ratio FROM part GROUP BY 1 HAVING count(*) >= 10",
    "cross_corpus": "WITH t AS (SELECT source, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS token FROM documents WHERE source IS NOT NULL), d AS (SELECT token, array_to_string(list_sort(list(DISTINCT source)), '+') AS corpora FROM t GROUP BY 1) SELECT corpora, count(*) AS n_tokens FROM d GROUP BY 1",
    "coverage_tiers": """SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) THEN 'direct' WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990) THEN 'bridged'
WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 'coarse' WHEN n_regionkey < 3 THEN 'uncovered' ELSE 'no-reference' END AS tier FROM nation""",
    "closure_up": f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r(start, node) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey FROM orders UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node) SELECT start, node FROM r",
    "closure_down": f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), r(start, node) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT r.start, e.src FROM r JOIN e ON e.dst = r.node) SELECT start, count(*) AS reached FROM r GROUP BY 1",
    "flow_taint": "SELECT 'o' || o_orderkey AS sink, 'n' || n_nationkey AS source FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    "bridge_compose": "SELECT 'r:' || n_regionkey AS source, count(*) AS targets FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "belnap_folds": f"""WITH c AS (SELECT source, CASE WHEN quality = 1 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS v FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, bit_or(v) AS o, bit_and(v) AS a FROM c GROUP BY 1)
SELECT source, {_name('o')} AS k_join, {_name('a')} AS k_meet, {_name('((o & 1) | (a & 2))')} AS t_join, {_name('((a & 1) | (o & 2))')} AS t_meet, {_name('(((a & 1) << 1) | ((o & 2) >> 1))')} AS negated FROM g""",
    "llr_fuse": f"SELECT entity, count(*) AS detections, round(sum(ln(0.9 / p_value)), 6) AS log_odds FROM {_FLAGGED} GROUP BY 1",
    "tier_meet": "SELECT c_nationkey, min(CASE WHEN c_acctbal < -990 THEN 0 WHEN c_acctbal < -900 THEN 1 WHEN c_acctbal < 0 THEN 2 ELSE 3 END) AS tier FROM customer GROUP BY 1",
    "dag_confidence": """WITH c AS (SELECT n_nationkey, n_regionkey, sum(CASE WHEN o_orderstatus = 'F' THEN 0.5 END) AS l FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT 'n' || n_nationkey AS node, CASE WHEN l IS NULL THEN 'none' ELSE 'true' END AS belnap, round(CAST(l AS DOUBLE), 6) AS log_odds FROM c
UNION ALL SELECT 'r' || r_regionkey, CASE WHEN sum(l) IS NULL THEN 'none' ELSE 'true' END, round(CAST(sum(l) AS DOUBLE), 6) FROM region LEFT JOIN c ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
    "verdicts": f"SELECT entity, bin, round(1 / (1 + exp(-ln(0.9 / p_value))), 6) AS score, 'true' AS decision, CASE WHEN distinct_values > 2 THEN 'true' ELSE 'both' END AS cross_check, 0.4::DOUBLE AS w_score, 'well_formed' AS guarantee FROM {_FLAGGED}",
    "prov_triples": """SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'http://www.w3.org/ns/prov#wasGeneratedBy', (SELECT count(*) FROM nation)
UNION ALL SELECT 'http://www.w3.org/ns/prov#wasDerivedFrom', (SELECT count(*) FROM nation) UNION ALL SELECT 'http://www.w3.org/ns/prov#used', (SELECT count(*) FROM nation) UNION ALL SELECT 'violations', (SELECT count(*) FROM region)""",
}
