"""Queries on facts, entailment and vocabularies over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import entailment as e
from tracewarden.operators import rules

from .detector_queries import table

#: Predicates on parts, by number: two chains of implications and two types that exclude each other.
FACTS = ("p_size > 40", "p_size > 20", "p_size > 10", "p_type LIKE 'PROMO BRUSHED%'", "p_type LIKE 'PROMO%'", "p_brand LIKE 'Brand#4%'")
IMPLIES = [(0, 1), (1, 2), (0, 2), (3, 4)]
EXCLUDES = [(4, 5)]


def _parts(spark, f):
    """Facts as they may be recorded: the middle of a chain is unknown for large parts, the end of it claimed by brand."""
    seen = [F.expr(x) for x in FACTS]
    seen[1] = F.when(F.col("p_size") <= 45, seen[1])
    seen[2] = F.when(F.col("p_brand") < "Brand#3", F.col("p_brand") < "Brand#2")
    seen[4] = F.when(F.col("p_size") % 2 == 1, seen[4])
    return table(spark, f, "part").select("p_partkey", F.array(*seen).alias("facts"))


def derived_facts(spark, f):
    """How often each predicate is true, false and unknown once consequences are drawn."""
    d = e.derive(_parts(spark, f), "facts", IMPLIES).select(F.posexplode("facts").alias("atom", "truth"))
    return d.groupBy("atom").agg(F.count_if("truth").alias("true_"), F.count_if(~F.col("truth")).alias("false_"), F.count_if(F.col("truth").isNull()).alias("unknown"))


def fact_contradictions(spark, f):
    d = e.contradictions(e.derive(_parts(spark, f), "facts", IMPLIES), "facts", IMPLIES, EXCLUDES, ["p_partkey"])
    return d.groupBy("kind", "a", "b").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("ids"))


def _order_rules() -> list[rules.Rule]:
    raw = [
        {"id": "urgent", "detection": {"s": {"priority|startswith": "1", "status": "o"}, "condition": "s"}},
        {"id": "large", "detection": {"s": {"price|gte": "200000"}, "k": {"clerk|endswith": "7"}, "condition": "s and k"}},
        {"id": "quiet", "detection": {"s": {"status": ["F", "P"]}, "x": {"comment|contains": ["fur", "quick"]}, "condition": "s and not x"}},
        {"id": "either", "detection": {"a": {"priority": "5-LOW"}, "b": {"clerk|endswith|all": ["3", "13"]}, "condition": "1 of them"}},
    ]
    return [rules.compile_rule(r) for r in raw]


_FIELDS = {"priority": "o_orderpriority", "status": "o_orderstatus", "price": "o_totalprice", "clerk": "o_clerk", "comment": "o_comment"}


def _orders(spark, f):
    d = table(spark, f, "orders")
    for c in ("o_clerk", "o_comment"):  # not all tables have them
        if c not in d.columns:
            d = d.withColumn(c, F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string")))
    return d


def entailed_rules(spark, f):
    """Hits per rule, and how many evaluations the facts saved."""
    return e.entail(_orders(spark, f), _order_rules(), *rules.column_access(_FIELDS))


def entailment_agreement(spark, f):
    return e.attest(_orders(spark, f), _order_rules(), ["o_orderkey"], *rules.column_access(_FIELDS))


def rewritten_rules(spark, f):
    """Rules rewritten to the events' own names of fields, fired behind the guard."""
    names = {c: c for c in _FIELDS.values()}
    d = e.guarded_fire(_orders(spark, f), _order_rules(), ["o_orderkey"], *rules.column_access(names), e.Vocabulary("tables"), e.Vocabulary("short"), _FIELDS)
    return d.groupBy("rule_id").agg(F.count("*").alias("hits"), F.sum("o_orderkey").alias("ids"))


QUERIES = {x.__name__: x for x in (derived_facts, fact_contradictions, entailed_rules, entailment_agreement, rewritten_rules)}

_SEEN = """s AS (SELECT p_partkey, p_size > 40 AS f0, CASE WHEN p_size <= 45 THEN p_size > 20 END AS f1, CASE WHEN p_brand < 'Brand#3' THEN p_brand < 'Brand#2' END AS f2,
p_type LIKE 'PROMO BRUSHED%' AS f3, CASE WHEN p_size % 2 = 1 THEN p_type LIKE 'PROMO%' END AS f4, p_brand LIKE 'Brand#4%' AS f5 FROM part),
d1 AS (SELECT p_partkey, f0, CASE WHEN f1 IS NULL AND f0 THEN TRUE ELSE f1 END AS f1, f2, f3, CASE WHEN f4 IS NULL AND f3 THEN TRUE ELSE f4 END AS f4, f5 FROM s),
d AS (SELECT * REPLACE (CASE WHEN f2 IS NULL AND (coalesce(f0, FALSE) OR coalesce(f1, FALSE)) THEN TRUE ELSE f2 END AS f2) FROM d1)"""
_CLERK = "('Clerk#' || o_custkey)"
_HITS = {
    "urgent": ("o_orderpriority LIKE '1%' AND o_orderstatus = 'O'", "o_orderpriority LIKE '1%' OR o_orderstatus = 'O'"),
    "large": (f"o_totalprice >= 200000 AND {_CLERK} LIKE '%7'", f"o_totalprice >= 200000 OR {_CLERK} LIKE '%7'"),
    "quiet": (f"o_orderstatus IN ('F', 'P') AND NOT (lower({_CLERK}) LIKE '%fur%' OR lower({_CLERK}) LIKE '%quick%')", "TRUE"),
    "either": (f"o_orderpriority = '5-LOW' OR ({_CLERK} LIKE '%3' AND {_CLERK} LIKE '%13')", f"o_orderpriority = '5-LOW' OR ({_CLERK} LIKE '%3' AND {_CLERK} LIKE '%13')"),
}

ORACLES = {
    "derived_facts": f"WITH {_SEEN} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS atom, count(*) FILTER (f{i}) AS true_, count(*) FILTER (NOT f{i}) AS false_, count(*) FILTER (f{i} IS NULL) AS unknown FROM d" for i in range(6)),
    "fact_contradictions": f"WITH {_SEEN}, v AS ("
    + " UNION ALL ".join([f"SELECT 'implication' AS kind, {a} AS a, {b} AS b, p_partkey FROM d WHERE f{a} AND NOT f{b}" for a, b in IMPLIES] + [f"SELECT 'exclusion', {a}, {b}, p_partkey FROM d WHERE f{a} AND f{b}" for a, b in EXCLUDES])
    + ") SELECT kind, CAST(a AS INT) AS a, CAST(b AS INT) AS b, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM v GROUP BY ALL",
    "entailed_rules": " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER ({h}) AS hits, count(*) FILTER ({n}) AS evaluated, count(*) FILTER (NOT ({n})) AS pruned FROM orders" for k, (h, n) in _HITS.items()),
    "entailment_agreement": "SELECT CAST(4 AS INT) AS n_rules, 4 * count(*) AS checked, CAST(0 AS BIGINT) AS disagreements, TRUE AS faithful FROM orders",
    "rewritten_rules": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) AS hits, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE {h}" for k, (h, _) in _HITS.items()) + ") WHERE hits > 0",
}
