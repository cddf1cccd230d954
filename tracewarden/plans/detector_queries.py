"""Detector queries over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import stats
from tracewarden.operators import detectors as d

DAY = 86_400


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", d.seconds("ts").alias("t"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", d.seconds("l_shipdate").alias("t"))


def fanout_entropy(spark, f):
    c = d.fanout_cells(_events(spark, f), "user_id", "event_type", F.col("t"), DAY)
    return c.select("entity", "bin", F.round("entropy", 9).alias("entropy"), "distinct_values", "n_events")


def fanout_conformal(spark, f):
    c = d.fanout_detect(_events(spark, f), "user_id", "event_type", F.col("t"), DAY, alpha=0.05)
    return c.select("entity", "bin", F.round("entropy", 9).alias("entropy"), "distinct_values", F.round("p_value", 9).alias("p_value"), "flagged")


def fanout_supplier(spark, f):
    c = d.fanout_detect(_lines(spark, f), "l_suppkey", "l_partkey", F.col("t"), 30 * DAY, alpha=0.01)
    return c.where("flagged").select("entity", "bin", F.round("entropy", 9).alias("entropy"), "distinct_values", F.round("p_value", 9).alias("p_value"))


def fanout_distinct(spark, f):
    return d.fanout_distinct(_events(spark, f), "user_id", "event_type", F.col("t"), DAY, 2)


def fdr_bh(spark, f):
    c = d.fdr(fanout_conformal(spark, f), "p_value", q=0.2)
    return c.select("entity", "bin", "p_value", F.round("q_value", 9).alias("q_value"), "rejected")


def fdr_by(spark, f):
    c = d.fdr(fanout_conformal(spark, f), "p_value", q=0.2, method="by")
    return c.select("entity", "bin", "p_value", F.round("q_value", 7).alias("q_value"), "rejected")


def offhours_conformal(spark, f):
    c = d.offhours(_events(spark, f), "user_id", F.col("t"), alpha=0.05, least_events=5, least_r=0.0, hours=(0.0, 24.0))
    return c.select("event_id", "user_id", F.round("distance", 6).alias("distance"), F.round("p_value", 6).alias("p_value"))


def circular_activity(spark, f):
    m = stats.circular(F.pmod(F.col("t"), F.lit(86400.0)) / 3600.0, 24.0)
    out = _events(spark, f).groupBy("user_id").agg(F.count("*").alias("n"), m["resultant"].alias("resultant"), m["mean"].alias("mean_hour"), m["variance"].alias("variance"))
    return out.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("resultant", "mean_hour", "variance")))


def rare_actors(spark, f):
    c = d.rare_actors(_events(spark, f).where("event_type = 'error'"), "user_id", 0.005)
    return c.select("user_id", "n", F.round("share", 9).alias("share"))


def _halves(spark, f):
    o = table(spark, f, "orders")
    return [d.learn_baseline(o.where(f"o_orderkey % 2 = {k}"), "o_custkey", "o_totalprice") for k in (0, 1)]


def baseline_learn(spark, f):
    b = d.learn_baseline(table(spark, f, "orders"), "o_custkey", "o_totalprice")
    return b.select("entity", "n", F.round("total", 4).alias("total"), F.round(F.col("squares") / 1e6, 4).alias("squares"))


def baseline_blend(spark, f):
    b = d.blend_baselines(*_halves(spark, f))
    return b.select("entity", "n", F.round("total", 4).alias("total"), F.round(F.col("squares") / 1e6, 4).alias("squares"))


def baseline_credibility(spark, f):
    c = d.credibility(d.blend_baselines(*_halves(spark, f)))
    return c.select("entity", "n", *(F.round(x, 6).alias(x) for x in ("z", "own_mean", "population", "estimate")))


def coordination_pairs(spark, f):
    return d.coordination(d.activity(_events(spark, f), "user_id", F.col("t"), DAY), digits=9)


def activity_features(spark, f):
    c = d.activity_features(d.activity(_events(spark, f), "user_id", F.col("t"), DAY))
    return c.select("entity", "active", F.round("rate", 9).alias("rate"), F.round("entropy", 9).alias("entropy"))


def kl_from_baseline(spark, f):
    docs = table(spark, f, "documents")
    counts = docs.groupBy("source", "lang").agg(F.count("*").alias("n"))
    base = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return stats.kl_divergence(counts, base, "lang", ["source"]).select("source", F.round("kl", 9).alias("kl"))


def mutual_information(spark, f):
    e = _events(spark, f).withColumn("hour", F.floor(F.col("t") / 3600) % 24)
    return stats.mutual_information(e, "event_type", "hour", ["user_id"]).select("user_id", F.round("mi", 9).alias("mi"))


def concentration(spark, f):
    counts = _lines(spark, f).groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    out = counts.groupBy("l_suppkey").agg(F.count("*").alias("distinct_parts"), stats.herfindahl(F.col("n")).alias("hhi"))
    return out.withColumn("hhi", F.round("hhi", 9))


QUERIES = {x.__name__: x for x in (fanout_entropy, fanout_conformal, fanout_supplier, fanout_distinct, fdr_bh, fdr_by, offhours_conformal, circular_activity, rare_actors, baseline_learn, baseline_blend, baseline_credibility, coordination_pairs, activity_features, kl_from_baseline, mutual_information, concentration)}

_T = "epoch_us(ts) / 1e6"
_H = "round(coalesce(-sum(n / tot * ln(n / tot) / ln(2)), 0), 12)"


def _cells(source: str) -> str:
    return f"""c AS (SELECT entity, bin, value, count(*) AS n FROM ({source}) GROUP BY ALL),
k AS (SELECT entity, bin, round(-list_sum(list_transform(list_sort(list(n)), lambda x: x / tot * ln(x / tot) / ln(2))), 12) + 0.0 AS entropy, count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS n_events
      FROM (SELECT *, sum(n) OVER (PARTITION BY entity, bin) AS tot FROM c) GROUP BY entity, bin, tot)"""


_EV = f"SELECT user_id AS entity, event_type AS value, CAST(floor({_T} / {DAY}) AS BIGINT) AS bin FROM events"
_LI = f"SELECT l_suppkey AS entity, l_partkey AS value, CAST(floor(epoch_us(l_shipdate) / 1e6 / {30 * DAY}) AS BIGINT) AS bin FROM lineitem"
_P = "(1.0 + count(*) OVER (ORDER BY entropy DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / (count(*) OVER () + 1)"
_FC = f"WITH {_cells(_EV)}, p AS (SELECT *, {_P} AS p_value FROM k)"
_HALF = "SELECT o_custkey AS entity, count(*) AS n, sum(o_totalprice) AS total, sum(o_totalprice * o_totalprice) AS squares FROM orders GROUP BY 1"
_BASE = f"SELECT entity, n, round(total, 4) AS total, round(squares / 1e6, 4) AS squares FROM ({_HALF})"
_HOUR = f"({_T} - floor({_T} / 86400) * 86400) / 3600.0"
_ANGLE = f"{_HOUR} * {2 * math.pi / 24!r}"


def _fdr(by: bool, digits: int) -> str:
    c = "(SELECT list_sum(list_transform(range(1, count(*) + 1), lambda k: 1.0 / k)) FROM r)" if by else "1.0"
    return f"""{_FC}, r AS (SELECT entity, bin, round(p_value, 9) AS p_value FROM p),
l AS (SELECT *, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS rk, count(*) OVER () AS m FROM r),
q AS (SELECT *, least(1.0, min(m * {c} / rk * p_value) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q_value FROM l)
SELECT entity, bin, p_value, round(q_value, {digits}) AS q_value, q_value <= 0.2 AS rejected FROM q"""


def _h2(*counts: str) -> str:
    total = " + ".join(counts)
    return "round(0.0" + "".join(f" - CASE WHEN {c} > 0 THEN {c} / ({total}) * ln({c} / ({total})) / ln(2) ELSE 0 END" for c in counts) + ", 12)"


ORACLES = {
    "fanout_entropy": f"WITH {_cells(_EV)} SELECT entity, bin, round(entropy, 9) AS entropy, distinct_values, n_events FROM k",
    "fanout_conformal": f"{_FC} SELECT entity, bin, round(entropy, 9) AS entropy, distinct_values, round(p_value, 9) AS p_value, p_value <= 0.05 AS flagged FROM p",
    "fanout_supplier": f"WITH {_cells(_LI)}, p AS (SELECT *, {_P} AS p_value FROM k) SELECT entity, bin, round(entropy, 9) AS entropy, distinct_values, round(p_value, 9) AS p_value FROM p WHERE p_value <= 0.01",
    "fanout_distinct": f"SELECT entity, max(n) AS most, count(*) AS bins FROM (SELECT entity, bin, count(DISTINCT value) AS n FROM ({_EV}) GROUP BY ALL) WHERE n > 2 GROUP BY entity",
    "fdr_bh": _fdr(False, 9),
    "fdr_by": _fdr(True, 7),
    "offhours_conformal": f"""WITH e AS (SELECT event_id, user_id, {_HOUR} AS h FROM events),
g AS (SELECT user_id FROM e GROUP BY 1 HAVING count(*) >= 5),
m AS (SELECT atan2(avg(sin(h * {2 * math.pi / 24!r})), avg(cos(h * {2 * math.pi / 24!r}))) * {24 / (2 * math.pi)!r} AS a FROM e),
x AS (SELECT e.*, abs(h - CASE WHEN a < 0 THEN a + 24 ELSE a END) AS w FROM e, m),
y AS (SELECT *, round(least(w, 24 - w), 9) AS distance FROM x),
p AS (SELECT *, (1.0 + count(*) OVER (ORDER BY distance DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / (count(*) OVER () + 1) AS p_value FROM y)
SELECT event_id, user_id, round(distance, 6) AS distance, round(p_value, 6) AS p_value FROM p WHERE user_id IN (SELECT user_id FROM g)""",
    "circular_activity": f"""WITH a AS (SELECT user_id, count(*) AS n, avg(sin({_ANGLE})) AS s, avg(cos({_ANGLE})) AS c FROM events GROUP BY 1),
b AS (SELECT *, sqrt(s * s + c * c) AS r, atan2(s, c) * {24 / (2 * math.pi)!r} AS m FROM a)
SELECT user_id, n, round(r, 6) AS resultant, round(CASE WHEN m < 0 THEN m + 24 ELSE m END, 6) AS mean_hour, round(1 - r, 6) AS variance FROM b""",
    "rare_actors": "SELECT * FROM (SELECT user_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events WHERE event_type = 'error' GROUP BY 1) WHERE share < 0.005",
    "baseline_learn": _BASE,
    "baseline_blend": _BASE,
    "baseline_credibility": f"""WITH b AS ({_HALF}), w AS (SELECT sum(total) / sum(n) AS population FROM b)
SELECT entity, n, round(n / (n + 20.0), 6) AS z, round(total / n, 6) AS own_mean, round(population, 6) AS population,
       round(n / (n + 20.0) * (total / n) + (1 - n / (n + 20.0)) * population, 6) AS estimate FROM b, w""",
    "coordination_pairs": f"""WITH x AS (SELECT DISTINCT entity, bin FROM ({_EV})), s AS (SELECT CAST(max(bin) - min(bin) + 1 AS DOUBLE) AS w FROM x),
n AS (SELECT entity, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1),
m AS (SELECT a.entity AS a, b.entity AS b, CAST(count(*) AS DOUBLE) AS n11 FROM x a JOIN x b ON a.bin = b.bin AND a.entity < b.entity GROUP BY ALL),
j AS (SELECT p.entity AS a, q.entity AS b, coalesce(n11, 0.0) AS n11 FROM n p JOIN n q ON p.entity < q.entity LEFT JOIN m ON m.a = p.entity AND m.b = q.entity),
r AS (SELECT a, b, n11, p.n AS na, q.n AS nb, w FROM j JOIN n p ON p.entity = a JOIN n q ON q.entity = b, s)
SELECT a, b, round(greatest(0.0, {_h2("na", "(w - na)")} + {_h2("nb", "(w - nb)")} - {_h2("n11", "(na - n11)", "(nb - n11)", "(w - na - nb + n11)")}), 9) AS mi,
       round(CASE WHEN na * (w - na) * nb * (w - nb) > 0 THEN (w * n11 - na * nb) / sqrt(na * (w - na) * nb * (w - nb)) ELSE 0 END, 9) AS pearson FROM r""",
    "activity_features": f"""WITH x AS (SELECT DISTINCT entity, bin FROM ({_EV})), s AS (SELECT CAST(max(bin) - min(bin) + 1 AS DOUBLE) AS w FROM x), n AS (SELECT entity, count(*) AS n FROM x GROUP BY 1)
SELECT entity, n AS active, round(n / w, 9) AS rate, round({_h2("n", "(w - n)")}, 9) AS entropy FROM n, s""",
    "kl_from_baseline": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT lang, count(*) AS q FROM documents GROUP BY 1),
x AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p, q / (SELECT sum(q) FROM b) AS q FROM c JOIN b USING (lang))
SELECT source, round(sum(p * ln(p / q) / ln(2)), 9) AS kl FROM x GROUP BY source""",
    "mutual_information": f"""WITH e AS (SELECT user_id, event_type AS x, CAST(floor({_T} / 3600) AS BIGINT) % 24 AS y FROM events), t AS (SELECT user_id, count(*) AS tot FROM e GROUP BY 1),
hx AS (SELECT user_id, {_H} AS h FROM (SELECT user_id, x, count(*) AS n FROM e GROUP BY ALL) JOIN t USING (user_id) GROUP BY 1),
hy AS (SELECT user_id, {_H} AS h FROM (SELECT user_id, y, count(*) AS n FROM e GROUP BY ALL) JOIN t USING (user_id) GROUP BY 1),
hxy AS (SELECT user_id, {_H} AS h FROM (SELECT user_id, x, y, count(*) AS n FROM e GROUP BY ALL) JOIN t USING (user_id) GROUP BY 1)
SELECT user_id, round(greatest(0.0, hx.h + hy.h - hxy.h), 9) AS mi FROM hx JOIN hy USING (user_id) JOIN hxy USING (user_id)""",
    "concentration": "SELECT l_suppkey, count(*) AS distinct_parts, round(sum(s * s), 9) AS hhi FROM (SELECT l_suppkey, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS s FROM lineitem GROUP BY l_suppkey, l_partkey) GROUP BY 1",
}
