"""Batch twins of the streaming detectors, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import detectors
from tracewarden.streaming import detect

from .detector_queries import DAY, table


def windowed_fanout(spark, f):
    out = detect.windowed_fanout(table(spark, f, "events"), "user_id", "event_type", "ts", "1 day")
    return out.select("entity", F.date_format("start", "yyyy-MM-dd").alias("start"), "distinct_values", "n_events", F.round("entropy", 9).alias("entropy"))


def shadow_alerts(spark, f):
    """Users who sign up, then view, then purchase, within a decaying horizon."""
    e = table(spark, f, "events").select("user_id", "event_type", detectors.seconds("ts").alias("t"))
    rules = detect.ShadowRules(tuple(detect.first_with("event_type", x) for x in ("signup", "view", "purchase")), fire_at=3, tau=5 * DAY)
    return detect.shadow_alerts(e, rules, "user_id", "t", ["event_type"])


def anchor_beliefs(spark, f):
    """Belief per user from errors as evidence, fading over ten days."""
    e = table(spark, f, "events").where("event_type = 'error'").select("user_id", detectors.seconds("ts").alias("t"), (F.col("value") / 50).alias("llr"))
    out = detect.beliefs(e, "user_id", "t", "llr", 0.01, 10 * DAY)
    return out.select(F.col("anchor").cast("long").alias("anchor"), *(F.round(c, 6).alias(c) for c in ("log_odds", "peak", "probability")), "n")


QUERIES = {x.__name__: x for x in (windowed_fanout, shadow_alerts, anchor_beliefs)}

ORACLES = {
    "windowed_fanout": """WITH c AS (SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY entity, start) AS p FROM c)
SELECT entity, start, count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS n_events, round(-sum(p * ln(p) / ln(2)) + 0.0, 9) AS entropy FROM t GROUP BY ALL""",
    "anchor_beliefs": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value / 50 AS llr, row_number() OVER (PARTITION BY user_id ORDER BY ts, value / 50) AS k FROM events WHERE event_type = 'error'),
r(user_id, k, t, lo, peak) AS (SELECT user_id, k, t, ln(0.01 / 0.99) + llr, greatest(ln(0.01 / 0.99), ln(0.01 / 0.99) + llr) FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.t, ln(0.01 / 0.99) + (r.lo - ln(0.01 / 0.99)) * exp(-(e.t - r.t) / 864000) + e.llr, greatest(r.peak, ln(0.01 / 0.99) + (r.lo - ln(0.01 / 0.99)) * exp(-(e.t - r.t) / 864000) + e.llr) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id AS anchor, round(arg_max(lo, k), 6) AS log_odds, round(max(peak), 6) AS peak, round(1 / (1 + exp(-arg_max(lo, k))), 6) AS probability, max(k) AS n FROM r GROUP BY 1""",
}
