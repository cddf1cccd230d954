"""Signal queries on daily revenue series (one per order priority), with SQL for DuckDB where SQL can state them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tracewarden.functions.stats import chi2_quantile
from tracewarden.operators import fca
from tracewarden.operators import signal as g

from .detector_queries import table


def _series(spark, f):
    o = table(spark, f, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") / 1000).alias("v"))
    daily = o.groupBy("series_id", "d").agg(F.round(F.sum("v"), 6).alias("x"))
    return daily.select("series_id", F.datediff("d", F.lit("1990-01-01").cast("date")).cast("long").alias("idx"), "x")


def _codes(spark, f):
    return _series(spark, f).withColumn("x", F.floor(F.col("x") / 200).cast("double"))


def cfar_ca(spark, f):
    d = g.ca_cfar(_series(spark, f), pfa=0.01)
    return d.select("series_id", "idx", F.round("threshold", 4).alias("threshold"), "detected")


def cfar_os(spark, f):
    d = g.os_cfar(_series(spark, f), pfa=0.01)
    return d.select("series_id", "idx", F.round("threshold", 4).alias("threshold"), "detected")


def sliding_entropy(spark, f):
    return g.sliding_entropy(_codes(spark, f), 16, 4).withColumn("entropy", F.round("entropy", 9))


def sliding_distinct(spark, f):
    return g.sliding_distinct(_codes(spark, f), 16, 4)


def sliding_herfindahl(spark, f):
    return g.sliding_herfindahl(_codes(spark, f), 16, 4).withColumn("hhi", F.round("hhi", 9))


def sliding_kl(spark, f):
    d = _codes(spark, f).withColumn("x", F.col("x") % 4)
    return g.sliding_kl(d, [4.0, 3.0, 2.0, 1.0], 16, 4).withColumn("kl", F.round("kl", 9))


def energy(spark, f):
    d = g.energy(_series(spark, f), nperseg=32, pfa=0.05)
    return d.select("series_id", "block", F.round("energy", 3).alias("energy"), F.round("statistic", 6).alias("statistic"), "detected")


def goertzel(spark, f):
    d = g.goertzel(_series(spark, f), freq=1 / 7, fs=1.0, nperseg=28)
    return d.select("series_id", "block", F.round("power", 2).alias("power"))


def cusum(spark, f):
    def kernel(x):
        hi, lo, alarm = g.cusum_kernel(x)
        return {"hi": hi, "lo": lo, "alarm": alarm}

    out = g.per_series(_series(spark, f), kernel, "hi double, lo double, alarm int")
    return out.withColumns({"hi": F.round("hi", 6), "lo": F.round("lo", 6)})


def welch(spark, f):
    def kernel(x):
        freq, power = g.welch_kernel(x, 1.0, 64)
        return {"freq": freq, "power": power}

    out = g.per_series(_series(spark, f), kernel, "freq double, power double")
    return out.withColumns({"freq": F.round("freq", 9), "power": F.round("power", 3)})


def butter(spark, f):
    return g.per_series(_series(spark, f), lambda x: {"y": g.zero_phase(x, g.butter_sections(4, 0.05, 1.0))}, "y double")


def notch(spark, f):
    return g.per_series(_series(spark, f), lambda x: {"y": g.zero_phase(x, [g.notch_section(1 / 7, 10.0, 1.0)])}, "y double")


def band_power(spark, f):
    def kernel(x):
        bands = ((0.01, 0.05), (0.05, 0.15), (0.15, 0.4))
        return {"low": np.array([a for a, _ in bands]), "power": np.array([np.mean(g.zero_phase(x - x.mean(), g.butter_sections(2, [a, b], 1.0, "bandpass")) ** 2) for a, b in bands])}

    return g.per_series(_series(spark, f), kernel, "low double, power double")


def lock_in(spark, f):
    def kernel(x):
        amplitude, phase = g.lock_in_kernel(x - x.mean(), 1 / 7, 0.02, 1.0)
        return {"amplitude": amplitude, "phase": phase}

    return g.per_series(_series(spark, f), kernel, "amplitude double, phase double")


def matched_filter(spark, f):
    return g.per_series(_series(spark, f), lambda x: {"score": g.matched_kernel(x - x.mean(), np.sin(2 * np.pi * np.arange(14) / 7))}, "score double").withColumn("score", F.round("score", 6))


def viterbi_roles(spark, f):
    """Hidden states of conversations, from their roles: alternating talk against monologue."""
    c = table(spark, f, "conversations").select(F.col("conv_id").cast("string").alias("series_id"), F.col("turn").cast("long").alias("idx"), F.when(F.col("role") == "user", 0.0).otherwise(1.0).alias("x"))
    t = {"ask": {"ask": 0.3, "answer": 0.7}, "answer": {"ask": 0.7, "answer": 0.3}}
    e = {"ask": {"0": 0.9, "1": 0.1}, "answer": {"0": 0.1, "1": 0.9}}

    def kernel(x):
        return {"state": np.array(g.viterbi([str(int(v)) for v in x], t, e, {"ask": 0.8, "answer": 0.2}), object)}

    return g.per_series(c, kernel, "state string")


def formal_concepts(spark, f):
    """All concepts of brands and size classes, where a brand has a class if its parts there are dearer than all on average."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    p = table(spark, f, "part").select(F.col("p_brand").alias("object"), F.concat(F.lit("s"), F.floor(F.col("p_size") / 10).cast("string")).alias("attribute"), cents.alias("c"))
    cells = p.groupBy("object", "attribute").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    whole = p.agg(F.sum("c").alias("all_c"), F.count("*").alias("all_n"))
    dear = cells.crossJoin(F.broadcast(whole)).where("CAST(c AS DECIMAL(38,0)) * all_n > CAST(all_c AS DECIMAL(38,0)) * n").select("object", "attribute")
    rows = fca.concepts(fca.Context.of(dear))
    return spark.createDataFrame([(",".join(sorted(e)), ",".join(sorted(i))) for e, i in rows], "extent string, intent string")


QUERIES = {x.__name__: x for x in (cfar_ca, cfar_os, sliding_entropy, sliding_distinct, sliding_herfindahl, sliding_kl, energy, goertzel, cusum, welch, butter, notch, band_power, lock_in, matched_filter, viterbi_roles, formal_concepts)}

_S = """s AS (SELECT o_orderpriority AS series_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS idx, round(sum(o_totalprice / 1000), 6) AS x FROM orders GROUP BY ALL)"""
_C = f"{_S}, c AS (SELECT series_id, idx, CAST(floor(x / 200) AS BIGINT) AS x FROM s)"
_CELLS = "OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {} AND {})"
_LEAD, _LAG = _CELLS.format("10 PRECEDING", "3 PRECEDING"), _CELLS.format("3 FOLLOWING", "10 FOLLOWING")


def _windows(value: str, stat: str, name: str) -> str:
    return f"""WITH {_C}, w AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 16 AS k, list({value}) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS l FROM c),
u AS (SELECT series_id, CAST(k / 4 AS INT) AS "window", l, list_transform(list_distinct(l), lambda v: len(list_filter(l, lambda y: y = v)) / 16.0) AS p FROM w WHERE k >= 0 AND k % 4 = 0)
SELECT series_id, "window", {stat} AS {name} FROM u"""


def _blocks(n: int, agg: str) -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s),
b AS (SELECT series_id, block, {agg} FROM (SELECT series_id, x, CAST(t.block AS INTEGER) AS block, i - t.block * {n // 2} AS j FROM n, unnest(range(0, (n.n - {n}) // {n // 2} + 1)) AS t(block) WHERE n.n >= {n} AND i >= t.block * {n // 2} AND i < t.block * {n // 2} + {n}) GROUP BY ALL)"""


_ALPHA, _RANK = g.ca_alpha(16, 0.01), 12
_Q = [(c + 0.5) / 12 for c in (4.0, 3.0, 2.0, 1.0)]
_KL = " + ".join(f"(len(list_filter(l, lambda y: y = {i})) + 0.5) / 18 * ln((len(list_filter(l, lambda y: y = {i})) + 0.5) / 18 / {q!r}) / ln(2)" for i, q in enumerate(_Q))
_W7 = 2 * math.pi / 7
_SEGMENT = "avg(x) AS m, list({'j': j, 'x': x}) AS l"

ORACLES = {
    "cfar_ca": f"WITH {_S}, t AS (SELECT *, CASE WHEN count(x) {_LEAD} + count(x) {_LAG} = 16 THEN (sum(x) {_LEAD} + sum(x) {_LAG}) / 16 * {_ALPHA!r} END AS th FROM s) SELECT series_id, idx, round(th, 4) AS threshold, coalesce(x > th, FALSE) AS detected FROM t",
    "cfar_os": f"WITH {_S}, t AS (SELECT *, list_sort(list_concat(list(x) {_LEAD}, list(x) {_LAG})) AS c FROM s), v AS (SELECT *, CASE WHEN len(c) = 16 THEN c[{_RANK}] * {g.os_alpha(16, _RANK, 0.01)!r} END AS th FROM t) SELECT series_id, idx, round(th, 4) AS threshold, coalesce(x > th, FALSE) AS detected FROM v",
    "sliding_entropy": _windows("x", "round(list_sum(list_transform(p, lambda q: -q * ln(q) / ln(2))) + 0.0, 9)", "entropy"),
    "sliding_distinct": _windows("x", "CAST(len(p) AS INT)", "distinct_codes"),
    "sliding_herfindahl": _windows("x", "round(list_sum(list_transform(p, lambda q: q * q)), 9)", "hhi"),
    "sliding_kl": _windows("x % 4", f"round({_KL}, 9)", "kl"),
    "energy": f"WITH {_S}, {_blocks(32, 'sum(x * x) AS e')}, m AS (SELECT *, e / (median(e) OVER (PARTITION BY series_id) / {chi2_quantile(0.5, 32)!r}) AS st FROM b) SELECT series_id, block, round(e, 3) AS energy, round(st, 6) AS statistic, st > {chi2_quantile(0.05, 32)!r} AS detected FROM m",
    "goertzel": f"WITH {_S}, {_blocks(28, f'sum(x * cos(j * {_W7!r})) AS re, sum(x * sin(j * {_W7!r})) AS im')} SELECT series_id, block, round(re * re + im * im, 2) AS power FROM b",
    # every set of attributes, the objects that have them all, and the attributes that all of these have
    "formal_concepts": """WITH p AS (SELECT p_brand AS o, 's' || CAST(floor(p_size / 10) AS INT) AS a, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
i AS (SELECT o, a FROM p GROUP BY ALL HAVING CAST(sum(c) AS HUGEINT) * (SELECT count(*) FROM p) > CAST((SELECT sum(c) FROM p) AS HUGEINT) * count(*)),
t AS (SELECT list_sort(list(DISTINCT a)) AS s FROM i),
b AS (SELECT list_filter(s, lambda x: (k >> (list_position(s, x) - 1)) & 1 = 1) AS attrs FROM t, unnest(range(0, CAST(pow(2, (SELECT len(s) FROM t)) AS BIGINT))) AS u(k)),
h AS (SELECT o, list(a) AS own FROM i GROUP BY 1),
x AS (SELECT DISTINCT coalesce(list_sort(l), []) AS ext FROM (SELECT attrs, list(h.o) FILTER (WHERE list_has_all(h.own, attrs)) AS l FROM b, h GROUP BY attrs)),
y AS (SELECT ext, z.a, count(i.o) FILTER (WHERE list_contains(ext, i.o)) AS n FROM x, (SELECT DISTINCT a FROM i) z JOIN i ON i.a = z.a GROUP BY ext, z.a)
SELECT array_to_string(ext, ',') AS extent, array_to_string(coalesce(list(a ORDER BY a) FILTER (WHERE n = len(ext)), []), ',') AS intent FROM y GROUP BY ext""",
    "matched_filter": f"""WITH {_S}, n AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS i, x - avg(x) OVER (PARTITION BY series_id) AS x FROM s)
SELECT a.series_id, a.i AS idx, round(sum(b.x * sin({_W7!r} * (b.i - a.i))) / {math.sqrt(sum(math.sin(_W7 * k) ** 2 for k in range(14)))!r}, 6) AS score
FROM n a JOIN n b ON a.series_id = b.series_id AND b.i BETWEEN a.i AND a.i + 13 GROUP BY ALL HAVING count(*) = 14""",
    "welch": f"""WITH {_S}, {_blocks(64, _SEGMENT)}, y AS (SELECT series_id, block, u.v.j AS j, (u.v.x - m) * (0.5 - 0.5 * cos(j * {2 * math.pi / 64!r})) AS y FROM b, unnest(l) AS u(v)),
d AS (SELECT series_id, block, k, sum(y * cos(j * k * {2 * math.pi / 64!r})) AS re, sum(y * sin(j * k * {2 * math.pi / 64!r})) AS im FROM y, unnest(range(0, 33)) AS t(k) GROUP BY ALL)
SELECT series_id, k AS idx, round(k / 64, 9) AS freq, round(avg(re * re + im * im) / {sum((0.5 - 0.5 * math.cos(2 * math.pi * k / 64)) ** 2 for k in range(64))!r} * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 3) AS power FROM d GROUP BY series_id, k""",
    # per state the best score so far and the path behind it; ties go to `answer`, the first in order
    "viterbi_roles": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN role = 'user' THEN 0.9 ELSE 0.1 END AS e FROM conversations),
r(series_id, i, a, q, pa, pq) AS (SELECT series_id, i, ln(0.2) + ln(1 - e), ln(0.8) + ln(e), ['answer'], ['ask'] FROM o WHERE i = 0
UNION ALL SELECT o.series_id, o.i, greatest(a + ln(0.3), q + ln(0.7)) + ln(1 - e), greatest(a + ln(0.7), q + ln(0.3)) + ln(e), list_append(CASE WHEN a + ln(0.3) >= q + ln(0.7) THEN pa ELSE pq END, 'answer'), list_append(CASE WHEN a + ln(0.7) >= q + ln(0.3) THEN pa ELSE pq END, 'ask')
FROM r JOIN o ON o.series_id = r.series_id AND o.i = r.i + 1), w AS (SELECT series_id, arg_max(CASE WHEN a >= q THEN pa ELSE pq END, i) AS path FROM r GROUP BY 1)
SELECT series_id, t.i - 1 AS idx, path[t.i] AS state FROM w, unnest(range(1, len(path) + 1)) AS t(i)""",
    "cusum": f"""WITH RECURSIVE {_S}, m AS (SELECT series_id, median(x) AS mu FROM s GROUP BY 1), v AS (SELECT series_id, 1.4826 * median(abs(x - mu)) AS sigma FROM s JOIN m USING (series_id) GROUP BY 1),
z AS MATERIALIZED (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS i, (x - mu) / sigma AS z FROM s JOIN m USING (series_id) JOIN v USING (series_id)),
r(series_id, i, hi, lo) AS (SELECT series_id, i, greatest(0.0, z - 0.5), greatest(0.0, -z - 0.5) FROM z WHERE i = 0
UNION ALL SELECT z.series_id, z.i, greatest(0.0, CASE WHEN hi > 5 OR lo > 5 THEN 0.0 ELSE hi END + z - 0.5), greatest(0.0, CASE WHEN hi > 5 OR lo > 5 THEN 0.0 ELSE lo END - z - 0.5) FROM r JOIN z ON z.series_id = r.series_id AND z.i = r.i + 1)
SELECT series_id, i AS idx, round(hi, 6) AS hi, round(lo, 6) AS lo, CAST(CASE WHEN hi > 5 THEN 1 WHEN lo > 5 THEN -1 ELSE 0 END AS INT) AS alarm FROM r""",
}
