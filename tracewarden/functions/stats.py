"""Statistics as Column expressions and small aggregates: entropy, concentration, divergence, circular moments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 12


def log2(c: Column) -> Column:
    return F.log(c) / F.lit(math.log(2.0))


def entropy_from_sums(total: Column, weighted: Column) -> Column:
    """Shannon entropy in bits from the sum of counts n and the sum of n * log2(n): log2(S) - W / S; nothing gives 0."""
    h = F.greatest(F.lit(0.0), F.round(log2(total) - weighted / total, DIGITS))
    return F.when(total > 0, h).otherwise(0.0)


def entropy(n: Column) -> Column:
    """Aggregate: entropy in bits of the counts n, of which nulls and zeros are ignored.

    Two sums, combined before the shuffle. The second is a decimal one, so that the order of rows does not show.
    """
    n = n.cast("double")
    term = F.when(n > 0, (n * log2(n)).cast("decimal(32,14)"))
    return entropy_from_sums(F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0.0)), F.sum(term).cast("double"))


def herfindahl(n: Column) -> Column:
    """Aggregate: sum of squared shares of the counts n; nothing gives 0."""
    n = n.cast("double")
    total = F.coalesce(F.sum(n), F.lit(0.0))
    return F.when(total > 0, F.sum(n * n) / (total * total)).otherwise(0.0)


def _two_sums(counts: Column, second) -> Column:
    """Of an array of counts in ascending order: struct of their sum s and the sum w of second(n), in one pass."""
    kept = F.sort_array(F.transform(F.filter(counts, lambda x: x > 0), lambda x: x.cast("double")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(kept, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["w"] + second(x)).alias("w")))


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; zeros are ignored, nothing gives 0.

    Counts are folded in ascending order and the result is rounded, so that equal multisets give equal numbers.
    """
    sums = _two_sums(counts, lambda x: x * log2(x))
    return F.aggregate(F.array(sums), F.lit(0.0), lambda _, a: entropy_from_sums(a["s"], a["w"]))


def herfindahl_of_counts(counts: Column) -> Column:
    """Sum of squared shares of an array of counts; nothing gives 0."""
    sums = _two_sums(counts, lambda x: x * x)
    return F.aggregate(F.array(sums), F.lit(0.0), lambda _, a: F.when(a["s"] > 0, a["w"] / (a["s"] * a["s"])).otherwise(0.0))


def kl_divergence(counts: DataFrame, base: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Per group KL(p || base) in bits over common support: counts(group.., key, n) against base(key, n).

    Only keys with both counts positive contribute; no common support gives +infinity. Groups without rows don't appear.
    """
    p_all = counts.where("n > 0").groupBy(*group).agg(F.sum("n").alias("p_total"))
    q_all = base.where("n > 0").agg(F.sum("n").alias("q_total"))
    joined = counts.where("n > 0").join(p_all, group).join(base.where("n > 0").select(key, F.col("n").alias("q")), key, "left").crossJoin(F.broadcast(q_all))
    p, q = F.col("n") / F.col("p_total"), F.col("q") / F.col("q_total")
    term = F.when(F.col("q").isNotNull(), p * log2(p / q))
    out = joined.groupBy(*group).agg(F.sum(term).alias("kl"))
    return out.withColumn("kl", F.coalesce("kl", F.lit(float("inf"))))


def mutual_information(rows: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Per group plug-in mutual information of two columns in bits, never negative."""
    joint = rows.groupBy(*group, x, y).agg(F.count("*").alias("n"))

    def h(cols: list[str], name: str) -> DataFrame:
        c = joint.groupBy(*group, *cols).agg(F.sum("n").alias("n"))
        return c.groupBy(*group).agg(entropy(F.col("n")).alias(name))

    out = h([x], "hx").join(h([y], "hy"), group).join(h([x, y], "hxy"), group)
    return out.select(*group, F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"))


def circular(value: Column, period: float) -> dict[str, Column]:
    """Aggregates: mean on [0, period), resultant length and variance of a cyclic value."""
    angle = value * (2 * math.pi / period)
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    mean = F.pmod(F.atan2(s, c) * (period / (2 * math.pi)), F.lit(float(period)))
    r = F.sqrt(s * s + c * c)
    return {"mean": mean, "resultant": r, "variance": F.lit(1.0) - r}


def circular_distance(a: Column, b: Column, period: float) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(float(period)))
    return F.least(d, F.lit(float(period)) - d)


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate((a, b))
    d = float(np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max())
    n = math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    x = (n + 0.12 + 0.11 / n) * d
    if x < 0.2:
        return d, 1.0
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return d, min(1.0, max(0.0, p))


def chi2_quantile(p: float, dof: int) -> float:
    """Upper quantile x with P(X > x) = p, by bisection on the regularised upper gamma function."""

    def upper(x: float) -> float:
        a, x = dof / 2, x / 2
        if x <= 0:
            return 1.0
        if x < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > 1e-16 * abs(total):
                k += 1
                term *= x / k
                total += term
            return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
        tiny = 1e-300
        b = x + 1 - a
        c, d = 1 / tiny, 1 / b
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = an * d + b
            d = 1 / (d if abs(d) > tiny else tiny)
            c = b + an / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 0.0, float(dof + 10)
    while upper(hi) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) > p else (lo, mid)
    return (lo + hi) / 2
