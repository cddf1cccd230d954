"""Statistical detectors: fan-out entropy, off-hours activity, rarity, baselines, coordination; conformal p-values and FDR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.stats import DIGITS, circular, circular_distance, entropy, entropy_of_counts
from tracewarden.plans.storage import cut


def seconds(ts: Column | str) -> Column:
    """Epoch seconds (UTC session zone) with fraction, also of timestamps without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def time_bin(t: Column, grain: float) -> Column:
    if grain <= 0:
        raise ValueError("grain must be positive")
    return F.floor(t / F.lit(float(grain))).cast("long")


# ---------------------------------------------------------------- fan-out


PART = 250_000  # events of a part


def fanout_cells(events: DataFrame, entity: str, value: str, t: Column, grain: float) -> DataFrame:
    """One row per (entity, bin): entropy of the values' counts, distinct values, events, and when the bin starts.

    One shuffle, by cell, into parts of some hundred thousand events: hardly two of them may be alike, so counts before it would
    fill a task's memory and save nothing. Cells are folded from counts, never from raw events.
    """
    e = events.select(F.col(entity).alias("entity"), F.col(value).alias("value"), time_bin(t, grain).alias("bin")).where("entity IS NOT NULL AND bin IS NOT NULL")
    e = e.repartition(e.count() // PART + 1, "entity", "bin")
    counts = e.groupBy("entity", "bin", "value").agg(F.count("*").alias("n"))
    cells = counts.groupBy("entity", "bin").agg(entropy(F.col("n")).alias("entropy"), F.count("value").alias("distinct_values"), F.sum("n").alias("n_events"))
    return cells.withColumn("bin_start", F.col("bin") * F.lit(float(grain)))


def buckets(d: DataFrame, key: str, parts: int = 64) -> Column:
    """Number of the range of key into which a row falls, ascending, by at most parts quantiles of d's rows (nulls: 0).

    The quantiles are the only thing that comes to the driver. Ranges are few and of like size, so that running totals can be
    taken within each of them and carried from one to the next as one number a range.
    """
    cuts = d.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000).alias("q")).first()["q"] or []
    cuts = sorted({float(c) for c in cuts})
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)


def running(d: DataFrame, key: str, value: str, out: str, descending: bool = False, agg: Callable = F.sum) -> DataFrame:
    """d, which has each key once, and out: the sum (or least) of value over rows up to this one in order of key.

    No task takes all rows: totals run within ranges of keys, and a range's start is the total of those before it.
    """
    d = d.withColumn("_range", buckets(d, key))
    order, before = (F.desc, F.desc("_range")) if descending else (F.asc, F.asc("_range"))
    parts = d.groupBy("_range").agg(agg(value).alias("_all"))  # one row a range
    parts = parts.select("_range", agg("_all").over(Window.orderBy(before).rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    own = agg(value).over(Window.partitionBy("_range").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_own", own).join(F.broadcast(parts), "_range")
    total = F.col("_own") + F.coalesce("_start", F.lit(0)) if agg is F.sum else F.least("_own", "_start")
    return d.withColumn(out, total).drop("_range", "_own", "_start")


def at_levels(rows: DataFrame, levels: DataFrame, key: str, few: int = 100_000) -> DataFrame:
    """rows with the columns of their level: levels(key, _n, ..), one row for each key, of which _n rows have it.

    Few levels go to all tasks, and rows stay where they are. Among many, rows of one level, or of none, that are more than a
    thousandth of all are dealt to as many tasks as they have thousandths.
    """
    if levels.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(levels.drop("_n")), key, "left")
    total = levels.agg(F.sum("_n").alias("_all"))
    crowded = levels.crossJoin(F.broadcast(total)).where("_n * 1000 > _all").select(key, F.ceil(F.col("_n") * 1000 / F.col("_all")).alias("_shares"))
    dealt = levels.drop("_n").join(F.broadcast(crowded), key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares") - 1, F.lit(0))))).drop("_shares")
    own = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    lone = F.col(key).isNull() | F.isnan(key)
    rows = rows.join(F.broadcast(crowded), key, "left").withColumn("_share", F.pmod(F.xxhash64(*own), F.when(lone, 1000).otherwise(F.coalesce("_shares", F.lit(1)))))
    return rows.drop("_shares").join(dealt, [key, "_share"], "left").drop("_share")


def conformal(rows: DataFrame, score: str, calibration: DataFrame | None = None, tail: str = "upper", by: list[str] | None = None) -> DataFrame:
    """rows with p_value = (1 + number of calibration scores at least as extreme) / (n + 1); non-finite scores give NaN.

    Calibration scores (default: the rows' own) are reduced to counts of distinct rounded values, and only these are ranked,
    range by range. `by` calibrates within groups.
    """
    by = by or []
    key = F.round(F.col(score), DIGITS)
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) != float("inf"))
    cal = (rows if calibration is None else calibration).where(finite).groupBy(*by, key.alias("_k")).agg(F.count("*").alias("_n"))
    size = cal.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if calibration is not None:  # scores from elsewhere are ranked among the others, and count for nothing
        ask = rows.where(finite).select(*by, key.alias("_k"), F.lit(0).cast("long").alias("_n"))
        cal = cal.unionByName(ask).groupBy(*by, "_k").agg(F.sum("_n").alias("_n"))
    if by:
        order = F.desc("_k") if tail == "upper" else F.asc("_k")
        w = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        cal = cal.withColumn("_at_least", F.sum("_n").over(w))
        out = rows.withColumn("_k", F.when(finite, key)).join(cal.drop("_n"), [*by, "_k"], "left").join(size, by, "left")
    else:
        cal = cut(cal)  # ranked, counted and joined from here
        size = cal.agg(F.sum("_n").alias("_total"))
        cal = running(cal, "_k", "_n", "_at_least", descending=tail == "upper")
        if calibration is not None:
            cal = cal.withColumn("_n", F.lit(1))
        out = at_levels(rows.withColumn("_k", F.when(finite, key)), cal, "_k").crossJoin(F.broadcast(size))
    p = (F.lit(1.0) + F.col("_at_least")) / (F.coalesce("_total", F.lit(0)) + 1)
    return out.withColumn("p_value", F.when(F.col("_k").isNotNull(), p).otherwise(F.lit(float("nan")))).drop("_k", "_at_least", "_total")


def drift(scores: DataFrame, order: str, score: str, by: list[str], alpha: float = 0.05, least: int = 20) -> DataFrame:
    """Per group whether its scores look exchangeable over time: by, n, ks, p_value, verdict.

    The first half is compared with the second by the two-sample Kolmogorov-Smirnov test: true if p > alpha, false if not, and
    none below `least` scores. Null and NaN are left out; the middle one of an odd number belongs to the second half.
    """
    d = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*by, F.col(score).alias("_s"), F.col(order).alias("_o"))
    whole = Window.partitionBy(*by)
    d = d.withColumns({"_i": F.row_number().over(whole.orderBy("_o", "_s")), "_n": F.count("*").over(whole)})
    first = (F.col("_i") <= F.floor(F.col("_n") / 2)).cast("long")
    level = d.groupBy(*by, "_s", "_n").agg(F.sum(first).alias("_a"), F.sum(1 - first).alias("_b"))
    up = whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    na, nb = F.floor(F.col("_n") / 2), F.col("_n") - F.floor(F.col("_n") / 2)
    gap = F.abs(F.sum("_a").over(up) / F.greatest(na, F.lit(1)) - F.sum("_b").over(up) / nb)
    ks = level.withColumn("_gap", gap).groupBy(*by, F.col("_n").alias("n")).agg(F.max("_gap").alias("ks"))
    a, b = F.floor(F.col("n") / 2), F.col("n") - F.floor(F.col("n") / 2)
    root = F.sqrt(a * b / (a + b))
    ks = ks.withColumn("_x", (root + 0.12 + F.lit(0.11) / root) * F.col("ks"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("_x") * F.col("_x")))
    p = F.when(F.col("_x") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))
    ks = ks.withColumn("p_value", F.when(F.col("n") >= least, p))
    verdict = F.when(F.col("p_value").isNull(), "none").when(F.col("p_value") > alpha, "true").otherwise("false")
    return ks.select(*by, "n", "ks", "p_value", verdict.alias("verdict"))


def conformal_bound(n: int, alpha: float) -> float:
    """False-alarm rate that n calibration scores really allow at level alpha."""
    if n < 1:
        raise ValueError("calibration is empty")
    return int((n + 1) * alpha + 1e-12) / (n + 1)


def fanout_detect(events: DataFrame, entity: str, value: str, t: Column, grain: float, alpha: float = 1e-3) -> DataFrame:
    """Fan-out cells with p_value against all cells and flagged = p_value <= alpha."""
    return conformal(cut(fanout_cells(events, entity, value, t, grain)), "entropy").withColumn("flagged", F.col("p_value") <= alpha)


def fanout_distinct(events: DataFrame, entity: str, value: str, t: Column, grain: float, threshold: int) -> DataFrame:
    """Entities with more than threshold distinct values in one bin: the plain comparator."""
    e = events.select(F.col(entity).alias("entity"), F.col(value).alias("value"), time_bin(t, grain).alias("bin"))
    cells = e.groupBy("entity", "bin").agg(F.countDistinct("value").alias("distinct_values"))
    return cells.where(F.col("distinct_values") > threshold).groupBy("entity").agg(F.max("distinct_values").alias("most"), F.count("*").alias("bins"))


# ---------------------------------------------------------------- false discovery rate


def fdr(rows: DataFrame, p: str, q: float = 0.05, method: str = "bh", weight: str | None = None) -> DataFrame:
    """Adds q_value and rejected (q_value <= q) by Benjamini-Hochberg ("bh") or Benjamini-Yekutieli ("by").

    A row stands for as many tests as `weight` says (default: one). Ranks are taken over distinct p-values with their counts: equal p-values share the largest of their ranks, as the
    running minimum would make of them. NaN stays NaN and is not counted.
    """
    real = F.col(p).isNotNull() & ~F.isnan(p)
    each = F.sum(weight) if weight else F.count("*")
    levels = cut(rows.where(real).groupBy(F.col(p).alias("_p")).agg(each.alias("_n")))  # ranked twice and joined from here
    m = F.col("_m")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(1_000_000))), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)
    harmonic = F.when(m <= 1_000_000, exact).otherwise(F.log(m) + F.lit(0.5772156649015329) + 0.5 / m)  # to 1e-13
    size = levels.agg(F.greatest(F.coalesce(F.sum("_n"), F.lit(0)), F.lit(1)).alias("_m")).withColumn("_c", F.lit(1.0) if method == "bh" else harmonic)
    levels = running(levels, "_p", "_n", "_rank").crossJoin(F.broadcast(size))
    levels = levels.withColumn("_raw", m * F.col("_c") / F.col("_rank") * F.col("_p"))
    levels = running(levels, "_p", "_raw", "_least", descending=True, agg=F.min)
    levels = levels.select(F.col("_p").alias(p), F.least(F.lit(1.0), "_least").alias("q_value"), "_n")
    out = at_levels(rows, levels, p)
    return out.withColumn("q_value", F.coalesce("q_value", F.lit(float("nan")))).withColumn("rejected", ~F.isnan("q_value") & (F.col("q_value") <= q))


# ---------------------------------------------------------------- off-hours


def offhours(events: DataFrame, entity: str, t: Column, alpha: float = 0.02, least_events: int = 10, least_r: float = 0.5, hours: tuple[float, float] = (8.0, 18.0)) -> DataFrame:
    """Events of entities that keep business hours, with p_value of their distance from everyone's mean hour.

    An entity qualifies with least_events events, a resultant length of least_r and a mean hour within `hours`. The
    calibration set is all events.
    """
    e = events.withColumn("hour", F.pmod(t, F.lit(86400.0)) / 3600.0)
    centre = e.agg(circular(F.col("hour"), 24.0)["mean"].alias("centre"))
    e = e.crossJoin(F.broadcast(centre)).withColumn("distance", F.round(circular_distance(F.col("hour"), F.col("centre"), 24.0), 9))
    m = circular(F.col("hour"), 24.0)
    gate = e.groupBy(entity).agg(F.count("*").alias("n"), m["resultant"].alias("r"), m["mean"].alias("mean_hour"))
    gate = gate.where((F.col("n") >= least_events) & (F.col("r") >= least_r) & F.col("mean_hour").between(*hours)).select(entity)
    scored = conformal(e.drop("centre"), "distance")
    return scored.join(gate, entity, "left_semi").withColumn("flagged", F.col("p_value") <= alpha)


# ---------------------------------------------------------------- rarity and baselines


def rare_actors(events: DataFrame, actor: str, max_share: float) -> DataFrame:
    """Actors with less than max_share of all events, with their counts and shares."""
    n = events.groupBy(actor).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    out = n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))
    return out.where(F.col("share") < max_share).drop("total")


def learn_baseline(events: DataFrame, entity: str, value: str) -> DataFrame:
    """Mergeable statistics per entity: n, total, squares of the numeric values; others are skipped."""
    v = F.expr(f"try_cast({value} AS double)")
    ok = events.select(F.col(entity).alias("entity"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return ok.groupBy("entity").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


def blend_baselines(prior: DataFrame, observed: DataFrame) -> DataFrame:
    return prior.unionByName(observed).groupBy("entity").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))


def credibility(baseline: DataFrame, k: float = 20.0) -> DataFrame:
    """Shrinks each entity's mean towards the population's: z = n / (n + k)."""
    whole = baseline.agg((F.sum("total") / F.sum("n")).alias("population"))
    z = F.col("n") / (F.col("n") + F.lit(float(k)))
    out = baseline.crossJoin(F.broadcast(whole)).withColumns({"z": z, "own_mean": F.col("total") / F.col("n")})
    return out.withColumn("estimate", F.col("z") * F.col("own_mean") + (1 - F.col("z")) * F.col("population")).drop("squares", "total")


# ---------------------------------------------------------------- coordination


def activity(events: DataFrame, entity: str, t: Column, grain: float) -> DataFrame:
    """Distinct (entity, bin) with activity."""
    return events.select(F.col(entity).alias("entity"), time_bin(t, grain).alias("bin")).where("entity IS NOT NULL AND bin IS NOT NULL").distinct()


def activity_features(active: DataFrame) -> DataFrame:
    """Per entity: active bins, activity rate over all bins up to the last, and its entropy."""
    last = active.agg((F.max("bin") - F.min("bin") + 1).alias("windows"))
    per = active.groupBy("entity").agg(F.count("*").alias("active")).crossJoin(F.broadcast(last))
    return per.select("entity", "active", (F.col("active") / F.col("windows")).alias("rate"), entropy_of_counts(F.array("active", F.col("windows") - F.col("active"))).alias("entropy"))


def pair_classes() -> tuple[Callable, Callable, Callable]:
    """Functions of counts: what holds of a pair of 0/1 rows follows from the axis, how many bins each has, and how many both
    have. Made inside, so that workers need not import this module.

    tiles(left, right, same): (first, key, n11, na, nb, keep) for ranges of left's rows: each pair's class, the classes'
    counts, and which pairs count. figures(n11, na, nb, w): mutual information and Pearson correlation. tail(n11, na, nb, w,
    most): how probable as much information is under shuffling, or 2 where that is surely above most.
    """
    import numpy as np

    from .pairs import shared_counts

    shared = shared_counts()

    def tiles(left, right, same):
        la, lb = left["bins"][0], right["bins"][0]
        for lo, n in shared(left["bins"], right["bins"]):
            (ua, ia), (ub, ib) = (np.unique(x, return_inverse=True) for x in (la[lo : lo + len(n)], lb))
            m = int(n.max(initial=0)) + 1
            keep = np.arange(len(n))[:, None] + lo < np.arange(len(lb)) if same else np.ones(n.shape, bool)
            if len(ua) * len(ub) * m <= max(n.size, 4096):
                key = (ia[:, None] * len(ub) + ib) * m + n
                have = np.flatnonzero(np.bincount(key.ravel(), minlength=len(ua) * len(ub) * m))
                place = np.zeros(len(ua) * len(ub) * m, np.int32)
                place[have] = np.arange(len(have))
                yield lo, place[key], have % m, ua[have // m // len(ub)], ub[have // m % len(ub)], keep
            else:  # hardly two pairs alike
                wide = lambda x: np.broadcast_to(x, n.shape).ravel()
                yield lo, np.arange(n.size).reshape(n.shape), n.ravel(), wide(la[lo : lo + len(n), None]), wide(lb), keep

    def entropy(*counts):  # as entropy_of_counts()
        c = np.sort(np.stack([np.asarray(x, float) for x in np.broadcast_arrays(*counts)]), axis=0)
        log2 = lambda x: np.log(np.where(x > 0, x, 1)) / np.log(2.0)
        total, weighted = c[0], c[0] * log2(c[0])
        for x in c[1:]:
            total, weighted = total + x, weighted + x * log2(x)
        return np.maximum(0.0, np.round(log2(total) - weighted / total, 12))

    def figures(n11, na, nb, w):
        n11, na, nb = (np.asarray(x, float) for x in (n11, na, nb))
        mi = entropy(na, w - na) + entropy(nb, w - nb) - entropy(n11, na - n11, nb - n11, w - na - nb + n11)
        below = np.sqrt(na * (w - na) * nb * (w - nb))
        return np.maximum(0.0, mi), np.where(below > 0, (w * n11 - na * nb) / np.where(below > 0, below, 1), 0.0)

    known = {}

    def tail(n11, na, nb, w, most):
        if "f" not in known:
            known["f"] = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, w + 1)))))
        f = known["f"]

        def mass(k, a, b):  # hypergeometric
            return np.exp(f[a] - f[k] - f[a - k] + f[w - a] - f[b - k] - f[w - a - b + k] - f[w] + f[b] + f[w - b])

        n11, low, high = (np.asarray(x, np.int64) for x in (n11, np.minimum(na, nb), np.maximum(na, nb)))
        p = np.full(len(n11), 2.0)
        few = np.flatnonzero(mass(n11, low, high) <= most * (1 + 1e-9))  # the tail has at least this
        code = low[few] * (w + 1) + high[few]
        few = few[np.argsort(code, kind="stable")]
        for group in np.split(few, np.flatnonzero(np.diff(np.sort(code))) + 1) if len(few) else []:
            a, b = int(low[group[0]]), int(high[group[0]])
            if (a, b) not in known:
                k = np.arange(max(0, a + b - w), a + 1)
                mi, at = figures(k, a, b, w)[0], mass(k, a, b)
                known[a, b] = k[0], np.array([at[mi >= x - 1e-9].sum() for x in mi])
            first, sums = known[a, b]
            p[group] = np.minimum(1.0, sums[n11[group] - first])
        return p

    return tiles, figures, tail


def _bins(active: DataFrame) -> tuple[Callable, int]:
    """Entities with their active bins in blocks, in order of entity, and the number of bins from the earliest to the last."""
    from .pairs import in_blocks

    w = active.agg((F.max("bin") - F.min("bin") + 1).cast("long")).first()[0] or 0
    sets = active.where("entity IS NOT NULL AND bin IS NOT NULL").groupBy("entity").agg(F.collect_set(F.col("bin").cast("long")).alias("bins"))
    return in_blocks(sets, "entity"), w


def coordination(active: DataFrame, least: float = 0.0, digits: int | None = None) -> DataFrame:
    """Pairs of entities: mutual information (above least, or any where that is 0) and Pearson correlation of 0/1 activity,
    also of pairs that never meet.

    The axis runs from the earliest active bin to the last. Rows of bins are multiplied block by block, so that nothing but
    the pairs comes out, and figures are computed (and rounded half up to `digits`) once for pairs with equal counts.
    """
    over, w = _bins(active)
    tiles, figures, _ = pair_classes()

    def run(left, right, same):
        from decimal import ROUND_HALF_UP, Decimal

        import numpy as np
        import pyarrow as pa

        def rounded(x):
            return x if digits is None else np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in x])

        for lo, key, n11, na, nb, keep in tiles(left, right, same):
            mi, pearson = figures(n11, na, nb, w)
            if least:
                keep = keep & (mi >= least)[key]
            at = np.flatnonzero(keep)
            mi, pearson = rounded(mi), rounded(pearson)
            for part in np.split(at, range(1 << 18, len(at), 1 << 18)):
                x, y, k = part // keep.shape[1] + lo, part % keep.shape[1], key.ravel()[part]
                yield pa.RecordBatch.from_arrays([left["entity"].take(pa.array(x)), right["entity"].take(pa.array(y)), pa.array(mi[k]), pa.array(pearson[k])], ["a", "b", "mi", "pearson"])

    kind = active.schema["entity"].dataType.simpleString()
    return over(run, f"a {kind}, b {kind}, mi double, pearson double")


def coordinated(active: DataFrame, q: float = 0.05) -> DataFrame:
    """Pairs of entities that the false discovery rate q (Benjamini-Hochberg over all pairs) leaves: a, b, mi, pearson, p_value.

    Nothing is chosen before the test. p_value is that of all shufflings of one entity's bins instead of some drawn ones: a
    sum over the bins that two such rows can share, which depends on three counts. Pairs are first counted by these, which
    gives the largest p-value that is rejected, and in a second pass those up to it come out.
    """
    over, w = _bins(active)
    tiles, figures, tail = pair_classes()

    def count(left, right, same):
        import numpy as np
        import pyarrow as pa

        for _, key, n11, na, nb, keep in tiles(left, right, same):
            n = np.bincount(key[keep], minlength=len(n11))
            have = n > 0
            columns = [n11[have], np.minimum(na, nb)[have], np.maximum(na, nb)[have], n[have]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["n11", "na", "nb", "n"])

    def weigh(batches):
        import pyarrow as pa

        for x in batches:
            p = tail(*(x[c].to_numpy() for c in ("n11", "na", "nb")), w, q)
            yield pa.RecordBatch.from_arrays([pa.array(p), x["n"]], ["p_value", "n"])

    counts = over(count, "n11 long, na long, nb long, n long").groupBy("n11", "na", "nb").agg(F.sum("n").alias("n"))
    levels = cut(counts.mapInArrow(weigh, "p_value double, n long"))
    last = fdr(levels, "p_value", q, weight="n").where("rejected").agg(F.max("p_value")).first()[0]
    last = -1.0 if last is None else last * (1 + 1e-9)

    def found(left, right, same):
        import numpy as np
        import pyarrow as pa

        for lo, key, n11, na, nb, keep in tiles(left, right, same):
            p = tail(n11, na, nb, w, last)
            at = np.flatnonzero(keep & (p <= last)[key])
            mi, pearson = figures(n11, na, nb, w)
            for part in np.split(at, range(1 << 18, len(at), 1 << 18)):
                x, y, k = part // keep.shape[1] + lo, part % keep.shape[1], key.ravel()[part]
                yield pa.RecordBatch.from_arrays([left["entity"].take(pa.array(x)), right["entity"].take(pa.array(y)), *(pa.array(c[k]) for c in (mi, pearson, p))], ["a", "b", "mi", "pearson", "p_value"])

    kind = active.schema["entity"].dataType.simpleString()
    return over(found, f"a {kind}, b {kind}, mi double, pearson double, p_value double")


def coordination_null(active: DataFrame, pairs: DataFrame, permutations: int = 199, seed: int = 7) -> DataFrame:
    """p-values of pairs' mutual information against shuffled activity: a, b, mi, p_value = (1 + #{null >= mi}) / (n + 1).

    A pair's null depends only on how often both are active and on the axis, so a shuffle is one hypergeometric draw of the
    bins they share, and nothing but three numbers per pair is moved. Each pair has its own seed, from its names.
    """
    import numpy as np
    import pandas as pd

    span = active.agg((F.max("bin") - F.min("bin") + 1).cast("long").alias("w"))
    per = active.groupBy("entity").agg(F.count("*").alias("n"))
    d = pairs.select("a", "b", "mi").join(per.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(per.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(span))
    d = d.withColumn("_s", F.abs(F.xxhash64("a", "b", F.lit(seed)) % F.lit(1 << 62)))
    out = d.schema["a"].dataType.simpleString()

    def h(*counts: np.ndarray) -> np.ndarray:
        c = np.stack([np.broadcast_to(x, np.broadcast_shapes(*(np.shape(y) for y in counts))) for x in counts]).astype(float)
        p = c / c.sum(axis=0)
        return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=0)

    def run(parts):
        for rows in parts:
            ps = []
            for r in rows.itertuples():
                n11 = np.random.default_rng(r.s).hypergeometric(r.na, r.w - r.na, r.nb, permutations)
                mi = h(np.array([r.na]), np.array([r.w - r.na])) + h(np.array([r.nb]), np.array([r.w - r.nb])) - h(n11, r.na - n11, r.nb - n11, r.w - r.na - r.nb + n11)
                ps.append((1 + int((mi >= r.mi - 1e-9).sum())) / (permutations + 1))
            yield pd.DataFrame({"a": rows["a"], "b": rows["b"], "mi": rows["mi"], "p_value": ps})

    return d.select("a", "b", "mi", "na", "nb", "w", "_s").withColumnRenamed("_s", "s").mapInPandas(run, f"a {out}, b {out}, mi double, p_value double")
