"""Structural and sequence detectors: pattern joins, orphans, gaps, ordered chains, bursts, ticket tiers, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detectors import time_bin


# ---------------------------------------------------------------- joins


def pattern_join(legs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All combinations of one row per leg that agree on their keys: {role: (rows, key column)}.

    Columns come out as role_column next to `key`. Null keys match nothing; one leg is a filter.
    """

    def leg(role: str, rows: DataFrame, key: str) -> DataFrame:
        own = rows.where(F.col(key).isNotNull())
        return own.select(F.col(key).cast("string").alias("key"), *[F.col(c).alias(f"{role}_{c}") for c in rows.columns])

    return reduce(lambda a, b: a.join(b, "key"), [leg(r, d, k) for r, (d, k) in legs.items()])


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, child_t: str | None = None, parent_t: str | None = None) -> DataFrame:
    """Children without a parent (at or before their own time, if times are given)."""
    p = parents.select(F.col(parent_key).alias("_pk"), *([F.col(parent_t).alias("_pt")] if parent_t else []))
    if parent_t:  # the earliest parent decides, so the join stays one row per key
        p = p.groupBy("_pk").agg(F.min("_pt").alias("_pt"))
        return children.join(p, (F.col(child_key) == F.col("_pk")) & (F.col("_pt") <= F.col(child_t)), "left_anti")
    return children.join(p, F.col(child_key) == F.col("_pk"), "left_anti")


def gap_classify(anchors: DataFrame, expected: DataFrame, key: str, channel: DataFrame) -> DataFrame:
    """Each distinct anchor key: CONFIRMED if the expected event exists, GAP if only its channel was collected, else NONE."""
    seen = channel.limit(1).agg((F.count("*") > 0).alias("collected"))
    a = anchors.select(key).where(F.col(key).isNotNull()).distinct()
    e = expected.select(key).distinct().withColumn("present", F.lit(True))
    out = a.join(e, key, "left").crossJoin(F.broadcast(seen))
    return out.select(key, F.when(F.col("present"), "CONFIRMED").when(F.col("collected"), "GAP").otherwise("NONE").alias("outcome"))


# ---------------------------------------------------------------- ordered chains


def chain(events: DataFrame, actor: str, t: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """Per actor with any event: when each stage was met, the stages met in order, and whether all were.

    Stage i takes the earliest event at or after stage i-1. After the first stage that fails in order, a stage reports its
    earliest event at any time (stand-alone truth), which does not count as met in order. Events without actor are ignored.
    """
    e = events.where(F.col(actor).isNotNull()).select(F.col(actor).alias("actor"), F.col(t).alias("t"), *[c.alias(f"_s{i}") for i, (_, c) in enumerate(stages)])
    out = e.groupBy("actor").agg(*[F.min(F.when(F.col(f"_s{i}"), F.col("t"))).alias(f"_any{i}") for i in range(len(stages))])
    out = out.withColumn("_in0", F.col("_any0"))
    for i in range(1, len(stages)):
        prev = out.where(F.col(f"_in{i - 1}").isNotNull()).select("actor", F.col(f"_in{i - 1}").alias("_from"))
        step = e.where(F.col(f"_s{i}")).join(prev, "actor").where(F.col("t") >= F.col("_from")).groupBy("actor").agg(F.min("t").alias(f"_in{i}"))
        out = out.join(step, "actor", "left")
    met = [F.col(f"_in{i}").isNotNull() for i in range(len(stages))]
    times = [F.coalesce(F.col(f"_in{i}"), F.col(f"_any{i}")).alias(name) for i, (name, _) in enumerate(stages)]
    return out.select("actor", *times, sum((m.cast("int") for m in met), F.lit(0)).alias("stages_met"), met[-1].alias("complete"))


def bursts(events: DataFrame, key: str, value: str, t: Column, window: float, least: int) -> DataFrame:
    """Per key the earliest bin with at least `least` distinct values: burst_t (its last event), values (sorted)."""
    e = events.select(F.col(key).alias("key"), F.col(value).alias("value"), t.alias("t")).where("key IS NOT NULL").withColumn("bin", time_bin(F.col("t"), window))
    one = e.groupBy("key", "bin", "value").agg(F.max("t").alias("t"))
    cells = one.groupBy("key", "bin").agg(F.count("value").alias("n"), F.max("t").alias("burst_t"), F.sort_array(F.collect_list("value")).alias("values"))
    first = F.min(F.struct("burst_t", "n", "values")).alias("b")
    return cells.where(F.col("n") >= least).groupBy("key").agg(first).select("key", "b.burst_t", "b.n", "b.values")


def burst_then_later(events: DataFrame, burst: DataFrame, key: str, t: str, what: Column, carry: list[str]) -> DataFrame:
    """Each burst with the first event on its key, at or after it, for which `what` holds: a forward as-of join."""
    later = events.where(what).select(F.col(key).alias("key"), F.col(t).alias("later_t"), *carry)
    hit = burst.join(later, "key").where(F.col("later_t") >= F.col("burst_t"))
    first = hit.groupBy("key").agg(F.min(F.struct("later_t", *carry)).alias("f"))
    return burst.join(first, "key").select("key", "burst_t", "n", "f.*")


# ---------------------------------------------------------------- tickets and ledgers


def ticket_tiers(issued: DataFrame, presented: DataFrame) -> DataFrame:
    """issued(hash, account, ip, seq), presented(id, hash, account, ip) -> (id, tier) of suspicious presentations.

    With a hash: never issued is `golden`, first issued to another ip is `pass-the-ticket`. Without one: an account that was
    never issued anything is `possible-golden`.
    """
    first = issued.where("hash IS NOT NULL").groupBy("hash").agg(F.min_by("ip", "seq").alias("issued_ip"))
    known = issued.select("account").distinct().withColumn("known", F.lit(True))
    p = presented.join(first.withColumn("was_issued", F.lit(True)), "hash", "left").join(known, "account", "left")
    tier = F.when(F.col("hash").isNotNull(), F.when(F.col("was_issued").isNull(), "golden").when(F.col("issued_ip") != F.col("ip"), "pass-the-ticket")).when(F.col("known").isNull(), "possible-golden")
    return p.select("id", tier.alias("tier")).where("tier IS NOT NULL")


def ledger_classes(requests: DataFrame, issues: DataFrame) -> DataFrame:
    """requests(id, hash, ip), issues(hash, ip, seq): CONFIRMED, CONTEXT-DIVERGENCE (another ip), GAP, or NONE (no issue seen)."""
    last = issues.where("hash IS NOT NULL").groupBy("hash").agg(F.max_by("ip", "seq").alias("issued_ip")).withColumn("known", F.lit(True))
    seen = issues.limit(1).agg((F.count("*") > 0).alias("channel"))
    d = requests.join(last, "hash", "left").crossJoin(F.broadcast(seen))
    kind = F.when(F.col("known") & (F.col("issued_ip") != F.col("ip")), "CONTEXT-DIVERGENCE").when(F.col("known"), "CONFIRMED").when(F.col("channel"), "GAP").otherwise("NONE")
    return d.select("id", kind.alias("outcome"))


# ---------------------------------------------------------------- paths


def completeness(observed: DataFrame, path: list[str], stage: str = "stages") -> DataFrame:
    """Adds coverage, reach, frontier and gaps of a fixed path, given an array column of observed stages."""
    want = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    n = len(path)
    seen = F.array_intersect(want, F.col(stage))
    deepest = F.coalesce(F.array_max(F.transform(seen, lambda s: F.array_position(want, s))), F.lit(0)).cast("int")
    d = observed.withColumns({"_deep": deepest, "_seen": seen})
    gaps = F.filter(F.slice(want, F.lit(1), F.col("_deep")), lambda s: ~F.array_contains(F.col("_seen"), s)) if n else want
    ratio = (lambda c: F.round(c / F.lit(float(n)), 4)) if n else (lambda c: F.lit(0.0))
    frontier = F.when(F.col("_deep") < n, F.element_at(want, F.col("_deep") + 1)) if n else F.lit(None).cast("string")
    return d.withColumns({"coverage": ratio(F.size("_seen")), "reach": ratio(F.col("_deep")), "frontier": frontier, "gaps": gaps}).drop("_deep", "_seen")


def transitions(events: DataFrame, actor: str, t: str, state: str, tie: str) -> DataFrame:
    """Row-normalised transition probabilities between consecutive states of each actor: from, to, n, p."""
    w = Window.partitionBy(actor).orderBy(t, tie)
    step = events.select(F.col(state).alias("to"), F.lag(state).over(w).alias("from")).where("`from` IS NOT NULL")
    n = step.groupBy("from", "to").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))
