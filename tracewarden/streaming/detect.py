"""Streaming detectors: windowed fan-out, prefix alerts per actor, decaying beliefs, baselines merged batch by batch."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewarden.functions.stats import entropy


def windowed_fanout(events: DataFrame, entity: str, value: str, ts: str, grain: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Distinct values, events and entropy per entity and window; works on streams (append mode) and on tables.

    Values are counted first, so a window's state is its distinct values and not its events.
    """
    e = events.select(F.col(entity).alias("entity"), F.col(value).alias("value"), F.col(ts).cast("timestamp").alias("ts"))
    e = e.withWatermark("ts", lateness) if events.isStreaming else e
    n = e.groupBy(F.window("ts", grain), "entity", "value").agg(F.count("*").alias("n"))
    agg = n.groupBy("window", "entity").agg(entropy(F.col("n")).alias("entropy"), F.count("value").alias("distinct_values"), F.sum("n").alias("n_events"))
    return agg.select("entity", F.col("window.start").alias("start"), "distinct_values", "n_events", "entropy")


# ---------------------------------------------------------------- prefix alerts


@dataclass
class Shadow:
    """What is known of one actor: when each stage's events came, when stages were met, and how warm that is."""

    seen: list[list[float]] = field(default_factory=list)
    met: list[float] = field(default_factory=list)
    warmth: float = 0.0
    last: float | None = None
    told: bool = False


Stage = Callable[[dict], bool]


@dataclass(frozen=True)
class ShadowRules:
    """Stages say whether an event is theirs, and are met in their order, each no earlier than the one before. Warmth fades
    with tau; below prune what was met is forgotten. Events count for horizon seconds (8 tau, if not given)."""

    stages: tuple[Stage, ...]
    fire_at: int = 2
    tau: float = 6 * 3600.0
    prune: float = 0.05
    horizon: float | None = None

    def further(self, s: Shadow) -> Iterator[float]:
        """Times at which the stages after those already met can be met, from the sorted times of their events."""
        at = s.met[-1] if s.met else -math.inf
        for times in s.seen[len(s.met) :]:
            k = bisect_left(times, at)
            if k == len(times):
                return
            at = times[k]
            yield at

    def observe(self, s: Shadow, event: dict, t: float) -> dict | None:
        """Take in one event of the actor, in time order; an alert when the stages met first number fire_at."""
        since = t - (8 * self.tau if self.horizon is None else self.horizon)
        recent = [times[bisect_left(times, since) :] for times in s.seen] or [[] for _ in self.stages]
        for times, stage in zip(recent, self.stages, strict=True):
            if stage(event):
                insort(times, t)
        s.seen = recent
        if s.met:
            faded = s.warmth * math.exp(min(0.0, s.last - t) / self.tau)
            s.met, s.warmth, s.told = (s.met, faded, s.told) if faded >= self.prune else ([], 0.0, False)
        new = list(self.further(s))
        s.met, s.warmth = s.met + new, 1.0 if new else s.warmth
        s.last = t if s.met else s.last
        if s.told or len(s.met) < self.fire_at:
            return None
        s.told = True
        return {"prefix": len(s.met), "completeness": len(s.met) / len(self.stages), "t": s.met[-1], "weight": s.warmth}


def first_with(field_: str, value: str) -> Stage:
    """A stage of events whose field has the value."""
    return lambda event: event.get(field_) == value


ALERT = "actor string, prefix int, completeness double, t double, weight double"


def shadow_alerts(events: DataFrame, rules: ShadowRules, actor: str, t: str, carry: list[str], lateness: str = "1 hour") -> DataFrame:
    """Alerts per actor. On a stream, state lives per actor and leaves when the watermark is past its horizon; on a table, per group.

    Order within an actor is restored inside each micro-batch; events later than an already handled one count as if now.
    """
    e = events.where(F.col(actor).isNotNull() & F.col(t).isNotNull()).select(F.col(actor).cast("string").alias("actor"), F.col(t).cast("double").alias("t"), *[F.col(c).cast("string").alias(c) for c in carry])
    if events.isStreaming:
        e = e.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", lateness)

    def run(key: tuple, s: Shadow, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.sort_values("t", kind="stable").to_dict("records"):
            at = r.pop("t")
            r.pop("actor", None)
            r.pop("_ts", None)
            alert = rules.observe(s, r, max(at, s.last) if s.last is not None else at)
            if alert:
                out.append({"actor": key[0], **alert})
        return out

    columns = ["actor", "prefix", "completeness", "t", "weight"]
    if not events.isStreaming:
        return e.groupBy("actor").applyInPandas(lambda k, rows: pd.DataFrame(run(k, Shadow(), rows), columns=columns), ALERT)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        s = Shadow(**json.loads(state.get[0])) if state.exists else Shadow()
        out = run(key, s, pd.concat(list(parts)))
        state.update((json.dumps(s.__dict__),))
        state.setTimeoutTimestamp(max(int(((s.last or 0.0) + 8 * rules.tau) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    return e.groupBy("actor").applyInPandasWithState(step, ALERT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- decaying beliefs


def posterior(evidence: list[tuple[float, float]], base_rate: float, tau: float, at: float | None = None) -> tuple[float, float]:
    """Log-odds after (time, log-likelihood ratio) pairs in order, fading towards the prior with tau; and their peak."""
    prior = math.log(base_rate / (1 - base_rate))
    now, last, peak = prior, None, prior
    for t, llr in evidence:
        dt = max(0.0, t - last) if last is not None else 0.0
        now = prior + (now - prior) * math.exp(-dt / tau) + llr
        last, peak = t, max(peak, now)
    if at is not None and last is not None:
        now = prior + (now - prior) * math.exp(-max(0.0, at - last) / tau)
    return now, peak


def beliefs(evidence: DataFrame, anchor: str, t: str, llr: str, base_rate: float, tau: float) -> DataFrame:
    """Per anchor: log_odds, peak, probability and the number of pieces of evidence, folded in time order."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "llr"])
        now, peak = posterior(list(zip(rows["t"], rows["llr"], strict=True)), base_rate, tau)
        return pd.DataFrame({"anchor": [key[0]], "log_odds": [now], "peak": [peak], "probability": [1 / (1 + math.exp(-now))], "n": [len(rows)]})

    e = evidence.select(F.col(anchor).cast("string").alias("anchor"), F.col(t).cast("double").alias("t"), F.col(llr).cast("double").alias("llr")).where("anchor IS NOT NULL")
    return e.groupBy("anchor").applyInPandas(fold, "anchor string, log_odds double, peak double, probability double, n long")


# ---------------------------------------------------------------- baselines


def merge_baseline(path: str, learn: Callable[[DataFrame], DataFrame], blend: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: blends each batch's statistics into versions of a table under path, so a retried batch is harmless."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = learn(batch)
        if number:
            now = blend(spark.read.parquet(f"{path}/v{number - 1}"), now)
        now.write.mode("overwrite").parquet(f"{path}/v{number}")

    return step

