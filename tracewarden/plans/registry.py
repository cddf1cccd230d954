"""Detectors by the fields they need, and what their findings make likely next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    name: str
    technique: str
    tactic: str
    requires: frozenset[str]
    run: Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self, detectors: list[Detector] | None = None):
        self.detectors = list(detectors or [])

    def add(self, name: str, technique: str, tactic: str, requires: set[str]) -> Callable:
        """Decorator that registers a transform under a name."""

        def keep(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            if any(d.name == name for d in self.detectors):
                raise ValueError(f"{name} is registered already")
            self.detectors.append(Detector(name, technique, tactic, frozenset(requires), fn))
            return fn

        return keep

    def applicable(self, columns: list[str]) -> tuple[list[Detector], list[str]]:
        """Detectors whose fields are all there, and the names of the others."""
        have = set(columns)
        return [d for d in self.detectors if d.requires <= have], [d.name for d in self.detectors if not d.requires <= have]

    def run(self, events: DataFrame) -> tuple[dict[str, DataFrame], list[str]]:
        """Findings of each applicable detector (lazily), and what was skipped."""
        go, skipped = self.applicable(events.columns)
        return {d.name: d.run(events) for d in go}, skipped

    def frontier(self, found: list[str], transitions: DataFrame, top: int = 4) -> DataFrame:
        """Tactics most likely to follow those of detectors that found something, and whether a detector covers them."""
        spark = transitions.sparkSession
        now = {d.tactic for d in self.detectors if d.name in found}
        covered = spark.createDataFrame([(d.tactic, d.name) for d in self.detectors], "to string, detector string").groupBy("to").agg(F.sort_array(F.collect_set("detector")).alias("detectors"))
        w = Window.partitionBy("from").orderBy(F.desc("p"), "to")
        t = transitions.where(F.col("from").isin(sorted(now))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        return t.join(covered, "to", "left").select("from", "to", "p", "rank", "detectors", F.col("detectors").isNotNull().alias("covered"))
