"""Patterns over labelled, timed events with four-valued answers: a silent channel says none, never false."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import belnap as b


@dataclass(frozen=True)
class Occurs:
    label: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Before:
    first: str
    then: str


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Never:
    part: object


def _labels(p) -> set[str]:
    match p:
        case Occurs():
            return {p.label}
        case Before():
            return {p.first, p.then}
        case Never():
            return _labels(p.part)
    return set().union(*map(_labels, p.parts)) if p.parts else set()


def _windows(p) -> set[Occurs]:
    match p:
        case Occurs():
            return {p}
        case Before():
            return set()
        case Never():
            return _windows(p.part)
    return set().union(*map(_windows, p.parts)) if p.parts else set()


def recognise(traces: DataFrame, live: DataFrame, pattern) -> DataFrame:
    """traces(trace, label, t), live(trace, labels array) -> (trace, code) for every trace that live names.

    One aggregate per trace finds first and last times of the labels the pattern needs; the pattern is then one expression.
    """
    labels = sorted(_labels(pattern))
    windows = sorted(_windows(pattern), key=repr)
    aggs = [x for i, n in enumerate(labels) for x in (F.min(F.when(F.col("label") == n, F.col("t"))).alias(f"_lo{i}"), F.max(F.when(F.col("label") == n, F.col("t"))).alias(f"_hi{i}"))]

    def inside(o: Occurs) -> Column:
        c = F.col("label") == o.label
        c = c & (F.col("t") >= o.low) if o.low is not None else c
        return c & (F.col("t") <= o.high) if o.high is not None else c

    aggs += [F.coalesce(F.max(inside(o)), F.lit(False)).alias(f"_w{i}") for i, o in enumerate(windows)]
    aggs = aggs or [F.count("*").alias("_n")]
    per = live.select("trace", "labels").join(traces.groupBy("trace").agg(*aggs), "trace", "left")

    def seen(n: str) -> Column:
        return F.coalesce(F.array_contains("labels", n), F.lit(False))

    def code(p) -> Column:
        match p:
            case Occurs():
                hit = F.coalesce(F.col(f"_w{windows.index(p)}"), F.lit(False))
                return F.when(hit, b.TRUE).when(seen(p.label), b.FALSE).otherwise(b.NONE)
            case Before():
                lo, hi = F.col(f"_lo{labels.index(p.first)}"), F.col(f"_hi{labels.index(p.then)}")
                return F.when(~seen(p.first) | ~seen(p.then), b.NONE).when(F.coalesce(lo < hi, F.lit(False)), b.TRUE).otherwise(b.FALSE)
            case Either():
                return reduce(b.col_t_join, map(code, p.parts), F.lit(b.FALSE))
            case Every():
                return reduce(b.col_t_meet, map(code, p.parts), F.lit(b.TRUE))
        return b.col_negate(code(p.part))

    return per.select("trace", code(pattern).alias("code"))
