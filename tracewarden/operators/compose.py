"""Findings put together: signatures beside detectors, rules over flagged windows, hypotheses on half-seen chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import belnap as b

from .detectors import PART, time_bin
from .structural import completeness

# ---------------------------------------------------------------- predicates and windows


def hex_bits(mask: Column, bits: int) -> Column:
    """Whether a `0x..` mask has any of the bits set; other text and null do not."""
    is_hex = F.coalesce(mask.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.lit(False))
    number = F.conv(F.substring(mask, 3, 15), 16, 10).cast("bigint")
    return is_hex & F.when(is_hex, number.bitwiseAND(F.lit(bits)) != 0).otherwise(False)


def cell_events(events: DataFrame, entity: str, t: str, cells: DataFrame, grain: float) -> DataFrame:
    """All events of cells(entity, bin), with bin: cells are half-open, so equal bins replace the comparison of times."""
    own = cells.select(F.col("entity").alias(entity), "bin").distinct()
    return events.withColumn("bin", time_bin(F.col(t), grain)).join(own, [entity, "bin"])


def span_events(events: DataFrame, entity: str, t: str, spans: DataFrame, grain: float) -> DataFrame:
    """Events with every span(entity, t0, t1) of their entity that holds them, t0 <= t < t1.

    Spans are dealt to the bins of grain that they touch, so that the join is on equal keys; choose grain near their length.
    """
    touched = F.sequence(time_bin(F.col("t0"), grain), time_bin(F.col("t1"), grain))
    s = spans.where("t0 < t1").select(F.col("entity").alias(entity), "t0", "t1", F.explode(touched).alias("_bin"))
    e = events.withColumn("_bin", time_bin(F.col(t), grain)).join(s, [entity, "_bin"])
    return e.where((F.col(t) >= F.col("t0")) & (F.col(t) < F.col("t1"))).drop("_bin")


# ---------------------------------------------------------------- signatures beside detectors


def signature(rows: DataFrame, key: str, value: str, strong: Column, least: int, floor: int | None = None) -> DataFrame:
    """(key, signature): true with `least` distinct values under the condition, false with `floor` of them (default: as many)
    but without it, none with few. Null keys have no signature, and null counts as no value."""
    floor = least if floor is None else floor
    d = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value, F.coalesce(strong, F.lit(False)).cast("int").alias("_strong"))
    d = d.repartition(d.count() // PART + 1, key, value)  # parts of a bounded number of rows, as hardly two may be alike
    one = d.groupBy(key, value).agg(F.max("_strong").alias("_strong"))
    n = one.groupBy(key).agg(F.sum("_strong").alias("_strong"), F.count("*").alias("_all"))
    code = F.when(F.col("_strong") >= least, b.TRUE).when(F.col("_all") >= floor, b.FALSE).otherwise(b.NONE)
    return n.select(key, code.alias("signature"))


def orphan_signature(uses: DataFrame, issues: DataFrame, key: str, value: str, ticket: str, least: int = 3, floor: int = 10) -> DataFrame:
    """signature() whose condition is a ticket that nobody issued; uses without ticket meet no condition."""
    known = issues.select(ticket).where(F.col(ticket).isNotNull()).distinct().withColumn("_issued", F.lit(True))
    d = uses.join(known, ticket, "left")
    return signature(d, key, value, F.col(ticket).isNotNull() & F.col("_issued").isNull(), least, floor)


def cross_check(cells: DataFrame, signatures: DataFrame, key: str) -> DataFrame:
    """Each flagged entity once, by its cell of least p-value (then the earliest), next to its signature: cross_check is what
    detector and signature say together."""
    best = cells.where("flagged").groupBy("entity").agg(F.min(F.struct("p_value", "bin")).alias("c"))
    d = best.join(signatures.select(F.col(key).alias("entity"), "signature"), "entity", "left")
    code = F.coalesce("signature", F.lit(b.NONE))
    return d.select("entity", "c.bin", "c.p_value", b.name_of(code).alias("signature"), b.name_of(b.col_k_join(F.lit(b.TRUE), code)).alias("cross_check"))


def corroborate(cells: DataFrame, events: DataFrame, entity: str, t: str, grain: float, rules: dict[str, Column]) -> DataFrame:
    """cells with the rules (name: condition) that fire on any event of the cell, sorted, and their number as votes.

    Rules that stay silent contradict nothing. What is gathered per cell is one name per rule at most.
    """
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    own = cell_events(events, entity, t, cells, grain).select(F.col(entity).alias("entity"), "bin", F.explode(names).alias("rule"))
    fired = own.distinct().groupBy("entity", "bin").agg(F.sort_array(F.collect_list("rule")).alias("rules"))
    none = F.array().cast("array<string>")
    return cells.join(fired, ["entity", "bin"], "left").withColumn("rules", F.coalesce("rules", none)).withColumn("votes", F.size("rules"))


# ---------------------------------------------------------------- carriers of entailment


def carrier_of_check(satisfied: Column) -> Column:
    """A model check is closed: what does not hold is refuted. Null is none."""
    return F.when(satisfied, "CONFIRMED").when(~satisfied, "REFUTED").otherwise("NONE")


def carrier_of_subsumption(entailed: Column) -> Column:
    """Subsumption is open: what does not follow is unknown."""
    return F.when(entailed, "CONFIRMED").otherwise("NONE")


def carrier_code(carrier: Column) -> Column:
    """Four-valued code of CONFIRMED, REFUTED, GAP or NONE; a gap is entailed, hence true. Other text gives null."""
    codes = {"CONFIRMED": b.TRUE, "REFUTED": b.FALSE, "GAP": b.TRUE, "NONE": b.NONE}
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[carrier]


# ---------------------------------------------------------------- chains seen in part


def chain_hypotheses(observed: DataFrame, path: list[str], moves: DataFrame, stages: str = "stages") -> DataFrame:
    """completeness() of each row's stages, and frontier_p: how likely the next stage follows the deepest one seen, by
    moves(from, to, p) (0 if that move was never seen, null at the end of the path or before its first stage)."""
    d = completeness(observed, path, stages)
    reached = F.round(F.col("reach") * len(path)).cast("int")
    d = d.withColumn("deepest", F.when(reached > 0, F.try_element_at(F.array(*map(F.lit, path)).cast("array<string>"), F.greatest(reached, F.lit(1)))))
    steps = moves.where(F.col("from").isin(path)).select(F.col("from").alias("deepest"), F.col("to").alias("frontier"), F.col("p").alias("_p"))
    out = d.join(F.broadcast(steps), ["deepest", "frontier"], "left")  # at most one row for each pair of stages
    p = F.when(F.col("deepest").isNotNull() & F.col("frontier").isNotNull(), F.round(F.coalesce("_p", F.lit(0.0)), 4))
    return out.withColumn("frontier_p", p).drop("_p")
