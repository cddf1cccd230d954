"""Assessing rules: fidelity on labelled positives, admission next to neighbours, and why a silent rule stays silent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as r


def fidelity(hits: DataFrame, labels: DataFrame, key: str, rule_ids: list[str]) -> DataFrame:
    """Per rule what it says about labelled positives: true (all caught), false (none), both (some), none (no positives)."""
    spark = hits.sparkSession
    positives = labels.where("positive").select(key).distinct()
    total = positives.agg(F.count("*").alias("of"))
    n = hits.join(positives, key, "left_semi").groupBy("rule_id").agg(F.countDistinct(key).alias("fired"))
    d = spark.createDataFrame([(x,) for x in rule_ids], "rule_id string").join(n, "rule_id", "left").na.fill(0, ["fired"]).crossJoin(F.broadcast(total))
    code = F.when(F.col("of") == 0, "none").when(F.col("fired") == F.col("of"), "true").when(F.col("fired") == 0, "false").otherwise("both")
    return d.withColumn("coverage", code)


def relation(a: r.Rule, b: r.Rule) -> str:
    """How what two rules test compares: synonym, subsumes, subsumed, overlap or disjoint."""
    x, y = ({c.atom_id for c in q.atoms()} for q in (a, b))
    if x == y:
        return "synonym"
    return "subsumes" if x < y else "subsumed" if x > y else "overlap" if x & y else "disjoint"


def admit(candidate: r.Rule, neighbours: list[r.Rule], hits: DataFrame, positives: DataFrame, key: str) -> dict:
    """Whether a rule earns its place: no synonym of a neighbour, and it fires on a labelled positive. hits has all rules'."""
    own = hits.join(positives.select(key).distinct(), key, "left_semi")
    mine = own.where(F.col("rule_id") == candidate.rule_id).select(key).distinct()
    theirs = own.where(F.col("rule_id").isin([n.rule_id for n in neighbours])).select(key).distinct()
    fired, of = mine.count(), positives.select(key).distinct().count()
    relations = {n.rule_id: relation(candidate, n) for n in neighbours}
    return {
        "relations": relations,
        "coverage": "none" if not of else "true" if fired == of else "both" if fired else "false",
        "novel": mine.join(theirs, key, "left_anti").count(),
        "neighbour_only": theirs.join(mine, key, "left_anti").count(),
        "admit": "synonym" not in relations.values() and fired > 0,
    }


def atom_reuse(rules: list[r.Rule]) -> dict[str, int]:
    """In how many rules each predicate stands."""
    out: dict[str, int] = {}
    for x in rules:
        for a in {a.atom_id for a in x.atoms()}:
            out[a] = out.get(a, 0) + 1
    return out


def diagnose(rule: r.Rule, event: dict, reuse: dict[str, int]) -> str:
    """Why a rule does not fire on one event; the first reason that applies. A predicate needs its field to be there."""
    if r.matches(rule, event):
        return "fires"
    signs = r.block_signs(rule)
    blocks = {b.name: b for b in rule.blocks}
    wanted = [a for n, s in signs.items() if 1 in s for m in blocks[n].maps for a in m]
    clauses = [a for a in wanted if isinstance(a, r.Clause)]
    there = [a for a in clauses if a.field in event]

    def hit(a: r.Clause) -> bool:
        return a.field in event and r.matches(r.Rule("", (r.Block("x", "and", ((a,),)),), r.Ref("x")), event)

    missed = [a for a in clauses if not hit(a)]
    wrong = [a for a in missed if a.field in event]
    filters = [n for n, s in signs.items() if -1 in s and r.matches(r.Rule("", (blocks[n],), r.Ref(n)), event)]
    if not clauses and len(wanted) > 0 and event:
        return "keyword-miss"
    if not there:
        return "wrong-channel"
    if not missed:
        return "filter-excluded" if filters else "composition-gap"
    if wrong:
        return "unvouched-miss" if any(reuse.get(a.atom_id, 0) <= 1 for a in wrong) else "variant-miss"
    return "field-absent-gap"
