"""What a rule corpus covers: by technique, variant and location, structurally and on labelled events; defences likewise.

Tables used throughout: tags(rule_id, technique), atoms(rule_id, atom, sign), hits(rule_id, key columns of an event).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.plans.storage import cut

from .corpus import catch_digest, classes_of
from .pairs import in_blocks, shared_counts

# The eighteen phases of the Unified Kill Chain in order, each with its stage and the tactic of that name.
KILL_CHAIN = (
    ("reconnaissance", "in", "reconnaissance"),
    ("resource-development", "in", "resource-development"),
    ("delivery", "in", "initial-access"),
    ("social-engineering", "in", None),
    ("exploitation", "in", None),
    ("persistence", "in", "persistence"),
    ("defense-evasion", "in", "defense-evasion"),
    ("command-and-control", "in", "command-and-control"),
    ("pivoting", "through", None),
    ("discovery", "through", "discovery"),
    ("privilege-escalation", "through", "privilege-escalation"),
    ("execution", "through", "execution"),
    ("credential-access", "through", "credential-access"),
    ("lateral-movement", "through", "lateral-movement"),
    ("collection", "out", "collection"),
    ("exfiltration", "out", "exfiltration"),
    ("impact", "out", "impact"),
    ("objectives", "out", None),
)


def _ratio(a: Column, n: Column, digits: int) -> Column:
    return F.round(F.when(n > 0, a / n).otherwise(0.0), digits)


# ---------------------------------------------------------------- predicates and techniques


def atom_spread(atoms: DataFrame, tags: DataFrame) -> DataFrame:
    """(atom, techniques): in rules of how many techniques each predicate stands."""
    d = atoms.select("rule_id", "atom").distinct().join(tags.distinct(), "rule_id").select("atom", "technique").distinct()
    return d.groupBy("atom").agg(F.count("*").alias("techniques"))


def candidate_techniques(fired: DataFrame, atoms: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """(key, technique) that an event's true predicates, fired(key, atom), point at; predicates used only in negation don't."""
    points = atoms.where("sign = 1").select("rule_id", "atom").distinct().join(tags, "rule_id").select("atom", "technique").distinct()
    return fired.join(points, "atom").select(key, "technique").distinct()


# ---------------------------------------------------------------- structural coverage


def report(tags: DataFrame, atoms: DataFrame, classes: DataFrame, edges: DataFrame, requested: DataFrame) -> DataFrame:
    """Per requested(technique): rules, concepts (rules of equal content are one, by classes(rule_id, class_id)), redundancy,
    atoms, families (rules that are broader than another one of the technique, by edges(a, b, rel)); gap where no rule is.

    Rules outside classes or edges stand for themselves. Absence of rules is a gap in knowledge, not proof of none.
    """
    want = requested.select(F.upper("technique").alias("technique")).distinct()
    own = tags.select("rule_id", F.upper("technique").alias("technique")).distinct().join(want, "technique")
    concept = F.coalesce(F.col("class_id"), F.col("rule_id"))
    per = own.join(classes.select("rule_id", "class_id"), "rule_id", "left").groupBy("technique").agg(F.count("*").alias("rules"), F.count_distinct(concept).alias("concepts"))
    used = own.join(atoms.select("rule_id", "atom").distinct(), "rule_id").select("technique", "atom").distinct().groupBy("technique").agg(F.count("*").alias("atoms"))
    wide = edges.where("rel = 'broader'").select(F.col("a").alias("general"), F.col("b").alias("special"))
    wide = wide.union(edges.where("rel = 'narrower'").select(F.col("b").alias("general"), F.col("a").alias("special"))).distinct()
    g, s = own.select("technique", F.col("rule_id").alias("general")), own.select("technique", F.col("rule_id").alias("special"))
    fam = wide.join(g, "general").join(s, ["technique", "special"]).select("technique", "general").distinct().groupBy("technique").agg(F.count("*").alias("families"))
    out = want.join(per, "technique", "left").join(used, "technique", "left").join(fam, "technique", "left").na.fill(0, ["rules", "concepts", "atoms", "families"])
    return out.select("technique", "rules", "concepts", _ratio(F.col("rules"), F.col("concepts"), 2).alias("redundancy"), "atoms", "families", (F.col("rules") == 0).alias("gap"))


def behaviour_against_structure(hits: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Pairs of rules that fired, counted by behaviour (co-catch, overlap, disjoint) and structure (exact, nested, related,
    none): where one is co-catch without exact, or exact without co-catch, merging rules by content goes wrong.

    tokens(rule_id, token). Rules are reduced to kinds of equal catch and equal content, and events to those on which different
    sets of kinds fire. Kinds are then compared block by block and counted where they are compared: no pair becomes a row.
    Events and tokens go by 64-bit hashes.
    """
    h = cut(hits.select("rule_id", F.to_json(F.struct(key)).alias("e")).distinct())
    caught = cut(classes_of(h, "rule_id", "e").withColumnRenamed("class_id", "catch"))
    t = cut(tokens.select("rule_id", "token").distinct().join(caught.select("rule_id"), "rule_id"))
    content = classes_of(t, "rule_id", "token").withColumnRenamed("class_id", "content")
    kinds = caught.join(content, "rule_id", "left").groupBy("catch", "content").agg(F.count("*").alias("n"))
    own = h.join(caught.where("rule_id = catch").select("rule_id"), "rule_id")
    same = catch_digest(own.toDF("event", "rule_id").select("rule_id", "event"), "event").select(F.col("rule_id").alias("e"), F.xxhash64("h1", "h2", "n_caught").alias("x"))
    events = own.join(same, "e").groupBy(F.col("rule_id").alias("catch")).agg(F.collect_set("x").alias("events"))
    words = t.groupBy(F.col("rule_id").alias("content")).agg(F.collect_set(F.xxhash64("token")).alias("tokens"))
    d = kinds.join(events, "catch").join(words, "content", "left").select("catch", "n", "events", F.coalesce("tokens", F.array().cast("array<bigint>")).alias("tokens"))
    shared = shared_counts()

    def count(left, right, one):
        import numpy as np
        import pyarrow as pa

        (ae, be), (at, bt) = ([x[c][0] for x in (left, right)] for c in ("events", "tokens"))
        na, nb = (x["n"].to_numpy().astype(float) for x in (left, right))
        told = np.zeros(12)
        for (lo, e), (_, k) in zip(shared(left["events"], right["events"]), shared(left["tokens"], right["tokens"]), strict=True):
            rows = slice(lo, lo + len(e))
            alike = (e == ae[rows, None]) & (e == be[None])
            within = (k == at[rows, None]).astype(np.int8) + (k == bt[None])
            code = np.where(alike, 0, np.where(e > 0, 4, 8)) + np.where(k > 0, 2 - within, 3)
            pairs = np.outer(na[rows], nb)
            if one:  # each pair of kinds once, and of a kind's own rules those before each other
                own = np.arange(len(e)), np.arange(lo, lo + len(e))
                of = pairs[own]
                pairs = np.triu(pairs, lo + 1)
                pairs[own] = (of - na[rows]) / 2
            told += np.bincount(code.ravel(), weights=pairs.ravel(), minlength=12)
        yield pa.RecordBatch.from_pydict({"code": pa.array(range(12), pa.int32()), "pairs": pa.array(told.astype(np.int64))})

    told = in_blocks(d, "catch")(count, "code int, pairs long").groupBy("code").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
    name = lambda names, c: F.element_at(F.array(*map(F.lit, names)), c.cast("int") + 1)
    behaviour = name(("co-catch", "overlap", "disjoint"), F.floor(F.col("code") / 4))
    return told.select(behaviour.alias("behaviour"), name(("exact", "nested", "related", "none"), F.col("code") % 4).alias("structure"), "pairs")


# ---------------------------------------------------------------- coverage on labelled events


def scorecard(hits: DataFrame, labels: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Per technique of labels(key, technique; null: benign): its rules, those that catch a labelled event, silent ones, false
    alarms (rules that fire on a benign event) and clean catchers, and the share that catches.

    Techniques without labelled events are unknown, and left out. False alarms are an upper bound where benign events may
    hold attacks that nobody labelled.
    """
    want = labels.where("technique IS NOT NULL").select(key, "technique").distinct()
    benign = labels.where("technique IS NULL").select(key).distinct()
    claim = tags.distinct().join(want.select("technique").distinct(), "technique")
    caught = hits.select("rule_id", key).join(want, key).join(claim, ["rule_id", "technique"]).select("rule_id", "technique").distinct().withColumn("caught", F.lit(1))
    alarm = hits.select("rule_id", key).join(benign, key, "left_semi").select("rule_id").distinct().withColumn("alarm", F.lit(1))
    d = claim.join(caught, ["rule_id", "technique"], "left").join(alarm, "rule_id", "left").na.fill(0, ["caught", "alarm"])
    n = d.groupBy("technique").agg(F.count("*").alias("rules"), F.sum("caught").alias("catching"), F.sum("alarm").alias("false_alarms"), F.sum(F.col("caught") * (1 - F.col("alarm"))).alias("clean"))
    out = want.groupBy("technique").agg(F.count("*").alias("labelled")).join(n, "technique", "left").na.fill(0)
    return out.select("technique", "labelled", "rules", "catching", (F.col("rules") - F.col("catching")).alias("silent"), "false_alarms", "clean", _ratio(F.col("catching"), F.col("rules"), 3).alias("catch_rate"))


def variant_coverage(hits: DataFrame, scenarios: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Per (technique, variant, channel) of scenarios(key, ..): the rules of the technique that fire on one of its events."""
    by = ["technique", "variant", "channel"]
    h = hits.select("rule_id", key).join(scenarios, key).join(tags.distinct(), ["rule_id", "technique"]).select(*by, "rule_id").distinct()
    rules = h.groupBy(*by).agg(F.sort_array(F.collect_list("rule_id")).alias("catchers"))
    out = scenarios.select(*by).distinct().join(rules, by, "left").withColumn("catchers", F.coalesce("catchers", F.array().cast("array<string>")))
    return out.withColumn("caught", F.size("catchers") > 0)


def location_coverage(hits: DataFrame, location: DataFrame, tags: DataFrame, technique: str, key: str) -> DataFrame:
    """Rules of a technique at one labelled place, location(key): witness where the rule fires there, else gap."""
    there = hits.select("rule_id", key).join(location.select(key).distinct(), key, "left_semi").select("rule_id").distinct().withColumn("_fires", F.lit(True))
    own = tags.where(F.col("technique") == technique).select("rule_id").distinct()
    return own.join(there, "rule_id", "left").select("rule_id", F.when(F.col("_fires"), "witness").otherwise("gap").alias("role"))


def coverage_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules whose role differs between two location_coverage() results: rule_id, was, now (null: absent)."""
    d = old.select("rule_id", F.col("role").alias("was")).join(new.select("rule_id", F.col("role").alias("now")), "rule_id", "full")
    return d.where(~F.col("was").eqNullSafe(F.col("now")))


# ---------------------------------------------------------------- defences


def defences(counters: DataFrame, techniques: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Per techniques(technique): the defences that act on an artefact it touches, from counters(technique, defence, artefact),
    their number, the artefacts they work by, and the detection rules tagged with it. No defence is a result, too."""
    want = techniques.select("technique").distinct()
    own = counters.select("technique", "defence", "artefact").distinct().join(want, "technique")
    per = own.groupBy("technique", "defence").agg(F.sort_array(F.collect_set("artefact")).alias("via"))
    per = per.groupBy("technique").agg(F.sort_array(F.collect_list(F.struct("defence", "via"))).alias("defences"))
    out = want.join(per, "technique", "left").withColumn("defences", F.coalesce("defences", F.array().cast("array<struct<defence:string,via:array<string>>>")))
    out = out.withColumn("n_defences", F.size("defences"))
    if tags is None:
        return out
    r = tags.select("technique", "rule_id").distinct().groupBy("technique").agg(F.sort_array(F.collect_list("rule_id")).alias("rules"))
    return out.join(r, "technique", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))


def techniques_in(tactics: DataFrame, tactic: str | None = None, phase: str | None = None, stage: str | None = None) -> DataFrame:
    """(technique) of tactics(technique, tactic) that belong to a tactic, or to a phase or stage of the Unified Kill Chain;
    phases without a tactic, and unknown names, have none."""
    names = [tactic] if tactic else [t for p, s, t in KILL_CHAIN if t and (p == phase or s == stage)]
    return tactics.where(F.col("tactic").isin(names)).select("technique").distinct()


def subtechniques(parents: DataFrame, parent: str) -> DataFrame:
    """(technique): children of a technique in parents(child, parent)."""
    return parents.where(F.col("parent") == parent).select(F.col("child").alias("technique")).distinct()


def tactics_of(tactics: DataFrame, technique: str) -> DataFrame:
    return tactics.where(F.col("technique") == technique).select("tactic").distinct()
