"""Truth of predicates as facts: what follows from them, where they contradict each other, and which rules they entail.

An event's facts are an array of booleans in the order of the predicates; null is unknown. Relations between predicates are
driver-side metadata (see rules.atom_relations), so that everything here is a projection of the events: no shuffle, no Python.
Also the guard of vocabularies: rules are fired only on events that name their fields alike, or after a rewrite.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CHUNK, Clause, Keyword, Rule, block_signs, collect_atoms, fire, fire_direct, rule_column, selectivity, with_atoms

# ---------------------------------------------------------------- consequences and contradictions


def chain_length(implications: list[tuple[int, int]]) -> int:
    """Most steps that a conclusion can be away from a fact."""
    reach: dict[int, set[int]] = {}
    for a, b in implications:
        reach.setdefault(a, set()).add(b)
    far = 0
    for start in reach:
        seen, front, steps = {start}, {start}, 0
        while front := {b for a in front for b in reach.get(a, ())} - seen:
            seen |= front
            steps += 1
        far = max(far, steps)
    return far


def derive(events: DataFrame, facts: str, implications: list[tuple[int, int]]) -> DataFrame:
    """events with facts completed: an unknown predicate is true if one that implies it is. What was seen to be false stays
    false (a contradiction, see contradictions), and nothing follows through it."""
    into: dict[int, list[int]] = {}
    for a, b in implications:
        into.setdefault(b, []).append(a)
    ids = sorted(into)
    for _ in range(chain_length(implications)):
        old = F.col(facts)
        new = [F.coalesce(old[b], F.when(reduce(lambda x, y: x | y, [F.coalesce(old[a], F.lit(False)) for a in into[b]]), F.lit(True))) for b in ids]
        told = F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*new))
        events = events.withColumn("_new", told).withColumn(facts, F.transform(facts, lambda v, i: F.coalesce(v, F.col("_new")[i]))).drop("_new")
    return events


def contradictions(events: DataFrame, facts: str, implications: list[tuple[int, int]], exclusions: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """keys, kind, a, b: implications of which a is true and b false, and exclusions of which both are true."""
    f = F.col(facts)
    found = [F.when(f[a] & ~f[b], F.struct(F.lit("implication").alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in implications]
    found += [F.when(f[a] & f[b], F.struct(F.lit("exclusion").alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in exclusions]
    if not found:
        return events.select(*keys, F.lit("").alias("kind"), F.lit(0).alias("a"), F.lit(0).alias("b")).limit(0)
    return events.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("x")).select(*keys, "x.*")


# ---------------------------------------------------------------- rules entailed by facts


def rarest_first(rule: Rule, share: dict[str, float]) -> Rule:
    """The same rule, its conjunctions in the order in which they are likeliest to fail."""
    maps = [tuple(tuple(sorted(m, key=lambda a: share.get(a.atom_id, 1.0))) for m in b.maps) for b in rule.blocks]
    return replace(rule, blocks=tuple(replace(b, maps=m) for b, m in zip(rule.blocks, maps, strict=True)))


def needs_a_fact(rule: Rule) -> bool:
    """Whether the rule can't fire unless one of its predicates is true: nothing in it is negated, and no map is empty."""
    return all(s == {1} for s in block_signs(rule).values()) and all(m for b in rule.blocks for m in b.maps)


def entail(events: DataFrame, rules: list[Rule], access: Callable, values: Callable, share: dict[str, float] | None = None) -> DataFrame:
    """Per rule: hits, and of how many events the rule had to be evaluated (evaluated) or not (pruned).

    One pass over the events: each predicate is evaluated once, a rule without negation is passed over where none of its
    predicates is true, and conjunctions go rarest first, by the predicates' shares (measured in a pass before, if not given).
    """
    spark = events.sparkSession
    if share is None:
        share = {r["atom_id"]: r["share"] for r in selectivity(events, rules, access, values).collect()}  # one row a predicate
    out = []
    for at in range(0, len(rules), CHUNK):
        part = [rarest_first(r, share) for r in rules[at : at + CHUNK]]
        atoms = collect_atoms(part)
        place = {a: i for i, a in enumerate(atoms)}

        def truth(atom, p=place) -> Column:
            return F.col("_truth")[p[atom.atom_id]]

        cells = []
        for r in part:
            live = reduce(lambda x, y: x | y, map(truth, r.atoms())) if needs_a_fact(r) else F.lit(True)
            cells.append(F.struct(live.alias("live"), (live & rule_column(r, truth)).alias("hit")))
        sums = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.count_if(c["hit"]).alias("hits"), F.count_if(c["live"]).alias("evaluated"), F.count("*").alias("n")) for r, c in zip(part, cells, strict=True)]
        d = with_atoms(events, [], atoms, access, values).agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out.append(d.select("rule_id", "hits", "evaluated", (F.col("n") - F.col("evaluated")).alias("pruned")))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "rule_id string, hits long, evaluated long, pruned long")


def disagreements(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that only one of two evaluations has, and which: keys, only_in."""
    a, b = one.select(*keys).distinct(), two.select(*keys).distinct()
    only = [x.join(y, keys, "left_anti").withColumn("only_in", F.lit(n)) for n, x, y in (("first", a, b), ("second", b, a))]
    return only[0].unionByName(only[1])


def attest(events: DataFrame, rules: list[Rule], keys: list[str], access: Callable, values: Callable) -> DataFrame:
    """One row: rules, pairs checked, and disagreements between the engine of shared predicates and the direct one."""
    apart = disagreements(fire(events, rules, keys, access, values), fire_direct(events, rules, keys, access, values), [*keys, "rule_id"])
    n = events.agg(F.count("*").alias("n_events")).crossJoin(apart.agg(F.count("*").alias("disagreements")))
    return n.select(F.lit(len(rules)).alias("n_rules"), (F.col("n_events") * len(rules)).alias("checked"), "disagreements", (F.col("disagreements") == 0).alias("faithful"))


# ---------------------------------------------------------------- vocabularies


@dataclass(frozen=True)
class Vocabulary:
    """How fields are named; the version of its schema does not matter for whether two sides agree."""

    name: str = "native"
    version: str | None = None


class MixedVocabularies(ValueError):
    """Rules and events name their fields differently: every look-up would miss, and the silence would pass for health."""


def require_same(events: Vocabulary, rules: Vocabulary) -> None:
    if events.name != rules.name:
        raise MixedVocabularies(f"events name fields as {events.name!r}, rules as {rules.name!r}: rewrite the rules or normalise the events first")


@dataclass(frozen=True)
class Rewritten:
    """A rule in another vocabulary, which of its fields were renamed, and which have no name there."""

    rule: Rule
    renamed: tuple[tuple[str, str], ...]
    missing: tuple[str, ...]

    @property
    def complete(self) -> bool:
        return not self.missing


def rewrite(rule: Rule, mapping: dict[str, str]) -> Rewritten:
    """The rule with its clauses' fields renamed; keywords have none, and fields without a name keep their own."""

    def atom(a: Clause | Keyword) -> Clause | Keyword:
        return replace(a, field=mapping.get(a.field, a.field)) if isinstance(a, Clause) else a

    blocks = tuple(replace(b, maps=tuple(tuple(map(atom, m)) for m in b.maps)) for b in rule.blocks)
    fields = sorted(rule.fields())
    return Rewritten(replace(rule, blocks=blocks), tuple((f, mapping[f]) for f in fields if f in mapping), tuple(f for f in fields if f not in mapping))


def guarded_fire(events: DataFrame, rules: list[Rule], keys: list[str], access: Callable, values: Callable, events_in: Vocabulary, rules_in: Vocabulary, mapping: dict[str, str] | None = None) -> DataFrame:
    """fire(), if both sides speak one vocabulary or mapping brings every field of the rules into the events' one.

    Rules that mapping does not cover completely are an error, as they could only be silent.
    """
    if mapping is None:
        require_same(events_in, rules_in)
        return fire(events, rules, keys, access, values)
    done = [rewrite(r, mapping) for r in rules]
    lost = sorted({f for d in done for f in d.missing})
    if lost:
        raise MixedVocabularies(f"no name in {events_in.name!r} for: {', '.join(lost)}")
    return fire(events, [d.rule for d in done], keys, access, values)
