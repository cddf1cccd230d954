"""Graphs as DataFrames: closures, components, bridges between vocabularies, triples and what they entail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.plans.storage import cut


def closure(edges: DataFrame, seeds: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """(start, node) for all nodes reachable from each seed, itself included: edges(src, dst), seeds(node).

    A frontier loop: each step joins only what was new in the last one, and stops at a fixpoint, so cycles are no trouble.
    """
    edges = edges.select("src", "dst").distinct()
    reached = cut(seeds.select(F.col("node").alias("start"), "node").distinct())
    front = reached
    for _ in range(max_steps):
        step = front.join(edges, front.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(reached, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return reached
        reached = cut(reached.unionByName(front))
    raise RuntimeError("no fixpoint within max_steps")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges(a, b), for nodes that have one."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        low = near.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("j"))
        new = cut(low.join(jump, "component", "left").select("node", F.least("component", F.coalesce("j", "component")).alias("component")))
        if new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new
        labels = new


def flows(edges: DataFrame, sinks: DataFrame, sources: DataFrame) -> DataFrame:
    """(sink, source): sinks with a source among their ancestors; edges(child, parent)."""
    up = closure(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), sinks.select("node"))
    return up.where("start <> node").join(sources.select("node").distinct(), "node", "left_semi").select(F.col("start").alias("sink"), F.col("node").alias("source"))


# ---------------------------------------------------------------- bridges


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(source, target) of first ∘ second."""
    return first.select("source", F.col("target").alias("mid")).join(second.select(F.col("source").alias("mid"), "target"), "mid").select("source", "target").distinct()


def invert(bridge: DataFrame) -> DataFrame:
    return bridge.select(F.col("target").alias("source"), F.col("source").alias("target"))


def bridges_from_triples(triples: DataFrame, source_prefix: str, target_prefix: str, predicates: list[str]) -> DataFrame:
    """Match triples between two vocabularies, in either direction, as (source, target)."""
    t = triples.where(F.col("p").isin(predicates))
    there = t.where(F.col("s").startswith(source_prefix) & F.col("o").startswith(target_prefix)).select(F.col("s").alias("source"), F.col("o").alias("target"))
    back = t.where(F.col("o").startswith(source_prefix) & F.col("s").startswith(target_prefix)).select(F.col("o").alias("source"), F.col("s").alias("target"))
    return there.union(back).distinct()


# ---------------------------------------------------------------- triples

SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
ON_PROPERTY = "http://www.w3.org/2002/07/owl#onProperty"
SOME_VALUES = "http://www.w3.org/2002/07/owl#someValuesFrom"


def entailed_types(triples: DataFrame) -> DataFrame:
    """RDFS: types of instances, also through subclasses, as (s, o)."""
    types = triples.where(F.col("p") == TYPE).select("s", "o")
    edges = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    up = closure(edges, types.select(F.col("o").alias("node")).distinct())
    return types.join(up, types.o == up.start).select("s", F.col("node").alias("o")).distinct()


def restrictions(triples: DataFrame) -> DataFrame:
    """(cls, relation, artefact): what classes say through anonymous `some values from` restrictions."""
    sub = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("cls"), F.col("o").alias("r"))
    prop = triples.where(F.col("p") == ON_PROPERTY).select(F.col("s").alias("r"), F.col("o").alias("relation"))
    some = triples.where(F.col("p") == SOME_VALUES).select(F.col("s").alias("r"), F.col("o").alias("artefact"))
    return sub.join(prop, "r").join(some, "r").select("cls", "relation", "artefact").distinct()


def counters(triples: DataFrame, techniques: DataFrame, defence_root: str) -> DataFrame:
    """(technique, defence, artefact, offensive, defensive): defences that act on an artefact a technique touches.

    techniques(node) are classes; those related to them by subclassing in either direction count as well. The artefacts they
    touch are widened to their ancestors; a defence's artefacts are taken as they are.
    """
    sub = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    down = sub.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rel = cut(restrictions(triples))
    related = closure(sub, techniques).union(closure(down, techniques)).distinct()
    touched = related.join(rel, related.node == rel.cls).select(F.col("start").alias("technique"), F.col("relation").alias("offensive"), "artefact")
    wide = closure(sub, touched.select(F.col("artefact").alias("node")).distinct())
    touched = touched.join(wide, touched.artefact == wide.start).select("technique", "offensive", F.col("node").alias("artefact")).distinct()
    root = techniques.sparkSession.createDataFrame([(defence_root,)], "node string")
    defences = closure(down, root).select(F.col("node").alias("cls")).distinct()
    acts = rel.join(defences, "cls", "left_semi").select(F.col("cls").alias("defence"), F.col("relation").alias("defensive"), "artefact")
    return touched.join(acts, "artefact").select("technique", "defence", "artefact", "offensive", "defensive").distinct()


def count_violations(triples: DataFrame, cls: str, predicate: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Instances of cls with fewer than least or more than most values of a predicate: node, n."""
    nodes = triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select(F.col("s").alias("node")).distinct()
    n = triples.where(F.col("p") == predicate).groupBy(F.col("s").alias("node")).agg(F.count_distinct("o").alias("n"))
    d = nodes.join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = F.lit(False)
    bad = bad | (F.col("n") < least) if least is not None else bad
    bad = bad | (F.col("n") > most) if most is not None else bad
    return d.where(bad)
