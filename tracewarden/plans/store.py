"""Verdict records kept as a table, keyed by lineage id, with a digest that loading verifies; and their rendering."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import Node, Verdict, lineage


class DigestMismatch(ValueError):
    """A stored record is not what was stored."""


def save_verdicts(rows: DataFrame, path: str, tag: str) -> None:
    """Append rows (cid, record) under a tag; the digest covers cid and record."""
    d = rows.select("cid", "record", F.lit(tag).alias("tag"), F.sha2(F.concat_ws("\n", "cid", "record"), 256).alias("digest"))
    d.write.mode("append").partitionBy("tag").parquet(path)


def load_verdicts(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Stored records with `intact`; a tag reads its partition only."""
    d = spark.read.parquet(path)
    d = d if tag is None else d.where(F.col("tag") == tag)
    return d.withColumn("intact", F.sha2(F.concat_ws("\n", "cid", "record"), 256) == F.col("digest"))


def load_verdict(spark: SparkSession, path: str, cid: str) -> dict:
    got = load_verdicts(spark, path).where(F.col("cid") == cid).limit(1).collect()
    if not got:
        raise KeyError(cid)
    if not got[0]["intact"]:
        raise DigestMismatch(cid)
    return json.loads(got[0]["record"])


def report(record: dict, title: str | None = None) -> str:
    """A verdict record as Markdown."""
    w = record["w_record"]
    lines = [f"# {title or record['technique']}", "", f"- decision: {record['decision']}", f"- score: {record['score']:.4f}", f"- guarantee: {record['guarantee']['tier']}"]
    lines += [f"- {k}: {w[k]}" for k in ("who", "what", "when", "where", "how")]
    lines += [f"- {k}: {record.get(k, 'parked')}" for k in ("custody", "trustworthiness", "cross_check")]
    return "\n".join([*lines, f"- provenance: `{record['provenance']}`", ""])


def dot(root: Node) -> str:
    """The lineage of a node as a Graphviz graph."""
    nodes = lineage(root)
    body = [f'  "{n.id[:16]}" [label="{n.op or "source"}"];' for n in nodes] + [f'  "{p.id[:16]}" -> "{n.id[:16]}";' for n in nodes for p in n.parents]
    return "\n".join(["digraph lineage {", *body, "}"])


def verdict_row(v: Verdict) -> tuple[str, str]:
    return v.provenance, json.dumps(v.contract(), sort_keys=True)


def diff(prior: DataFrame, rerun: DataFrame) -> DataFrame:
    """Rows that only one of two artefacts has: change is `removed` or `added`."""
    return prior.exceptAll(rerun).withColumn("change", F.lit("removed")).unionByName(rerun.exceptAll(prior).withColumn("change", F.lit("added")))
