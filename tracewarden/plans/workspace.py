"""A case folder: which sources and rules an engagement uses, what was found, what was learnt, and manifests of runs.

Everything is written and read through Spark, so the folder may be anywhere that the cluster can reach. Findings are
addressed by content and never change; parameters have names and are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import corpus, coverage
from tracewarden.operators import rules as r
from tracewarden.sources import events

#: Readers by kind of source.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": events.csv_events,
    "cloudtrail": events.cloudtrail_events,
    "jsonl": events.jsonl_events,
    "json": events.json_events,
    "xml": events.event_xml,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def _canonical(payload) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)


def content_id(payload) -> str:
    return hashlib.sha256(_canonical(payload).encode()).hexdigest()


def table_id(rows: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order: two sums of row hashes and the count, taken by all tasks."""
    names = sorted(rows.columns)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))
    one = rows.agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).first()
    return content_id([names, one["n"], str(one["a"]), str(one["b"])])


def put_json(spark: SparkSession, path: str, payload) -> None:
    spark.createDataFrame([(_canonical(payload),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def get_json(spark: SparkSession, path: str):
    """What put_json() wrote, or None where nothing is."""
    try:
        lines = spark.read.text(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads("\n".join(x["value"] for x in lines))


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    path: str


@dataclass(frozen=True)
class Workspace:
    root: str
    sources: tuple[Source, ...]
    ruleset: str = ""
    version: str = ""
    recipes: tuple[str, ...] = ()

    def save(self, spark: SparkSession) -> None:
        put_json(spark, f"{self.root}/workspace", {"sources": [asdict(s) for s in self.sources], "ruleset": self.ruleset, "version": self.version, "recipes": list(self.recipes)})

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Workspace:
        m = get_json(spark, f"{root}/workspace")
        if m is None:
            raise FileNotFoundError(root)
        return cls(root, tuple(Source(**s) for s in m["sources"]), m["ruleset"], m["version"], tuple(m["recipes"]))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A source's events by its name, through the reader of its kind."""
        found = [s for s in self.sources if s.name == name]
        if not found:
            raise KeyError(name)
        if found[0].kind not in READERS:
            raise ValueError(f"no reader for sources of kind {found[0].kind}")
        return READERS[found[0].kind](spark, found[0].path)

    def keep(self, rows: DataFrame, kind: str) -> str:
        """Store a finding under the digest of its rows and the ruleset; storing it again changes nothing."""
        cid = content_id([kind, self.ruleset, self.version, table_id(rows)])
        rows.write.mode("ignore").parquet(f"{self.root}/derived/{cid}")
        return cid

    def derived(self, spark: SparkSession, cid: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/derived/{cid}")

    def learn(self, spark: SparkSession, name: str, payload) -> None:
        put_json(spark, f"{self.root}/parameters/{name}", payload)

    def learnt(self, spark: SparkSession, name: str):
        """A parameter, or None before it was learnt."""
        return get_json(spark, f"{self.root}/parameters/{name}")

    def cover(self, hits: DataFrame, location: DataFrame, tags: DataFrame, technique: str, key: str) -> tuple[DataFrame, str]:
        """location_coverage() of this workspace's rules, stored; compare two runs with coverage.coverage_changes()."""
        spark = hits.sparkSession
        cid = self.keep(coverage.location_coverage(hits, location, tags, technique, key), f"coverage:{technique}")
        return self.derived(spark, cid), cid


# ---------------------------------------------------------------- manifests


@dataclass(frozen=True)
class Manifest:
    techniques: tuple[str, ...]
    code: str | None
    stages: dict[str, str | None]  # None: a stage that had no input
    result: str


def treat(spark: SparkSession, raw: list[dict], techniques: list[str], code: str | None = None, hits: DataFrame | None = None, key: str = "event_id") -> tuple[Manifest, dict[str, DataFrame]]:
    """Take a rule corpus through its stages: rules that can be evaluated, their compiled content, lattice and coverage, and
    behaviour where hits are given. The manifest pins every stage by content; equal inputs give equal manifests."""
    good = [x for x in raw if isinstance(x, dict) and r.evaluability(x)[0]]
    compiled = [r.compile_rule(x) for x in good]
    rows = [(x.rule_id, a.atom_id) for x in compiled for a in x.atoms()]
    tokens = spark.createDataFrame(rows, "rule_id string, atom string").distinct()
    tags = spark.createDataFrame([(str(x.get("id", "?")), t.upper()) for x in good for t in r.techniques_of(x)], "rule_id string, technique string").distinct()
    want = spark.createDataFrame([(t,) for t in techniques], "technique string")
    edges = corpus.lattice_edges(tokens, "rule_id", "atom")
    out = {"lattice": edges, "coverage": coverage.report(tags, tokens, corpus.classes_of(tokens, "rule_id", "atom"), edges, want)}
    if hits is not None:
        out["behaviour"] = coverage.behaviour_against_structure(hits, tokens.withColumnRenamed("atom", "token"), key)
    stages: dict[str, str | None] = {
        "ingest": content_id(sorted((str(x.get("id", "?")), content_id(x.get("detection"))) for x in good)),
        "compile": content_id(sorted(rows)),
        "behaviour": None,
    } | {name: table_id(d) for name, d in out.items()}
    return Manifest(tuple(sorted(techniques)), code, stages, content_id({k: v for k, v in stages.items() if v})), out


def changed_stages(a: Manifest, b: Manifest) -> list[str]:
    """Stages whose content differs between two runs; none where both gave the same result."""
    return sorted(s for s in {*a.stages, *b.stages} if a.stages.get(s) != b.stages.get(s))
