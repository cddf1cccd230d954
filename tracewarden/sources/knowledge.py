"""Knowledge sources: rules in YAML, technique bundles, triples, attack flows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "path string, rule_id string, title string, level string, status string, techniques array<string>, tactics array<string>, logsource map<string,string>, detection string, reason string"
_TECHNIQUE = re.compile(r"attack\.(t\d{4}(?:\.\d{3})?)$", re.IGNORECASE)
_TACTIC = re.compile(r"attack\.([a-z][a-z_-]+)$", re.IGNORECASE)


def yaml_rules(spark: SparkSession, root: str, pattern: str = "*.yml") -> DataFrame:
    """Rule files under root, one row per document; detection is kept as JSON, reason says whether it can be evaluated.

    Files that aren't YAML give a row with reason `unparseable`, so that an ingest report is a count by reason.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        from tracewarden.operators.rules import evaluability

        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["value"], strict=True):
                try:
                    docs = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
                except yaml.YAMLError:
                    rows.append((path, None, None, None, None, [], [], {}, None, "unparseable"))
                    continue
                for d in docs:
                    tags = [str(t) for t in d.get("tags") or []]
                    tech = sorted({m[1].upper() for t in tags if (m := _TECHNIQUE.match(t))})
                    tact = sorted({m[1].lower() for t in tags if not _TECHNIQUE.match(t) and (m := _TACTIC.match(t))})
                    source = {str(k): str(v) for k, v in (d.get("logsource") or {}).items() if v is not None}
                    rows.append((path, str(d.get("id", "?")), d.get("title"), d.get("level"), d.get("status"), tech, tact, source, json.dumps(d.get("detection"), default=str), evaluability(d)[1]))
            yield pd.DataFrame(rows, columns=["path", "rule_id", "title", "level", "status", "techniques", "tactics", "logsource", "detection", "reason"])

    return files.mapInPandas(parse, RULE_SCHEMA)


def parse_report(rules: DataFrame) -> DataFrame:
    """files, rules, deferred (correlations) and errors of an ingest."""
    return rules.agg(F.countDistinct("path").alias("files"), F.count_if(F.expr("reason NOT IN ('correlation', 'unparseable')")).alias("rules"), F.count_if(F.col("reason") == "correlation").alias("deferred"), F.count_if(F.col("reason") == "unparseable").alias("errors"))


def rules_for_technique(rules: DataFrame, technique: str) -> DataFrame:
    return rules.where(F.array_contains("techniques", technique))


def rules_for_tactic(rules: DataFrame, tactic: str) -> DataFrame:
    return rules.where(F.array_contains("tactics", tactic))


def analytics_yaml(spark: SparkSession, root: str, pattern: str = "*.yaml") -> DataFrame:
    """Analytics with coverage and data-model references: rule_id, title, platforms, techniques, atoms (field references)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select("value")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in parts:
            rows = []
            for text in part["value"]:
                try:
                    d = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if isinstance(d, dict) and d.get("id"):
                    tech = set()
                    for c in d.get("coverage") or []:
                        tech |= {str(x) for x in [c.get("technique"), *(c.get("subtechniques") or [])] if x}
                    refs = [str(r).split("/")[-1] for r in d.get("data_model_references") or []]
                    rows.append((str(d["id"]), d.get("title"), [str(p) for p in d.get("platforms") or []], sorted(tech), sorted(set(refs))))
            yield pd.DataFrame(rows, columns=["rule_id", "title", "platforms", "techniques", "atoms"])

    return files.mapInPandas(parse, "rule_id string, title string, platforms array<string>, techniques array<string>, atoms array<string>")


_BUNDLE = "objects array<struct<id:string,type:string,name:string,relationship_type:string,source_ref:string,target_ref:string,revoked:boolean,x_mitre_deprecated:boolean,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"


def bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A technique bundle as tables: techniques(stix_id, attack_id, name), tactics(attack_id, tactic), parents(child, parent)."""
    o = spark.read.schema(_BUNDLE).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")
    live = o.where("NOT coalesce(revoked, false) AND NOT coalesce(x_mitre_deprecated, false)")
    ident = F.element_at(F.transform(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), lambda r: r["external_id"]), 1)
    tech = live.where("type = 'attack-pattern' AND size(external_references) > 0").select(F.col("id").alias("stix_id"), ident.alias("attack_id"), "name", "kill_chain_phases")
    tactics = tech.select("attack_id", F.explode("kill_chain_phases").alias("k")).select("attack_id", F.col("k.phase_name").alias("tactic")).distinct()
    rel = live.where("type = 'relationship' AND relationship_type = 'subtechnique-of'").select("source_ref", "target_ref")
    a, b = tech.select(F.col("stix_id").alias("source_ref"), F.col("attack_id").alias("child")), tech.select(F.col("stix_id").alias("target_ref"), F.col("attack_id").alias("parent"))
    return {"techniques": tech.drop("kill_chain_phases"), "tactics": tactics, "parents": rel.join(a, "source_ref").join(b, "target_ref").select("child", "parent")}


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines, or of Turtle written one statement a line with full IRIs; literals lose their tags."""
    line = '^\\s*(<[^>]*>|_:\\S+)\\s+(<[^>]*>|a)\\s+(<[^>]*>|_:\\S+|"(?:[^"\\\\]|\\\\.)*")(?:@[A-Za-z-]+|\\^\\^<[^>]*>)?\\s*\\.\\s*$'
    t = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_replace(F.regexp_extract("value", line, i), '^[<"]|[>"]$', "")
    p = part(2)
    return t.select(part(1).alias("s"), F.when(p == "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type").otherwise(p).alias("p"), part(3).alias("o"))


def write_turtle(edges: DataFrame, path: str, prefix: str = "urn:rule:") -> None:
    """Graded edges (a, rel, b) as SKOS statements, one a line."""
    names = {"exact": "exactMatch", "close": "closeMatch", "broader": "broader", "narrower": "narrower", "related": "related"}
    rel = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("rel")]
    iri = lambda c: F.concat(F.lit("<" + prefix), F.col(c).cast("string"), F.lit(">"))
    edges.select(F.concat_ws(" ", iri("a"), F.concat(F.lit("<http://www.w3.org/2004/02/skos/core#"), rel, F.lit(">")), iri("b"), F.lit("."))).write.mode("overwrite").text(path)


_FLOW = "objects array<struct<id:string,type:string,technique_id:string,tactic_id:string,effect_refs:array<string>,on_true_refs:array<string>,on_false_refs:array<string>,start_refs:array<string>>>"


def attack_flows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Flow files as actions(flow, id, technique, tactic) and steps(flow, src, dst) between actions, across operators."""
    from tracewarden.operators.graph import closure

    o = spark.read.schema(_FLOW).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("flow"), F.explode("objects").alias("o")).select("flow", "o.*")
    empty = F.array().cast("array<string>")
    refs = F.concat(*[F.coalesce(c, empty) for c in ("effect_refs", "on_true_refs", "on_false_refs")])
    key = lambda c: F.concat_ws("|", "flow", c)
    edges = o.select("flow", key("id").alias("src"), "type", F.explode(refs).alias("to")).select("src", "type", key("to").alias("dst"))
    actions = o.where("type = 'attack-action'").select("flow", key("id").alias("id"), F.col("technique_id").alias("technique"), F.col("tactic_id").alias("tactic"))
    direct = edges.where("type = 'attack-action'").select("src", "dst")
    hop = edges.where("type <> 'attack-action'").select("src", "dst")
    reach = closure(hop, direct.select(F.col("dst").alias("node")).distinct())
    steps = direct.join(reach, direct.dst == reach.start).select("src", F.col("node").alias("dst")).join(actions.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
    return {"actions": actions, "steps": steps}


def flow_model(flows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """transitions(from, to, n, p) between tactics, starts(tactic, n) and emissions(tactic, technique, p) of flows."""
    from pyspark.sql import Window

    a = flows["actions"]
    step = flows["steps"].join(a.select(F.col("id").alias("src"), F.col("tactic").alias("from")), "src").join(a.select(F.col("id").alias("dst"), F.col("tactic").alias("to")), "dst")
    n = step.where("`from` IS NOT NULL AND `to` IS NOT NULL").groupBy("from", "to").agg(F.count("*").alias("n"))
    first = a.join(flows["steps"].select(F.col("dst").alias("id")).distinct(), "id", "left_anti").where("tactic IS NOT NULL").groupBy("tactic").agg(F.count("*").alias("n"))
    e = a.where("tactic IS NOT NULL AND technique IS NOT NULL").groupBy("tactic", "technique").agg(F.count("*").alias("n"))
    return {
        "transitions": n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from"))),
        "starts": first,
        "emissions": e.select("tactic", "technique", (F.col("n") / F.sum("n").over(Window.partitionBy("tactic"))).alias("p")),
    }
