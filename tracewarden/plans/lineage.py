"""Lazy, content-addressed dataflow over DataFrames (or anything), and folds over its lineage.

A node's id is known before it is computed; evaluating a root computes each node once. Folds walk the lineage in dependency
order: custody of the evidence, confidence of the detectors, the guarantee that computed nodes still have, and the verdict
made of these. For many roots at once, fold_edges does the same level by level on tables of nodes and edges.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import belnap as b
from tracewarden.functions.cid import evidence_digest, recipe_cid

from .storage import cut


@dataclass(frozen=True, eq=False)
class Node:
    id: str
    op: str | None  # None: a source
    params: dict
    parents: tuple[Node, ...]
    compute: Callable[..., Any]
    kind: str | None = None
    evidence: str | None = None  # digest of evidence bytes
    reference: bool = False  # knowledge that is applied, not evidence


_CODE: dict[str, Any] = {}


class OperationChanged(ValueError):
    """An operation's name was used for different code."""


def source(payload: Any, *, name: str | None = None, evidence: bool = False, reference: bool = False, kind: str | None = None) -> Node:
    """A source: identified by its content (evidence bytes) or by its name; a nameless one only by this object."""
    if evidence:
        d = evidence_digest(payload)
        return Node(d, None, {}, (), lambda: payload, kind, evidence=d, reference=reference)
    ident = f"ref:{name}" if name is not None else f"ephemeral:{id(payload)}"
    return Node(ident, None, {}, (), lambda: payload, kind, reference=reference)


def derive(op: str, kernel: Callable[..., Any], parents: Iterable[Node], params: dict | None = None, kind: str | None = None, registered: bool = True) -> Node:
    """A computed node. With registered, a name keeps the code it was first used with."""
    parents, params = tuple(parents), dict(params or {})
    if registered:
        code = getattr(kernel, "__code__", kernel)
        if _CODE.setdefault(op, code) != code:
            raise OperationChanged(op)
    return Node(recipe_cid(op, params, [p.id for p in parents]), op, params, parents, lambda *xs: kernel(*xs, **params), kind)


def lineage(root: Node) -> list[Node]:
    """All nodes the root depends on, dependencies first, each once."""
    done: dict[str, Node] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if node.id in done:
            continue
        if ready:
            done[node.id] = node
        else:
            stack.append((node, True))
            stack += [(p, False) for p in reversed(node.parents)]
    return list(done.values())


def evaluate(root: Node) -> Any:
    """Compute the root; shared nodes once. A DataFrame with several consumers is persisted."""
    order = lineage(root)
    uses: dict[str, int] = {}
    for n in order:
        for p in n.parents:
            uses[p.id] = uses.get(p.id, 0) + 1
    out: dict[str, Any] = {}
    for n in order:
        x = n.compute(*(out[p.id] for p in n.parents))
        out[n.id] = x.persist() if isinstance(x, DataFrame) and uses.get(n.id, 0) > 1 else x
    return out[root.id]


def explain(root: Node) -> str:
    return "\n".join(f"{n.id[:16]} {n.op or 'source'} {json.dumps(n.params, sort_keys=True)} <- {[p.id[:16] for p in n.parents]}" for n in lineage(root))


# ---------------------------------------------------------------- folds


class Tier(IntEnum):
    ABSENT = 0
    WELL_FORMED = 1
    BOUNDED = 2
    MACHINE_CHECKED = 3


@dataclass(frozen=True)
class Confidence:
    """Evidence for and against, and the log-odds that detectors contribute (None: no claim)."""

    belnap: int = b.NONE
    log_odds: float | None = None

    @classmethod
    def detector(cls, fired: bool, pd: float, pfa: float) -> Confidence:
        if not 0 < pfa < 1 or not 0 < pd < 1:
            raise ValueError("rates must lie between 0 and 1")
        return cls(b.TRUE, math.log(pd / pfa)) if fired else cls(b.FALSE, math.log((1 - pd) / (1 - pfa)))

    def __add__(self, other: Confidence) -> Confidence:
        odds = [x for x in (self.log_odds, other.log_odds) if x is not None]
        return Confidence(b.k_join(self.belnap, other.belnap), sum(odds) if odds else None)

    @property
    def probability(self) -> float | None:
        return None if self.log_odds is None else 1 / (1 + math.exp(-self.log_odds))


def confidence(root: Node, evidence: dict[str, Confidence]) -> dict[str, Confidence]:
    """Own evidence plus each parent's, once per edge: shared evidence counts along every path."""
    out: dict[str, Confidence] = {}
    for n in lineage(root):
        out[n.id] = sum((out[p.id] for p in n.parents), evidence.get(n.id, Confidence()))
    return out


@dataclass(frozen=True)
class Certificate:
    subject: str
    tier: Tier
    claimed: Tier
    demotion: str | None = None


_REASON = {b.FALSE: "the precondition is violated", b.BOTH: "monitors contradict each other", b.NONE: "no monitor has spoken"}


def guarantee(root: Node, claims: dict[str, Tier], monitors: dict[str, int] | None = None) -> dict[str, Certificate]:
    """Claimed tiers as far as they stand: bounded and above need a monitor that says true, and no tier exceeds that of a
    computed parent. Unclaimed nodes are absent; sources don't take part."""
    out: dict[str, Certificate] = {}
    for n in lineage(root):
        claim = claims.get(n.id, Tier.ABSENT)
        tier, why = claim, None
        if claim >= Tier.BOUNDED and (said := (monitors or {}).get(n.id, b.NONE)) != b.TRUE:
            tier, why = Tier.WELL_FORMED, _REASON[said]
        if n.op is not None:
            tier = min([tier, *(out[p.id].tier for p in n.parents if p.op is not None)])
        out[n.id] = Certificate(n.id, tier, claim, why)
    return out


@dataclass(frozen=True)
class Attestation:
    digest: str
    signed: bool = True
    live: bool = True


def custody(root: Node, attestations: dict[str, Attestation] | None = None) -> dict[str, int]:
    """Sources: true if signed and of the same digest, false if of another, none if unsigned, silent or unattested.
    Computed nodes: the truth meet over parents that are not reference knowledge."""
    out: dict[str, int] = {}
    for n in lineage(root):
        if n.op is None:
            a = (attestations or {}).get(n.id)
            out[n.id] = b.NONE if a is None or not a.signed or not a.live else b.TRUE if a.digest == (n.evidence or n.id) else b.FALSE
        else:
            own = [out[p.id] for p in n.parents if not p.reference]
            out[n.id] = b.fold(b.t_meet, own, b.TRUE) if own else b.NONE
    return out


def trust(custody_code: int, validity: int) -> int:
    """Custody joined with what validity says about integrity: only malformed content counts, as evidence against."""
    return b.k_join(custody_code, b.FALSE if validity == b.FALSE else b.NONE)


@dataclass(frozen=True)
class CustodyStep:
    agent: str
    materials: tuple[str, ...]
    product: str
    signed: bool = True


def localize(chain: list[CustodyStep], held: str) -> dict:
    """Walk a chain of hand-overs back from what is held: where digests stop fitting, who is beyond suspicion, who is not."""
    if not chain or not all(s.signed for s in chain):
        return {"verdict": b.NONE, "exonerated": [], "suspect": [], "seam_break": None}
    for i in range(1, len(chain)):
        if chain[i - 1].product not in chain[i].materials:
            return {"verdict": b.FALSE, "exonerated": [s.agent for s in chain[: i - 1]], "suspect": [chain[i - 1].agent, chain[i].agent], "seam_break": i}
    if chain[-1].product != held:
        return {"verdict": b.FALSE, "exonerated": [s.agent for s in chain[:-1]], "suspect": [chain[-1].agent], "seam_break": len(chain)}
    return {"verdict": b.TRUE, "exonerated": [s.agent for s in chain], "suspect": [], "seam_break": None}


@dataclass
class Verdict:
    technique: str
    score: float
    decision: int
    who: int
    what: int
    when: int
    where: int
    how: int
    certificate: Certificate
    validity: int
    provenance: str
    deviation: list[str] = field(default_factory=list)
    custody: int | None = None
    trustworthiness: int | None = None
    cross_check: int | None = None
    calibration: dict | None = None

    def contract(self) -> dict:
        """The JSON record; axes that are not tracked are left out."""
        five = {k: getattr(self, k) for k in ("who", "what", "when", "where", "how")}
        out = {
            "technique": self.technique,
            "score": self.score,
            "decision": b.NAMES[self.decision],
            "w_record": {k: b.NAMES[v] for k, v in five.items()} | {"score": sum(v == b.TRUE for v in five.values()) / 5, "provenance": self.provenance},
            "guarantee": {"subject_cid": self.certificate.subject, "tier": self.certificate.tier.name.lower()},
            "validity": {"verdict": b.NAMES[self.validity], "deviation": list(self.deviation)},
            "provenance": self.provenance,
        }
        for key in ("custody", "trustworthiness", "cross_check"):
            if getattr(self, key) is not None:
                out[key] = b.NAMES[getattr(self, key)]
        return out | ({"calibration": self.calibration} if self.calibration else {})


def assemble(root: Node, technique: str, evidence: dict[str, Confidence], claims: dict[str, Tier], *, monitors: dict[str, int] | None = None, attestations: dict[str, Attestation] | None = None, track_custody: bool = True, validity: int = b.NONE, who: int = b.TRUE, what: int | None = None, when: int = b.NONE, where: int = b.NONE, how: int = b.NONE, check: int | None = None, calibration: dict | None = None) -> Verdict:
    conf = confidence(root, evidence)[root.id]
    held = custody(root, attestations)[root.id] if track_custody else None
    return Verdict(
        technique, conf.probability or 0.0, b.k_join(conf.belnap, when), who, conf.belnap if what is None else what, when, where, how, guarantee(root, claims, monitors)[root.id], validity, root.id,
        custody=held, trustworthiness=None if held is None else trust(held, validity), cross_check=None if check is None else b.k_join(conf.belnap, check), calibration=calibration,
    )


# ---------------------------------------------------------------- folds over tables


def fold_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Confidence of many DAGs at once: nodes(node, belnap, log_odds), edges(child, parent) -> nodes with fused values.

    Nodes are settled level by level, a node once all its parents are. Edges repeat evidence along every path.
    """
    need = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("need"))
    left = cut(nodes.join(need, "node", "left").withColumn("need", F.coalesce("need", F.lit(0))))
    done = cut(left.where("need = 0").drop("need"))
    front = done
    waiting = cut(left.where("need > 0"))
    gathered = None
    while not waiting.isEmpty():
        step = edges.join(front.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "belnap", "log_odds")
        gathered = step.withColumn("k", F.lit(1)) if gathered is None else gathered.unionByName(step.withColumn("k", F.lit(1)))
        gathered = cut(gathered.groupBy("node").agg(F.bit_or("belnap").alias("belnap"), F.sum("log_odds").alias("log_odds"), F.sum("k").cast("int").alias("k")))
        ready = waiting.join(gathered.withColumnsRenamed({"belnap": "gb", "log_odds": "gl"}), "node").where("k = need")
        odds = F.when(F.col("log_odds").isNull(), F.col("gl")).otherwise(F.col("log_odds") + F.coalesce("gl", F.lit(0.0)))
        front = cut(ready.select("node", F.col("belnap").bitwiseOR(F.col("gb")).alias("belnap"), odds.alias("log_odds")))
        if front.isEmpty():
            raise ValueError("the graph has a cycle")
        done = cut(done.unionByName(front))
        waiting = cut(waiting.join(front.select("node"), "node", "left_anti"))
    return done


def to_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PROV-O triples (s, p, o) of nodes(node, op) and edges(child, parent)."""
    prov = "http://www.w3.org/ns/prov#"
    a = nodes.select(F.col("node").alias("s"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type").alias("p"), F.lit(prov + "Entity").alias("o"))
    g = nodes.where("op IS NOT NULL").select(F.col("node").alias("s"), F.lit(prov + "wasGeneratedBy").alias("p"), F.concat(F.lit("activity:"), "node").alias("o"))
    d = edges.select(F.col("child").alias("s"), F.lit(prov + "wasDerivedFrom").alias("p"), F.col("parent").alias("o"))
    u = edges.select(F.concat(F.lit("activity:"), "child").alias("s"), F.lit(prov + "used").alias("p"), F.col("parent").alias("o"))
    return a.union(g).union(d).union(u)


def verdict_rows(detections: DataFrame, technique: str, ref: str, p_value: str = "p_value", fired: str = "flagged", pd: float = 0.9, check: str | None = None, axes: dict[str, Column] | None = None) -> DataFrame:
    """Verdict columns for detection rows: score, decision, cross_check, w_score, guarantee, record (JSON).

    A row that fired is evidence for, with log-odds ln(pd / p); one that did not establishes nothing. Axes are four-valued
    codes of who (default: true), what (default: the detection), when, where and how (default: none); w_score is the share
    of the five that are true, and `when` joins the decision.
    """
    yes = F.coalesce(F.col(fired), F.lit(False))
    score = F.when(yes, F.lit(1.0) / (F.lit(1.0) + F.col(p_value) / F.lit(pd))).otherwise(0.0)  # also of a p-value rounded to 0
    detect = F.when(yes, b.TRUE).otherwise(b.NONE)
    five = {"who": F.lit(b.TRUE), "what": detect, "when": F.lit(b.NONE), "where": F.lit(b.NONE), "how": F.lit(b.NONE)} | (axes or {})
    decision = b.col_k_join(detect, five["when"])
    cross = b.col_k_join(detect, b.of(F.col(check), ~F.col(check))) if check else F.lit(None).cast("int")
    w_score = sum(((c == b.TRUE).cast("int") for c in five.values()), F.lit(0)) / F.lit(5.0)
    d = detections.withColumns({"score": score, "decision": b.name_of(decision), "cross_check": b.name_of(cross), "w_score": w_score, "guarantee": F.lit("well_formed")})
    w = F.struct(*[b.name_of(c).alias(k) for k, c in five.items()], F.col("w_score").alias("score"), F.lit(ref).alias("provenance"))
    record = F.to_json(F.struct(F.lit(technique).alias("technique"), F.round("score", 9).alias("score"), "decision", "cross_check", w.alias("w_record")))
    return d.withColumn("record", record)


def offhours_verdicts(found: DataFrame, technique: str, ref: str, hours: tuple[float, float] = (8.0, 18.0)) -> DataFrame:
    """Verdicts on off-hours detections (hour, p_value, flagged); the check asks the clock: is the hour outside business hours?"""
    outside = (F.col("hour") < hours[0]) | (F.col("hour") >= hours[1])
    return verdict_rows(found.withColumn("_outside", outside), technique, ref, check="_outside").drop("_outside")


def coordination_verdicts(pairs: DataFrame, technique: str, ref: str) -> DataFrame:
    """Verdicts on pairs (pearson, p_value, rejected); the check is the linear measure, so anti-phase pairs come out as both."""
    return verdict_rows(pairs.withColumn("_linear", F.col("pearson") > 0), technique, ref, fired="rejected", check="_linear").drop("_linear")


def pattern_verdicts(matches: DataFrame, technique: str, ref: str, times: list[str], who: list[str], where: list[str], p: float = 1e-6) -> DataFrame:
    """Verdicts on structural matches, which say what and how by themselves: who and where hold if any of their columns is
    filled, when if there are two times or more and they ascend. p stands for the precision of an exact match, not for a
    calibrated rate."""

    def filled(columns: list[str]) -> Column:
        have = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in columns]
        return F.when(F.greatest(F.lit(False), F.lit(False), *have), b.TRUE).otherwise(b.NONE)

    pairs = list(zip(times, times[1:], strict=False))
    ordered = F.lit(bool(pairs))
    for x, y in pairs:
        ordered = ordered & F.coalesce(F.col(x) <= F.col(y), F.lit(False))
    axes = {"who": filled(who), "what": F.lit(b.TRUE), "when": F.when(ordered, b.TRUE).otherwise(b.NONE), "where": filled(where), "how": F.lit(b.TRUE)}
    d = matches.withColumns({"_p": F.lit(p), "_hit": F.lit(True)})
    return verdict_rows(d, technique, ref, p_value="_p", fired="_hit", axes=axes).drop("_p", "_hit")
