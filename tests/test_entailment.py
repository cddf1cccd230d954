import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import entailment as e
from tracewarden.operators import rules


def closed(facts, implications):
    out = list(facts)
    while True:
        new = [j for i, j in implications if out[i] is True and out[j] is None]
        if not new:
            return out
        out[new[0]] = True


@pytest.mark.parametrize("seed", range(4))
def test_consequences_and_contradictions(spark, seed):
    rnd = random.Random(seed)
    implications = [(i, j) for i, j in itertools.permutations(range(5), 2) if rnd.random() < 0.3]
    exclusions = [(0, 4), (1, 3)]
    rows = [(k, [rnd.choice([True, False, None, None]) for _ in range(5)]) for k in range(40)]
    d = spark.createDataFrame(rows, "id int, facts array<boolean>")
    done = e.derive(d, "facts", implications)
    want = {k: closed(f, implications) for k, f in rows}
    assert {r["id"]: r["facts"] for r in done.collect()} == want
    bad = {(k, "implication", a, b) for k, f in want.items() for a, b in implications if f[a] is True and f[b] is False}
    bad |= {(k, "exclusion", a, b) for k, f in want.items() for a, b in exclusions if f[a] is True and f[b] is True}
    assert {tuple(r) for r in e.contradictions(done, "facts", implications, exclusions, ["id"]).collect()} == bad
    assert e.contradictions(d, "facts", [], [], ["id"]).collect() == []


RAW = [
    {"id": "a", "detection": {"s": {"x": "1", "y": "2"}, "condition": "s"}},
    {"id": "b", "detection": {"s": {"x": "1"}, "f": {"y": "2"}, "condition": "s and not f"}},
    {"id": "c", "detection": {"words": ["ab", "zz"], "condition": "words"}},
    {"id": "d", "detection": {"s1": {"x": "9"}, "s2": {"y": "9"}, "condition": "all of s*"}},
]


def test_entailed_rules_equal_the_plain_evaluator(spark):
    compiled = [rules.compile_rule(r) for r in RAW]
    events = [{"x": x, "y": y} for x in ("1", "2", "9", "ab") for y in ("2", "9", "", None)]
    d = spark.createDataFrame([(i, ev) for i, ev in enumerate(events)], "id int, fields map<string,string>")
    got = {r["rule_id"]: tuple(r)[1:] for r in e.entail(d, compiled, *rules.map_access()).collect()}
    for r in compiled:
        hits = sum(rules.matches(r, ev) for ev in events)
        assert got[r.rule_id][0] == hits and got[r.rule_id][1] + got[r.rule_id][2] == len(events)
    assert got["b"][2] == 0 and got["c"][2] > 0  # a negated rule is never passed over
    assert e.entail(d, [], *rules.map_access()).collect() == []
    row = e.attest(d, compiled, ["id"], *rules.map_access()).first()
    assert row["faithful"] and row["checked"] == len(events) * len(compiled)


def test_disagreements_name_the_side(spark):
    a = spark.createDataFrame([(1, "r"), (2, "r")], "id int, rule_id string")
    got = e.disagreements(a, a.where("id = 2").union(a.select(F.lit(3), F.lit("r")).limit(1)), ["id", "rule_id"])
    assert sorted(map(tuple, got.collect())) == [(1, "r", "first"), (3, "r", "second")]


def test_vocabularies_are_guarded(spark):
    rule = rules.compile_rule(RAW[0])
    d = spark.createDataFrame([(1, "1", "2"), (2, "1", "3")], "id int, p string, q string")
    access = rules.column_access({"p": "p", "q": "q"})
    with pytest.raises(e.MixedVocabularies):
        e.guarded_fire(d, [rule], ["id"], *access, e.Vocabulary("wide"), e.Vocabulary())
    with pytest.raises(e.MixedVocabularies):
        e.guarded_fire(d, [rule], ["id"], *access, e.Vocabulary("wide"), e.Vocabulary(), {"x": "p"})
    out = e.guarded_fire(d, [rule], ["id"], *access, e.Vocabulary("wide"), e.Vocabulary(), {"x": "p", "y": "q"})
    assert [tuple(r) for r in out.collect()] == [(1, "a")]
    done = e.rewrite(rule, {"x": "p"})
    assert done.renamed == (("x", "p"),) and done.missing == ("y",) and not done.complete
    e.require_same(e.Vocabulary("wide", "1"), e.Vocabulary("wide", "2"))
