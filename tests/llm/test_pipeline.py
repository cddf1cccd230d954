import math
import os
import random
import re
import shutil

import pytest
import test_near_dedup as near
from pyspark.sql import functions as F

import corpus_pipeline
from tracewarden.llm import quality_classifier as qc
from tracewarden.llm import quality_rules, queries


@pytest.fixture(scope="module")
def small(tmp_path_factory, sf):
    to = tmp_path_factory.mktemp("tables")
    for t in ("documents", "labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", to / f"{t}.parquet")
    return str(to)


def test_stages_keep_columns_and_shrink(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small).cache()
        assert out.columns == docs.columns and out.schema == docs.schema
        assert 0 < out.count() <= docs.count()
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert {r[0] for r in out.select("doc_id").collect()} <= ids
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    names = list(queries.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert os.path.exists(queries.tokenizer_file())


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def test_rows_that_repeat_an_id_are_judged_one_by_one(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    a, b, c, shared = words(1, 60), words(2, 60), words(3, 60), words(4, 20)
    texts = [(0, a), (1, b), (1, b), (1, b), (2, a), (2, c), (3, f"{words(5, 40)} {shared}"), (4, f"{words(6, 40)} {shared}"), (4, words(7, 60)), (5, f"{words(8, 20)} {item} {words(9, 20)}"), (5, words(10, 60)), (None, words(11, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], spark.read.parquet(f"{small}/documents.parquet").schema)
    stage = dict(corpus_pipeline.STAGES)

    def rows(d):
        return sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)

    one = stage["near_dedup"](spark, docs, small)
    want = [x for k, x in enumerate(texts) if k not in (2, 3, 4)]
    assert rows(one) == sorted(want, key=str)
    two = stage["substring_dedup"](spark, one, small)
    want[want.index(texts[7])] = (4, words(6, 40))
    assert rows(two) == sorted(want, key=str) and all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stage["decontamination"](spark, two, small)
    want.remove(texts[9])
    assert rows(three) == sorted(want, key=str)


def odd_rows(bench):
    """Rows with repeated ids, equal rows, nulls, copies and passages; each text but the copies is new."""
    base = {k: words(100 + k, 80) for k in range(12)}
    shared = words(5, 25)
    rows = [(k, t) for k, t in base.items()]
    rows += [(40 + k, t.replace(t.split()[40], f"edit{k}")) for k, t in base.items() if k < 4]  # near copies
    rows += [(60, f"{words(61, 30)} {shared}"), (61, f"{shared} {words(62, 30)}"), (62, f"{words(63, 9)} {shared} {words(64, 9)}"), (63, shared)]
    rows += [(70, words(71, 50)), (70, words(71, 50)), (70, words(72, 50)), (None, words(73, 50)), (None, words(73, 50)), (80, None), (81, ""), (82, " \n")]
    rows += [(90, f"{words(91, 40)} {bench[3]} {words(92, 40)}"), (90, words(93, 40)), (None, bench[4]), (95, " ".join(bench[5].split()[:6]))]
    return rows


CLASH = ("row_key", "kept_text", "empty", "_t", "_upper", "c0", "c1", "t", "n", "spans", "deal", "item_id", "label", "a.b")


def test_stages_equal_brute_force(spark, small):
    bench = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").collect()]
    rows = odd_rows(bench)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{small}/documents.parquet").schema)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    stage = dict(corpus_pipeline.STAGES)

    def same(out, want):
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
        assert sorted(got, key=str) == sorted(((i, t, len(t or "")) for i, t in want), key=str)

    one = [x for k, x in enumerate(rows) if x[0] is None or x not in rows[:k]]
    with_id = [x for x in one if x[0] is not None]
    keep = []
    for i, t in one:
        links = [j for j, u in with_id if (j, u) != (i, t) and (s := near.shingle_set(t)) and 100 * len(s & near.shingle_set(u)) >= 80 * len(s | near.shingle_set(u))]
        if i is None and any(u == t for _, u in with_id) or i is not None and any(j < i for j in links):
            continue
        keep.append((i, t))
    same(stage["near_dedup"](spark, docs, small), keep)

    seen = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - 12):
                g = tuple(w[j : j + 13])
                seen[g] = min(seen.get(g, i), i)
    cut = []
    for (i, t), (_, w) in zip(rows, split, strict=True):
        gone = {j + o for j in range(len(w) - 12) if i is not None and seen[tuple(w[j : j + 13])] < i for o in range(13)}
        if not gone:
            cut.append((i, t))
        elif len(gone) < len(w):
            cut.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    same(stage["substring_dedup"](spark, docs, small), cut)

    same(stage["decontamination"](spark, docs, small), [(i, t) for i, t in rows if not any(b in (t or "") for b in bench)])

    packed = stage["best_fit_packing"](spark, docs, small).collect()
    assert sorted((r["doc_id"] for r in packed), key=str) == sorted((i for i, _ in rows), key=str)
    assert all(len(r["ids"]) == r["length"] <= 2048 for r in packed)


def statistics(text):
    """The features by their definition."""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    solid, n, m = sum(map(len, w)), max(1, len(w)), max(1, len(lines))

    def share(chars):
        return sum(c in chars for c in text) / max(1, solid)

    return {
        "log_words": math.log1p(len(w)), "word_length": solid / n, "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "symbols": share("#*$%&|<>"), "digits": share("0123456789"),
        "marks": share(".,;:?"), "bars": share("|"), "bangs": share("!"), "distinct": len(set(w)) / n, "log_lines": math.log1p(len(lines)), "same_lines": 1 - len(set(lines)) / m,
        "ended_lines": sum(bool(re.search(quality_rules.TERMINAL, x)) for x in lines) / m, "words_per_line": len(w) / m,
    }


def test_quality_stage_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = qc.fit_quality(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert model["rules"]
    want = []
    for r in docs.collect():
        x = statistics(r["text"] or "")
        z = model["bias"] + sum(w for rule, w in model["rules"] if all((x[qc.FEATURES[f]] > c) == above for f, above, c in rule))
        if 1 / (1 + math.exp(-z)) >= qc.CUT:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, small).collect()) == sorted(want)


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).collect() == []
