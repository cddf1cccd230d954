import copy
import random
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import language_id as li
from tracewarden.llm import quality_classifier as qc
from tracewarden.llm import toxicity as tx
from tracewarden.llm.common import id_remainder, label_sample, mix

WORDS = {"en": "the of and house river walking stone green window", "de": "der und das Haus Fluss gehen Stein grün Fenster", "fr": "le des et maison rivière marcher pierre vert fenêtre"}


def sentences(lang, n, rnd, extra=()):
    w = WORDS[lang].split()
    return " ".join(rnd.choice(w) for _ in range(n)) + (" " + " ".join(extra) if extra else "") + "."


def rows(n=240, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        toxic = rnd.random() < 0.3
        bad = rnd.random() < 0.3
        text = "### $$$ " * rnd.randrange(10, 20) if bad else "\n".join(sentences(lang, 12, rnd) for _ in range(4))
        text += sentences(lang, 10, rnd, ["dolt", "nitwit", "dolt"] if toxic else [])
        docs.append((i, text, lang))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = rows()
    extra = [(1000, None, "en"), (1001, "", None), (1002, "123 456 ¿?", "de"), (1003, "the " * 20_000, "en")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language_id_held_out(spark, data):
    docs, _ = data
    got = {r["doc_id"]: r for r in li.identify_languages(docs, id_remainder("doc_id", 4) == 2).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(want)
    held = [i for i, r in got.items() if r["held_out"] and i < 1000]
    assert sum(got[i]["lang_pred"] == want[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3


def test_language_id_without_training(spark):
    d = spark.createDataFrame([(1, "text", None), (1, "text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in li.identify_languages(d, F.lit(False)).collect()] == ["und", "und"]
    assert li.identify_languages(d.limit(0), F.lit(False)).collect() == []


def test_one_language_only(spark):
    d = spark.createDataFrame([(i, "some words here", "en") for i in range(5)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.identify_languages(d, F.lit(False)).collect()} == {"en"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = li.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 1
        assert n <= 3 or min(apart) >= 3


def test_toxicity_held_out(spark, data):
    docs, labels = data
    got = {r["doc_id"]: r for r in tx.score_toxicity(docs, labels).collect()}
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in want if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == want[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"]
    assert not {r["held_out"] for r in got.values()} - {True, False}


def test_quality_held_out_and_compiled_rules(spark, data):
    docs, labels = data
    got = {r["doc_id"]: r for r in qc.classify_quality(docs, labels).collect()}
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in want if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == want[i] for i in held) >= 0.95 * len(held)
    model = qc.fit_quality(docs, labels)
    assert model["rules"]
    stats, p = qc.with_statistics(docs)
    stats = stats.select("doc_id", *[f"{p}{f}" for f in qc.FEATURES]).toPandas()
    x = stats[[f"{p}{f}" for f in qc.FEATURES]].to_numpy(float)
    z = model["bias"] + sum(w * qc._fires(x, r) for r, w in model["rules"])
    score = dict(zip(stats["doc_id"], 1 / (1 + np.exp(-z)), strict=True))
    for r in qc.score_quality(docs, model).collect():
        assert abs(score[r["doc_id"]] - r["score"]) < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)]])
def test_labels_of_one_class_or_none(spark, labels):
    d = spark.createDataFrame([(1, "a", 3), (2, None, 4), (2, None, 4)], "doc_id long, text string, n int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for out in (qc.classify_quality(d, lab, held_out=9), tx.score_toxicity(d, lab, held_out=9)):
        got = out.collect()
        assert len(got) == 3 and len({r["score"] for r in got}) == 1
    assert qc.classify_quality(d.limit(0), lab).collect() == [] and tx.score_toxicity(d.limit(0), lab).collect() == []


def test_sample_is_bounded_and_ignores_held_out(spark):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("q")).union(spark.createDataFrame([(1, None), (None, 1), (10, 1)], "doc_id long, q int"))
    got = label_sample(d, lab, "q", id_remainder("doc_id", 4) != 2, 100).collect()
    assert 160 < len(got) <= 200 and len({r["text"] for r in got}) == len(got)
    assert all(zlib.crc32(r["text"][1:].encode()) % 4 != 2 for r in got)


def test_few_labels_give_a_model_without_rules(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "doc_id long, quality int, toxic int")
    got = qc.classify_quality(d, lab).collect()
    assert len(got) == 12 and len({r["score"] for r in got}) == 1


def test_quality_does_not_depend_on_the_order_of_rows(spark, data):
    docs, labels = data
    one, two = qc.fit_quality(docs, labels), qc.fit_quality(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3))
    assert one == two


def test_clashing_columns(spark, data):
    docs, labels = data
    names = ["_t", "_w", "_upper", "Y", "point", "held_out", "rank", "n", "score", "guess", "rate"]
    extra = docs.select("*", *[F.lit(5).alias(n) for n in names])
    assert qc.keep_good(extra, qc.fit_quality(extra, labels)).columns == extra.columns
    for f in (lambda d: qc.classify_quality(d, labels), lambda d: tx.score_toxicity(d, labels), lambda d: li.identify_languages(d, id_remainder("doc_id", 4) == 2)):
        assert sorted(map(str, f(extra).collect())) == sorted(map(str, f(docs).collect()))


def test_very_many_languages(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 3}", f"l{i % 100:03}") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = li.identify_languages(d, F.lit(False), in_all=60).collect()  # 12 languages of 5 texts
    assert len({r["lang_pred"] for r in got} - {"und"}) > 5


def test_samples_are_bounded_where_rows_repeat(spark):
    d = spark.createDataFrame([(1, "one text")] * 500 + [(None, "null id")] * 500, "doc_id long, text string").withColumn("lang", F.lit("xx"))
    lab = spark.createDataFrame([(1, 1)], "doc_id long, q int")
    assert label_sample(d, lab, "q", F.lit(True), 40).count() == 40
    assert {r["lang_pred"] for r in li.identify_languages(d, F.lit(False), per_language=10).collect()} == {"xx"}


def test_languages_are_told_apart_without_names():
    rnd = random.Random(2)
    texts = [sentences(lang, 30, rnd).encode() for lang in WORDS for _ in range(40)]
    words, groups = tx.learn_groups(texts)
    guess = tx.encode(texts, tx.PartTable(words), groups)[3].reshape(3, 40)
    assert len(groups) == 3 and all(len(set(g)) == 1 for g in guess.tolist())
    assert tx.learn_groups([b"", b" "])[1].shape[0] == 0


def by_hand(text, model):
    """The network's output for one text as its definition has it, word by word."""
    vectors = []
    for w in text.encode().lower().split():
        parts = np.frombuffer(tx.PartTable()[w], np.uint32)[: tx.PARTS]
        vectors.append(sum(model["e"][int(p)] for p in parts))
    pooled = []
    for i, width in enumerate(tx.WIDTHS):
        best = np.zeros(tx.FILTERS)
        for at in range(len(vectors) + 1):  # the padding after a text counts as one more place
            z = model["b"][i] + sum(vectors[at + o] @ model["w"][i][o] for o in range(width) if at + o < len(vectors))
            best = np.maximum(best, z)
        pooled.append(best)
    return float(np.concatenate(pooled) @ model["v"] + model["c"])


def test_network_equals_its_definition(data):
    docs, labels = data
    model = tx.fit_toxicity(docs, labels)
    texts = ["the river dolt nitwit and walking", "one", "a b c d e f g", ""]
    z, _ = tx.logits([t.encode() for t in texts], model, tx.PartTable(model["words"]))
    assert np.allclose(z, [by_hand(t, model) for t in texts], atol=1e-3)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(tx, "PART_ROWS", 1500, raising=False)
    n = 7000
    words = [chr(0x4E00 + i) for i in range(n)]
    d = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    model = tx.fit_toxicity(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    before = (np.random.default_rng(2).standard_normal((tx.BUCKETS, tx.DIM)) * 0.1).astype(np.float32)
    own = [int(np.frombuffer(tx.PartTable()[w.encode()], np.uint32)[0]) for w in words]
    moved = (model["e"][own] != before[own]).any(axis=1)
    assert moved.sum() > 0.78 * n  # a fifth sets thresholds


def test_toxicity_learns_from_long_texts(spark):
    d = spark.createDataFrame([(i, "dolt river " * 100_000 if i < 2 else f"the river {i}") for i in range(8)], "doc_id long, text string")
    model = tx.fit_toxicity(d, d.select("doc_id", (F.col("doc_id") < 2).cast("int").alias("toxic")))
    z, _ = tx.logits([b"dolt river", b"the river"], model, tx.PartTable(model["words"]))
    assert z[0] > z[1]


def test_toxicity_does_not_depend_on_the_order_of_rows(spark, data, monkeypatch):
    monkeypatch.setattr(tx, "PART_ROWS", 50)
    docs, labels = data
    one, two = tx.fit_toxicity(docs, labels), tx.fit_toxicity(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3))
    assert all((one[k] == two[k]).all() for k in ("e", "v", "groups")) and one["words"] == two["words"]
    assert np.allclose(one["edge"], two["edge"], atol=1e-4)


def test_every_part_is_trained_on_in_every_epoch():
    for parts in (1, 2, 7, 100):
        every = [list(r) for r in tx.rounds(parts)]
        assert sorted(sum(every, [])) == sorted(list(range(parts)) * tx.EPOCHS)
        assert len(every[0]) == 1 and max(map(len, every)) <= tx.WIDE


def test_thresholds_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), round(rnd.gauss(3 * y, 2), rnd.choice([0, 1, 6])), y) for y in (0, 0, 0, 1) for _ in range(150)]
    rows.append((3, 2.5, 1))
    got = tx.best_edges(spark.createDataFrame(rows, "guess int, z double, y int").repartition(5))
    assert sorted(got) == [-1, 0, 1, 2, 3] and got[3] == (2.5, 1, 0)
    for k in (-1, 0, 1, 2):
        own = [(z, y) for g, z, y in rows if k in (-1, g)]
        toxic, clean = sum(y for _, y in own), sum(1 - y for _, y in own)
        z = sorted({z for z, _ in own})
        best = None
        for low, high in zip(z, z[1:], strict=False):
            good = 0.25 * sum(y for x, y in own if x >= high) / toxic + 0.75 * sum(1 - y for x, y in own if x <= low) / clean
            key = (round(good, 9), high - low, -low)
            if best is None or key > best[0]:
                best = key, (low + high) / 2
        assert got[k][1:] == (toxic, clean) and got[k][0] == pytest.approx(best[1])


def test_groups_of_a_table_equal_those_of_its_texts(spark, data):
    rows = data[0].select("text")
    words, groups = tx.groups_of(rows)
    want = tx.learn_groups([(r["text"] or "").encode() for r in rows.collect()])
    assert words == want[0] and np.allclose(groups, want[1])


def test_pieces_of_a_text_give_what_the_whole_gives(monkeypatch):
    rnd = random.Random(5)
    texts = [sentences("en", n, rnd).encode() for n in (0, 1, 30, 3, 200)]
    model = {**tx.untrained(), "groups": None}
    parts, flat, at, _ = tx.encode(texts, tx.PartTable())
    want, where = tx.peaks(tx.embed(parts, model["e"]), flat, at, model, places=True)
    monkeypatch.setattr(tx, "BLOCK", 7)
    monkeypatch.setattr(tx, "SPLIT_BYTES", 10)
    again = tx.encode(texts, tx.PartTable())
    assert (again[0] == parts).all() and (again[1] == flat).all()
    got, place = tx.peaks(tx.embed(parts, model["e"]), flat, at, model, places=True)
    assert np.allclose(got, want, atol=1e-5) and (place == where).mean() > 0.99
    coded = tx.gather([tx.code(x, tx.PartTable()) for x in texts])
    assert (coded[0][coded[1]] == parts[flat]).all() and (coded[2] == at).all()


def test_copies_are_averaged_over_those_that_moved_a_row():
    shared = SimpleNamespace(value=tx.untrained())
    before = shared.value["e"].copy()
    given = [[("dolt river", 1), ("river", 0)], [("nitwit river", 1), ("stone river", 0)]]
    models, sent = [], {}
    for part, rows in enumerate(given):
        coded = [(tx.code(x.encode(), tx.PartTable()), y) for x, y in rows]
        models.append(copy.deepcopy(shared.value))
        tx.train(iter(coded), models[-1], {0: 1.0, 1: 1.0})
        batch = pa.RecordBatch.from_pydict({"part": pa.array([part] * 2, pa.int32()), "words": [c[0] for c, _ in coded], "flat": [c[1] for c, _ in coded], "y": [y for _, y in coded]})
        for out in tx.train_part(shared, {0: 1.0, 1: 1.0})(iter([batch])):
            sent.setdefault(out.column(0)[0].as_py(), []).append(out)
    assert (shared.value["e"] == before).all()
    model = copy.deepcopy(shared.value)
    for batches in sent.values():
        for out in tx.average(iter(batches)):
            tx.take(model, out.column(0)[0].as_py(), out.column(1)[0].as_py())
    one, two = models[0]["e"], models[1]["e"]
    moved = [(m["e"] != before).any(axis=1) for m in models]
    assert moved[0].any() and (moved[0] != moved[1]).any() and (moved[0] & moved[1]).any()
    want = np.where((moved[0] & moved[1])[:, None], (one + two) / 2, np.where(moved[0][:, None], one, two))
    assert np.allclose(model["e"], want, atol=1e-6) and model["turn"] == 1
    assert np.allclose(model["v"], (models[0]["v"] + models[1]["v"]) / 2, atol=1e-6)


def parts_by_hand(word):
    """Bucket numbers of a word and of its beginnings as their definition has them, digit by digit."""

    def hashed(x, extra=0):
        number = (sum((b + 1) * tx.BASE**i for i, b in enumerate(x)) + extra) % 2**64
        return 1 + int(mix(np.array([number], np.uint64))[0]) % (tx.BUCKETS - 1)

    bare = word.lower().strip(tx._MARKS)
    text = bare.decode()
    return [hashed(bare, int(tx.WHOLE)), *(hashed(text[:n].encode()) if len(text) >= n else 0 for n in tx.BEGINNINGS)]


@pytest.mark.parametrize("at_once", [8, 100, 1 << 18])
def test_words_are_hashed_by_definition(monkeypatch, at_once):
    monkeypatch.setattr(tx, "SPLIT_BYTES", at_once)
    rnd = random.Random(6)
    alphabet = "abcXYZ äßé 中文 😀\t\n\v\f\r.,#'_~\x00\x1c\x85\u00a0\u2003"
    texts = ["", " ", "#" * 30, "(Dolt), dolt's DOLT--", "word", "a" * 300 + "," * 40 + "b", *("".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(60))]
    texts = [x.encode() for x in texts]
    parts, flat, at, _ = tx.encode(texts, tx.PartTable())
    assert not parts[0].any() and len(np.unique(parts[1:], axis=0)) == len({x.lower().strip(tx._MARKS) for t in texts for x in t.split()})
    for t, a, b in zip(texts, at, [*at[1:], len(flat)], strict=True):
        assert parts[flat[a:b]].tolist() == [parts_by_hand(w) for w in t.split()] + [[0] * tx.PARTS] * max(tx.WIDTHS)
    for coded, one in zip(tx.code_all(texts, tx.PartTable()), texts, strict=True):
        assert coded == tx.code(one, tx.PartTable())
    words = [b"dolt", "中文".encode(), b"word"]
    assert [np.frombuffer(tx.PartTable(words)[w], np.uint32)[-1] for w in (b"(Dolt)", "中文".encode(), b"word", b"other")] == [1, 2, 3, 0]


def test_new_words_cost_no_call_each():
    texts = [" ".join(f"w{i}x{j}" for j in range(100)).encode() for i in range(200)]
    table, calls = tx.PartTable([b"w1x1"]), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        tx.logits(texts, {**tx.untrained(), "groups": np.ones((1, 1))}, table)
    finally:
        sys.setprofile(None)
    assert calls < 5_000  # of 20,000 words


def test_very_many_words_give_what_few_give(monkeypatch):
    texts = [" ".join(f"w{i * j % 90}" for j in range(60)).encode() for i in range(1, 6)]
    model = {**tx.untrained(), "groups": None}
    parts, flat, at, _ = tx.encode(texts, tx.PartTable())
    want, where = tx.peaks(tx.embed(parts, model["e"]), flat, at, model, places=True)
    monkeypatch.setattr(tx, "BLOCK", 2)
    assert len(parts) > 32 * 2
    got, place = tx.peaks(tx.embed(parts, model["e"]), flat, at, model, places=True)
    assert np.allclose(got, want, atol=1e-5) and (place == where).mean() > 0.95
