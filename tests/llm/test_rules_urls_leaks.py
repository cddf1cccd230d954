import collections
import math
import random
import re
from datetime import datetime

import numpy as np
import pytest

from tracewarden.llm import decontamination as dc
from tracewarden.llm.decontamination import find_leaks
from tracewarden.llm.quality_rules import clean_lines
from tracewarden.llm.url_filters import filter_urls


def base_counts(text):
    x = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", x)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in x.split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_line_rules_match_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n\t ", "x\x0by\x0cz", "é😀 " * 30, "same line.\n" * 5]
    for _ in range(60):
        w = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 60))]
        texts.append("\n".join(" ".join(w[i : i + 9]) + rnd.choice([".", "", " |", "#"]) for i in range(0, len(w), 9)) + (" " + " ".join(w[:12]) if rnd.random() < 0.5 else ""))
    d = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)], "doc_id long, text string, share string, n_words int")
    for r in clean_lines(d).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_line_rules_keep_prose_and_reject_what_loses_its_lines(spark):
    prose = "This is a line of plain prose that ends as lines should.\n" + "\n".join(f"Another sentence, number {i}, says something else." for i in range(4))
    junk = prose.split("\n")[0] + "\n" + "\n".join(f"home | about {i} | contact | imprint | more | next" for i in range(6))
    got = {r["doc_id"]: r for r in clean_lines(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned_text"] == prose
    assert not got[2]["kept"] and got[2]["cleaned_text"] == prose.split("\n")[0]


def test_line_rules_run_without_python_or_shuffle(spark):
    plan = clean_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


LIST = [
    ("a", "domain", "Bad.com", "block", "add", "2024-01-10"),
    ("a", "domain", "bad.com", "block", "remove", "2024-02-01"),
    ("a", "host", "ok.bad.com", "allow", "add", "2024-01-01"),
    ("b", "prefix", "site.org/x/y", "block", "add", "2024-01-01"),
    ("b", "url", "site.org/x/y/z?q=1", "allow", "add", "2024-01-15"),
    ("b", "domain", "same.day", "block", "add", "2024-01-05"),
    ("b", "domain", "same.day", "block", "remove", "2024-01-05"),
    ("b", "nonsense", "site.org", "block", "add", "2024-01-01"),
    (None, "domain", "site.org", "block", "add", "2024-01-01"),
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_entries_hold_between_their_dates(spark, monkeypatch, limit):
    monkeypatch.setattr("tracewarden.llm.url_filters.BROADCAST_BYTES", limit)
    cases = [
        ("http://www.BAD.com/", "2024-01-10", "block"),
        ("http://www.bad.com/", "2024-01-09", "none"),
        ("http://bad.com:8080/p", "2024-01-31", "block"),
        ("http://user@bad.com./p", "2024-02-01", "none"),
        ("https://ok.bad.com/a", "2024-01-20", "allow"),
        ("https://notbad.com/", "2024-01-20", "none"),
        ("https://site.org/x/y", "2024-01-20", "block"),
        ("https://site.org/x/yy", "2024-01-20", "none"),
        ("https://site.org/x//y/z/?q=1#top", "2024-01-20", "allow"),
        ("https://site.org/x/y/z?q=1", "2024-01-14", "block"),
        ("https://same.day/", "2024-01-06", "block"),
        ("relative/path", "2024-01-20", "none"),
        ("", "2024-01-20", "none"),
        (None, "2024-01-20", "none"),
        ("http://bad.com/", None, "none"),
    ]
    cases += cases[:2]
    d = spark.createDataFrame([(i, u, t and datetime.fromisoformat(t), "c", "k") for i, (u, t, _) in enumerate(cases)], "page_id long, url string, fetched_at timestamp, kind string, pattern string")
    e = spark.createDataFrame(LIST, "list_name string, kind string, pattern string, action string, event string, listed_at string")
    got = {r["page_id"]: r for r in filter_urls(d, e).collect()}
    assert [got[i]["decision"] for i in range(len(cases))] == [c[2] for c in cases]
    assert all(r["kept"] == (r["decision"] != "block") for r in got.values())
    assert filter_urls(d.limit(0), e).collect() == []
    assert {r["decision"] for r in filter_urls(d, e.limit(0)).collect()} == {"none"}


def items():
    rnd = random.Random(8)
    return [(i, " ".join(f"q{rnd.randrange(500)}" for _ in range(rnd.randrange(15, 40))) + ". " + " ".join(f"a{rnd.randrange(500)}" for _ in range(8)) + ".") for i in range(40)]


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    rnd = random.Random(9)
    bench = items()
    docs, want = [], set()
    for i in range(60):
        w = [rnd.choice(["the", "of", f"q{rnd.randrange(500)}", f"z{rnd.randrange(900)}"]) for _ in range(rnd.randrange(5, 400))]
        if i % 3 == 0:
            k = rnd.randrange(40)
            text = bench[k][1].upper().replace(" ", " | ", 2) if i % 2 else bench[k][1]
            w[rnd.randrange(len(w)) : 0] = [text]
            want.add((i, k))
        if i % 3 == 1:  # half of an item is no leak
            part = bench[i % 40][1].split()
            w += part[: len(part) // 2]
        docs.append((i, " ".join(w), "item", 3))
    docs += [(100, None, "", 0), (101, "", "", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int")
    b = spark.createDataFrame(bench + [(90, None), (91, "  ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(d, b).collect()}
    assert got == want


def test_slices_of_the_index_agree(spark, monkeypatch):
    bench = items()
    d = spark.createDataFrame([(i, t) for i, t in bench] + [(99, " ".join(t for _, t in bench))], "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")

    def found():
        return {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in find_leaks(d, b).collect()}

    one = found()
    monkeypatch.setattr(dc, "SLICE", 7)
    assert one == found()
    monkeypatch.setattr(dc, "GROUP_BYTES", 1000)  # several passes over the documents
    assert one == found()
    assert {x[:2] for x in one} >= {(i, i) for i in range(40)} | {(99, i) for i in range(40)}


def bm25(bench):
    """Impacts of every item's terms as the definition has them: {item: {word: share of the item's own score}}."""
    words = {i: [w for x in t.lower().split() if (w := x.strip(dc.MARKS))] for i, t in bench}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = collections.Counter(w for x in words.values() for w in set(x))
    out = {}
    for i, x in words.items():
        part = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (dc.K1 + 1) / (c + dc.K1 * (1 - dc.B + dc.B * len(x) / mean)) for w, c in collections.Counter(x).items()}
        out[i] = {w: v / sum(part.values()) for w, v in part.items()}
    return out


@pytest.mark.parametrize("block, slice_", [(4, 512), (1, 9), (64, 512)])
def test_retrieval_equals_exhaustive_bm25(spark, monkeypatch, tmp_path, block, slice_):
    monkeypatch.setattr(dc, "BLOCK", block)
    rnd = random.Random(3)
    bench = [(i, " ".join(rnd.choice("the of and to".split()) if rnd.random() < 0.3 else f"q{rnd.randrange(80)}" for _ in range(rnd.randrange(8, 30)))) for i in range(50)]
    texts = []
    for i in range(150):
        part = bench[rnd.randrange(50)][1].split()
        texts.append(" ".join(part[: rnd.randrange(len(part) + 1)] + [f"q{rnd.randrange(80)}" for _ in range(rnd.randrange(0, 12))]))
    rows = dc.weighted(spark.createDataFrame(bench, "item_id long, text string"), f"file://{tmp_path}").collect()
    want = bm25(bench)
    for s in range(0, len(rows), slice_):
        part = rows[s : s + slice_]
        impacts = [(np.array([x["term"] for x in r["impacts"]], np.int64).view(np.uint64), np.array([x["impact"] for x in r["impacts"]])) for r in part]
        index = dc.build_index([r["item_id"] for r in part], [r["text"].encode() for r in part], impacts, max(r["longest"] for r in part))
        table = dc.PlainTable()
        h = [dc.plain_hashes(t.encode().split(), table) for t in texts]
        got = {(d, index["ids"][i]): x for d, _, i, x in dc.retrieve(np.concatenate(h), np.array([len(x) for x in h]), index)}
        seen = 0
        for d, t in enumerate(texts):  # shorter than a passage, each text is one
            own = set(t.split())
            for r in part:
                x = sum(v for w, v in want[r["item_id"]].items() if w in own)
                if x >= dc.THRESHOLD + 1e-9:
                    assert abs(got[d, r["item_id"]] - x) < 1e-9
                    seen += 1
                elif x < dc.THRESHOLD - 1e-9:
                    assert (d, r["item_id"]) not in got
        assert seen


def test_repeated_rows_and_a_very_long_text(spark):
    bench = items()[:5]
    long = " ".join(f"z{i % 911}" for i in range(60_000))
    docs = [(1, f"{long} {bench[2][1]} {long}"), (2, bench[0][1]), (2, bench[0][1]), (3, long)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*bench, bench[0]], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 2), (2, 0), (2, 0), (2, 0), (2, 0)]


@pytest.mark.parametrize("n", [513, 1100, 4000])
def test_long_items_are_found_whole(spark, n):
    rnd = random.Random(n)

    def prose(k, mark):
        return " ".join(f"{mark}{rnd.randrange(5000)}" for _ in range(k))

    long = prose(n, "q") + ". " + prose(10, "a") + "."
    half = " ".join(long.split()[: n // 2])
    docs = [(1, f"{prose(700, 'z')} {long} {prose(900, 'z')}"), (2, f"{prose(700, 'z')} {half} {prose(3 * n, 'z')}"), (3, prose(6000, "z")), (4, long)]
    bench = items() + [(70, long)]
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 70), (4, 70)}


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, b).collect() == []
    assert find_leaks(d.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
