import random

import numpy as np
import pytest

from tracewarden.llm import substring_dedup as sd
from tracewarden.llm.substring_dedup import remove_repeats


def brute(rows, window=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for j in range(len(w) - window + 1):
                g = tuple(w[j : j + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string"):
    out = remove_repeats(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out), key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(10, 40))] for _ in range(8)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rnd.randrange(1, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, len(p))
            text += p[a : a + rnd.randrange(5, 40)] + [rnd.choice(vocab) for _ in range(rnd.randrange(0, 9))]
        rows.append((rnd.randrange(1000) * 100 + i, " ".join(text)))
    assert run(spark, rows) == brute(rows)


def test_shared_windows_across_different_factors(spark):
    # the repeated window stands in two documents whose neighbouring words all differ
    mid = " ".join(f"m{i}" for i in range(13))
    rows = [(9, "a b c " + mid + " d e f"), (4, "g " + mid + " h"), (6, mid)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    text = " ".join(map(str, range(20)))
    rows = [(1, None), (2, ""), (3, "too short"), (None, text), (7, text), (7, text), (8, text + "\n" + text), (9, "É é " + text)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_case_matters_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(15))
    rows = [(1, text, 1, "a", 3), (2, text.upper(), 2, "b", 4), (3, text, 3, "c", 5)]
    got = run(spark, rows, "doc_id long, text string, t long, spans string, s int")
    assert [(r[0], r[2]) for r in got] == [(1, 0), (2, 0), (3, 15)]


def test_very_long_text_of_one_word(spark):
    rows = [(1, "la " * 20_000), (2, "la " * 30)]
    assert run(spark, rows) == brute(rows)


def greedy(phrases, rank):
    """Factors by the definition: from each window, the longest run of windows that an earlier document's phrase has."""
    out = []
    for p, w in enumerate(phrases):
        i = 0
        while i < len(w):
            best = 0
            for q, v in enumerate(phrases):
                if rank[q] < rank[p]:
                    for j in range(len(v)):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        best = max(best, n)
            if best:
                out.append((p, i, best))
            i += max(best, 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_parsing_finds_the_longest_factors(seed):
    rnd = random.Random(seed)
    phrases = [[rnd.randrange(4) for _ in range(rnd.randrange(0, 9))] for _ in range(60)]
    rank = sorted(rnd.randrange(20) for _ in phrases)
    got = sd.parse(np.array([len(p) for p in phrases]), np.array([x for p in phrases for x in p], np.int64), np.array(rank))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == greedy(phrases, rank)


def test_factors_end_where_the_reference_does_and_boundaries_are_checked():
    a, b = [1, 2, 3, 4], [3, 4, 5, 6]
    got = sd.parse(np.array([4, 4, 6]), np.array([*a, *b, 1, 2, 3, 4, 5, 9]), np.array([0, 1, 2]))
    # 1 2 3 4 is the longest from the first window on, 5 lies across its end, 9 is new
    assert [x.tolist() for x in got] == [[1, 2, 2], [0, 0, 4], [2, 4, 1]]


@pytest.mark.parametrize("name, value", [("ANCHOR_PHRASES", 1), ("HOT_ROWS", 3), ("BLOCK_PHRASES", 7)])
def test_crowded_anchors_hot_phrases_and_many_blocks(spark, monkeypatch, name, value):
    monkeypatch.setattr(sd, name, value)
    rnd = random.Random(value)
    common = [f"c{i}" for i in range(5)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        text = [f"x{rnd.randrange(9)}" for _ in range(rnd.randrange(8, 20))] + common + [f"y{rnd.randrange(3)}" for _ in range(12)]
        rows.append((i * 3 % 61, " ".join(text + (passage if i % 2 else []))))
    assert run(spark, rows) == brute(rows)


def test_ids_that_are_no_numbers(spark):
    text = " ".join(f"w{i}" for i in range(15))
    rows = [("b", text), ("a", text + " more"), ("c", "z " + text)]
    assert run(spark, rows, "doc_id string, text string") == brute(rows)
