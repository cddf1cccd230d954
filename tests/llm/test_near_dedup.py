import random

import numpy as np
import pytest

from tracewarden.llm import near_dedup as nd


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return sorted(((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def run(spark, rows, percent=85, schema="doc_id long, text string"):
    out = nd.near_duplicates(spark.createDataFrame(rows, schema), percent=percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str), out


def corpus(seed=1):
    rnd = random.Random(seed)
    rows = []
    for base in range(6):
        text = [f"w{rnd.randrange(4000)}" for _ in range(120)]
        for _ in range(14):
            copy = list(text)
            for _ in range(rnd.randrange(0, 5)):
                copy[rnd.randrange(120)] = f"x{rnd.randrange(9999)}"
            rows.append(" ".join(copy))
    rows += ["a b c", "A  b\tc", "a b", "", None, " \n\t", "one", "ONE", "é É", "É É"]
    rnd.shuffle(rows)
    return [(i + 10, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows)[0] == brute(rows, 85)


def test_blocks_split_and_still_find_all(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = corpus(2)
    assert run(spark, rows, 80)[0] == brute(rows, 80)


def test_empty_texts_are_linked_with_nothing(spark):
    got, rows = run(spark, [(1, ""), (2, None), (3, " "), (4, "")])
    assert got == [(i, 0, i) for i in (1, 2, 3, 4)]
    assert all(r["kept"] for r in rows)


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_repeated_rows_and_null_ids(spark):
    got, rows = run(spark, [(5, "p q r s t u"), (5, "p q r s t u"), (None, "p q r s t u"), (3, "z")])
    assert sorted(map(str, got)) == sorted(map(str, [(5, 2, 5), (5, 2, 5), (None, 2, 5), (3, 1, 3)]))


def test_clashing_columns_and_long_text(spark):
    text = " ".join(str(i % 977) for i in range(20_000))
    rows = [(1, text, 7, "x", 1.0), (2, text + " end", 8, "y", 2.0)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, c long, k string, n double"), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1}


def test_registers_and_estimate():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 50, 50))
    x, y = np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))
    r = nd.registers(np.concatenate((x, y)), np.array([len(x), len(y)]))
    est = nd.estimate(np.array([(r[0] == r[1]).sum()]), np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(est - 0.9) < 0.1
    assert nd.collision_table()[8][8] < 1e-3


@pytest.mark.parametrize("value, zeros", [(1 << 63, 0), (1, 63), ((1 << 40) + 5, 23)])
def test_leading_zeros(value, zeros):
    got = int(nd.compress(np.array([value], np.uint64))[0]) >> nd.MANTISSA
    assert got == min(zeros, 53) or value < 1 << 11
