"""Language identification with error-correcting output codes over character n-grams.

Every language has a codeword of bits; for each bit a linear n-gram classifier is trained on the driver from a bounded
sample. A text's margins are sums of its words' margins, so words are scored once per slice of text and then added up.
Decoding picks the codeword with the least loss, bits weighted by how well they were learnt, and flags texts for which two
codewords are about as near.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, ship, slices, starts_of, utf8

BUCKETS = 8192
ORDERS = (1, 2, 3, 4)
#: Texts that training may use: per language, over all languages, and of each where there are very many (the rarest beyond
#: IN_ALL / FEW languages are not learnt). Bytes of all these texts.
PER_LANGUAGE, IN_ALL, FEW, ALL_BYTES = 400, 6000, 5, 64_000_000
STEPS = 120
#: Decoding is ambiguous if the second codeword's loss is within this share of the first's.
AMBIGUOUS = 0.15

ASCII_LETTER = re.compile(rb"[A-Za-z]")


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code for up to 5 languages, else the best of many random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols).T
    rng = np.random.default_rng(seed)
    width, best = int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice((-1, 1), size=(n, width))
        gram = code @ code.T
        worst = (gram - 2 * width * np.eye(n, dtype=int)).max()
        useful = np.abs(code.sum(axis=0)) < n
        if useful.all() and (best is None or worst < best[0]):
            best = worst, code
    return best[1] if best else rng.choice((-1, 1), size=(n, width))


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8")))


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word (bytes, with a mark before and after), and n-grams per word."""
    padded = [b"\x02" + w + b"\x03" for w in words]
    length = np.array([len(w) for w in padded], np.int64)
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - np.arange(len(raw))  # bytes to the word's end
    buckets, owner = [], []
    word = np.repeat(np.arange(len(words)), length)
    code = np.zeros(len(raw), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            shifted = np.zeros(len(raw), np.uint32)
            shifted[: len(raw) - n + 1] = raw[n - 1 :]
            code = code * np.uint32(257) + shifted + np.uint32(1)
            if n in ORDERS:
                ok = np.flatnonzero(left >= n)
                h = (code[ok] + np.uint32(n)) * np.uint32(2654435761)
                buckets.append((h >> np.uint32(32 - 13)).astype(np.int64))
                owner.append(word[ok])
    b, o = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return b[order], np.bincount(o, minlength=len(words))


def text_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each token's word, and where each text starts."""
    number: dict[bytes, int] = {}
    index: list[int] = []
    lengths = []
    for x in texts:
        ws = x.lower().split()
        lengths.append(len(ws))
        index += [number.setdefault(w, len(number)) for w in ws]
    return list(number), np.array(index, np.int64), starts_of(np.array(lengths, np.int64))


def train(texts: list[bytes], langs: list[str]) -> dict:
    """The model: languages, codewords, weights of n-grams and bits."""
    names = sorted(set(langs))
    code = codewords(len(names))
    words, index, starts = text_words(texts)
    grams, count = word_grams(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
    gram_start = starts_of(count)
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for d in range(len(texts)):
        w, tf = np.unique(index[starts[d] : starts[d + 1]], return_counts=True)
        for i, t in zip(w, tf, strict=True):
            np.add.at(x[d], grams[gram_start[i] : gram_start[i + 1]], t)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32)
    x *= scale
    target = code[[names.index(y) for y in langs]].astype(np.float32)
    w = np.zeros((BUCKETS, code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = x @ w + bias
        g = -target / (1 + np.exp(np.clip(target * z, -30, 30))) / len(texts)
        grad = x.T @ g + 1e-5 * w
        bias -= 0.5 * g.sum(axis=0)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w + bias) * target > 0).mean(axis=0)
    return {"names": names, "code": code.astype(np.float32), "w": w * scale[:, None], "bias": bias, "trust": np.maximum(right - 0.5, 0.01).astype(np.float32)}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest codeword, its share of belief, and whether another is about as near."""
    loss = np.logaddexp(0, -margins[:, None, :] * model["code"][None, :, :])
    d = (loss * model["trust"]).sum(axis=2) / model["trust"].sum()
    first = d.argmin(axis=1)
    low = d[np.arange(len(d)), first]
    belief = np.exp(-(d - low[:, None]) * margins.shape[1])
    score = 1 / belief.sum(axis=1)
    if d.shape[1] == 1:
        return first, score, np.zeros(len(d), bool)
    second = np.partition(d, 1, axis=1)[:, 1]
    return first, score, second - low < AMBIGUOUS * np.maximum(second, 1e-9)


def predict_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            for a, b in slices(texts, 8_000_000):
                words, index, starts = text_words(texts[a:b])
                n = b - a
                lang, score, unsure = ["und"] * n, np.zeros(n), np.ones(n, bool)
                if words and model["names"]:
                    grams, count = word_grams(words)
                    at = np.cumsum(count) - count
                    part = np.add.reduceat(model["w"][grams], at, axis=0)
                    full = np.flatnonzero(np.diff(starts) > 0)
                    total = np.add.reduceat(part[index], starts[:-1][full], axis=0)
                    size = np.add.reduceat(count[index], starts[:-1][full])
                    first, s, amb = decode(total / size[:, None] + model["bias"], model)
                    for i, k, p, u in zip(full, first, s, amb, strict=True):
                        if has_letter(texts[a + i]):
                            lang[i], score[i], unsure[i] = model["names"][k], p, u
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(lang), pa.array(score), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify_languages(documents: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    The model learns from text and lang of rows where held_out is false and lang is not null: at most per_language texts of
    each language, in_all and ALL_BYTES together, those with the smallest hashes. Where that leaves fewer than FEW texts a
    language, FEW of each of the in_all / FEW most frequent languages. lang is used for nothing else. Texts that are null,
    empty or without a letter are `und` with score 0 and ambiguous; so is every text if there is nothing to learn from. Rows
    are judged one by one; an empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("lang").alias("lang"))
    usable = docs.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    point = F.xxhash64("doc_id", "text", F.lit(7))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(point).alias("low")).orderBy(F.desc("n"), "lang").limit(max(1, in_all // FEW)).collect()
    each = max(FEW, min(per_language, in_all // max(1, len(sizes))))
    texts, langs, held = [], [], 0
    if sizes:
        # thinned first, so that few rows move, but never to nothing; the rank then bounds them, also where rows repeat
        rate = spark.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["n"]), r["low"]) for r in sizes], f"lang {docs.schema['lang'].dataType.simpleString()}, rate double, low long")
        some = usable.join(F.broadcast(rate), "lang").where((F.pmod(point, F.lit(1_000_000)) / 1e6 < F.col("rate")) | (point == F.col("low")))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(point, "text"))
        some = some.withColumn("rank", rank).where(F.col("rank") <= each).select("rank", "lang", "text")
        for r in some.repartition(1).sortWithinPartitions("rank", "lang").toLocalIterator():
            text = r["text"].encode()
            held += len(text)
            if held > ALL_BYTES:
                break
            texts.append(text)
            langs.append(r["lang"])
    shared = spark.sparkContext.broadcast(train(texts, langs) if texts else {"names": []})
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(predict_rows(shared), f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean")
