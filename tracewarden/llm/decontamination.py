"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND.

The index holds the test items, neighbours in blocks of BLOCK. Collection statistics (items, document frequencies, mean
length) are those of the whole benchmark, computed before anything is cut into slices. For each term the index keeps its
postings (items in their order, with BM25 impacts divided by the score an item gives itself), the largest impact of all, and the
largest per block. A passage first adds up the overall maxima of its words, then the block maxima of its distinct terms, for
all passages of a slice of text at once in numpy. Where some block could reach the threshold, the passage's posting cursors
run: they are kept in the order of their items, the pivot is the first at which the maxima reach the threshold, a pivot whose
block can't reach it lets the cursors skip the block, and only pivots on which all earlier cursors stand are scored. Every
item at or above the threshold is retrieved. Overlap of question and answer is then verified in the document around the passage.

Documents are never moved: the index is broadcast and read by every task, in groups of slices of at most GROUP_BYTES together;
a benchmark beyond that costs more passes, not more memory. Passages are twice as long as the longest item of a class of
items; so that short items keep short passages, items of more than LONGEST words are in classes of their own, by doublings
of length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import discard, materialise, merged, ngram_hashes, pieces, scratch_dir, ship, slices, utf8, WordTable

#: BM25 parameters.
K1, B = 1.2, 0.75
BLOCK = 4
#: Items of one slice of the index, bytes of one broadcast, and the longest item in words that is indexed among the short.
SLICE, GROUP_BYTES, LONGEST = 512, 48_000_000, 512
#: Retrieval: share of an item's score for itself that a passage must reach.
THRESHOLD = 0.45
SHINGLE = 5
#: Verification: share of the question's and of the answer's shingles that the document must hold near the passage.
QUESTION, ANSWER = 0.8, 0.5

SENTENCE = re.compile(rb"[.!?]+[\x20\x09-\x0D]+")


#: What is taken off both ends of a word.
MARKS = ".,;:!?\"'`()[]{}<>|*#$%&/\\+=_~^-–—…«»“”„’‘"


class PlainTable(WordTable):
    """Bytes of a word -> hash of its lower-case form without marks around it; 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        plain = word.decode("utf-8").lower().strip(MARKS)
        h = (xxhash.xxh3_64_intdigest(plain.encode()) or 1) if plain else 0
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


def plain_hashes(words: list[bytes], table: PlainTable) -> np.ndarray:
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of an item without its last sentence, and of that. A single sentence is all question."""
    text = text.strip()
    cuts = list(SENTENCE.finditer(text))
    if not cuts:
        return text.split(), []
    at = cuts[-1].end()
    return text[:at].split(), text[at:].split()


def shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(ngram_hashes(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, np.uint64)


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, item_id, text) -> the same, words, class of length, distinct terms and their counts; items without words go."""
    table = PlainTable()
    for batch in pieces(batches):
        keep, length, kind, term, count = [], [], [], [], []
        for i, text in enumerate(utf8(batch.column(2))):
            h = plain_hashes(text.split(), table)
            if len(h):
                t, c = np.unique(h, return_counts=True)
                keep.append(i)
                length.append(len(h))
                kind.append(doublings(len(h)))
                term.append(t.view(np.int64))
                count.append(c)
        rows = batch.take(pa.array(keep, pa.int64()))
        cols = [pa.array(length, pa.int64()), pa.array(kind, pa.int32()), pa.array(term, pa.list_(pa.int64())), pa.array(count, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*rows.columns, *cols], names=["rid", "item_id", "text", "length", "kind", "term", "count"])


def weighted(benchmark: DataFrame, folder: str) -> DataFrame:
    """(kind, item_id, text, longest, impacts) of all items with words: the impact of each term under the BM25 statistics of
    the whole benchmark, as a share of the item's score for itself; longest is that of the item's class of length."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select(F.monotonically_increasing_id().alias("rid"), "item_id", "text")
    items = items.mapInArrow(item_rows, f"rid long, item_id {item_type}, text string, length long, kind int, term array<long>, count array<long>")
    items = materialise(items, "items", folder)
    size = items.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not size["n"]:
        return items.select("kind", "item_id", "text", F.col("length").alias("longest"), F.array(F.struct(F.lit(0).cast("long").alias("term"), F.lit(0.0).alias("impact"))).alias("impacts"))
    part = items.select("rid", "length", F.explode(F.arrays_zip("term", "count")).alias("x")).select("rid", "length", "x.*")
    df = part.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = merged(part, df, "term").select("rid", "term", (idf * F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * F.col("length") / size["mean"]))).alias("impact"))
    own = part.groupBy("rid").agg(F.sum("impact").alias("own"), F.collect_list(F.struct("term", "impact")).alias("all"))
    own = own.select("rid", F.transform("all", lambda x: F.struct(x["term"].alias("term"), (x["impact"] / F.col("own")).alias("impact"))).alias("impacts"))
    longest = items.groupBy("kind").agg(F.max("length").alias("longest"))  # a row for each doubling of length
    out = merged(items.select("rid", "kind", "item_id", "text"), own, "rid").join(F.broadcast(longest), "kind")
    return out.orderBy("kind", "rid").select("kind", "item_id", "text", "longest", "impacts")


def build_index(ids: list, texts: list[bytes], impacts: list[tuple[np.ndarray, np.ndarray]], longest: int) -> dict:
    """The index of one slice of items, given their terms and impacts, and what their verification needs."""
    table = PlainTable()
    split = [tuple(plain_hashes(x, table) for x in question_and_answer(t)) for t in texts]
    terms, row = np.unique(np.concatenate([t for t, _ in impacts]), return_inverse=True)
    item = np.repeat(np.arange(len(ids)), [len(t) for t, _ in impacts])
    impact = np.concatenate([x for _, x in impacts])
    order = np.lexsort((item, row))
    row, item, impact = row[order], item[order], impact[order]
    top = np.zeros((len(terms), -(-len(ids) // BLOCK)), np.float32)
    np.maximum.at(top, (row, item // BLOCK), impact.astype(np.float32))
    most = np.zeros(len(terms))
    np.maximum.at(most, row, impact)
    return {
        "ids": ids,
        "terms": terms,
        "most": most,
        "top": top,
        "edge": np.searchsorted(row, np.arange(len(terms) + 1)),
        "item": item.astype(np.int32),
        "impact": impact,
        "question": [shingles(q) for q, _ in split],
        "answer": [shingles(a) for _, a in split],
        "passage": max(2 * longest, 32),
    }


def size_of(index: dict) -> int:
    arrays = [x for x in index.values() if isinstance(x, np.ndarray)] + index["question"] + index["answer"]
    return sum(x.nbytes for x in arrays)


def doublings(n: int) -> int:
    """How often LONGEST must be doubled to reach the n words of an item."""
    return max(0, (n - 1) // LONGEST).bit_length()


def passages(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last-but-one word (in all words) of passages of `size` words, each half over the one before;
    a rest shorter than half a passage joins the last. Texts without words have none."""
    half = size // 2
    count = np.where(lengths > 0, np.maximum(-(-(lengths - half) // half), 1), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    base = (np.cumsum(lengths) - lengths)[text]
    first = base + nth * half
    last = nth == count[text] - 1
    return text, first, np.where(last, base + lengths[text], np.minimum(first + size, base + lengths[text]))


def retrieve(h: np.ndarray, lengths: np.ndarray, index: dict) -> list[tuple[int, int, int, float]]:
    """(text, passage's first word in all words, item, score) at or above THRESHOLD, for texts' words laid end to end."""
    terms = index["terms"]
    if not len(terms) or not len(h):
        return []
    text, first, end = passages(lengths, index["passage"])
    row = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    known = terms[row] == h
    most = np.zeros(len(h) + 1)
    np.cumsum(np.where(known, index["most"][row], 0), out=most[1:])
    open_ = np.flatnonzero(most[end] - most[first] >= THRESHOLD - 1e-6)
    if not len(open_):
        return []
    # distinct terms of each passage that is still open
    size = end[open_] - first[open_]
    at = np.repeat(first[open_] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    owner = np.repeat(np.arange(len(open_)), size)[known[at]]
    pair = np.unique(owner * len(terms) + row[at[known[at]]])
    owner, term = pair // len(terms), pair % len(terms)
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    out = []
    for s in range(0, len(cut), 4096):  # block maxima of so many passages at once
        lo = cut[s]
        hi = cut[s + 4096] if s + 4096 < len(cut) else len(owner)
        bound = np.add.reduceat(index["top"][term[lo:hi]], cut[s : s + 4096] - lo, axis=0)
        for p in np.flatnonzero((bound >= THRESHOLD - 1e-5).any(axis=1)).tolist():
            b = cut[s + p]
            e = cut[s + p + 1] if s + p + 1 < len(cut) else len(owner)
            q = open_[owner[b]]
            out += [(int(text[q]), int(first[q]), i, x) for i, x in wand(term[b:e], bound[p], index)]
    return out


def wand(terms: np.ndarray, bound: np.ndarray, index: dict, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """(item, score) at or above threshold for a passage's distinct terms; bound: the sums of their maxima, block by block.

    Block-max WAND: cursors are [item, place, postings' items, impacts, largest impact], in the order of their items.
    """
    cursors = []
    for t in terms.tolist():
        s, e = index["edge"][t], index["edge"][t + 1]
        items = index["item"][s:e].tolist()
        cursors.append([items[0], 0, items, index["impact"][s:e], float(index["most"][t])])
    reach = (bound >= threshold - 1e-5).tolist()
    out = []

    def forward(part: list[list], item: int) -> None:
        for c in part:
            c[1] = bisect_left(c[2], item, c[1])
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1

    while cursors:
        cursors.sort(key=lambda c: c[0])
        pivot, most = None, 0.0
        for k, c in enumerate(cursors):
            most += c[4]
            if most >= threshold - 1e-9:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        if not reach[item // BLOCK]:
            block = item // BLOCK + 1
            while block < len(reach) and not reach[block]:
                block += 1
            forward([c for c in cursors if c[0] < block * BLOCK], block * BLOCK)
        elif cursors[0][0] == item:
            here = [c for c in cursors if c[0] == item]
            score = float(sum(c[3][c[1]] for c in here))
            if score >= threshold:
                out.append((item, score))
            forward(here, item + 1)
        else:
            forward([c for c in cursors[:pivot] if c[0] < item], item)
        cursors = [c for c in cursors if c[0] >= 0]
    return out


def leak_rows(shared, item_type: pa.DataType):
    """(doc_id, text) -> one row per verified leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PlainTable()
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            found: list[tuple] = []
            for a, b in slices(texts):
                parts = [plain_hashes(x.split(), table) for x in texts[a:b]]
                lengths = np.array([len(x) for x in parts], np.int64)
                h, base = np.concatenate(parts), np.cumsum(lengths) - lengths
                for index in shared.value:
                    best: dict[tuple[int, int], tuple] = {}
                    for d, at, i, x in retrieve(h, lengths, index):
                        if (d, i) in best and best[d, i][1] >= x:
                            continue
                        near = shingles_near(parts[d], at - base[d], index["passage"])
                        q, n = overlap(index["question"][i], near), overlap(index["answer"][i], near)
                        if q >= QUESTION and n >= ANSWER:
                            best[d, i] = (int(at - base[d]), x, q, n)
                    found += [(a + d, index["ids"][i], *v) for (d, i), v in best.items()]
            if found:
                source, item, start, score, q_share, a_share = zip(*found, strict=True)
                cols = [batch.column(0).take(pa.array(source)), pa.array(item, item_type), pa.array(start, pa.int64()), pa.array(score, pa.float64()), pa.array(q_share, pa.float64()), pa.array(a_share, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start", "score", "question_share", "answer_share"])

    return run


def shingles_near(h: np.ndarray, s: int, size: int) -> np.ndarray:
    """Shingles, of up to SHINGLE words, of a passage and half a passage on either side."""
    part = h[max(0, s - size // 2) : s + size + size // 2]
    return np.concatenate([ngram_hashes(part, k) for k in range(1, SHINGLE + 1)])


def overlap(own: np.ndarray, near: np.ndarray) -> float:
    return 1.0 if not len(own) else float(np.isin(own, near).mean())


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified leaks, one row per document and item: doc_id, item_id, start, score, question_share, answer_share.

    Words are compared in lower case and without marks around them; marks alone are no words. start is the number of the best
    passage's first word, score the passage's BM25 score over the item's own. A passage that scores
    THRESHOLD or more is verified: its surroundings must hold QUESTION of the question's five-word shingles and ANSWER of
    those of the answer (an item's last sentence; items of one sentence are all question, shorter ones one shingle). An item's
    BM25 score depends on the whole benchmark, and not on how the index is cut.

    Null, empty and white-space texts leak nothing, items without words are never found; repeated items and documents are
    reported as often as they occur; an empty benchmark or documents table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    whole = isinstance(item_type, IntegralType)
    kinds = f"doc_id {id_type}, item_id {'bigint' if whole else 'string'}, start long, score double, question_share double, answer_share double"
    docs = documents.select("doc_id", "text")
    parts: list[DataFrame] = []
    group: list[dict] = []
    rows: list[tuple] = []
    own: tuple = ()

    def search() -> None:
        shared = spark.sparkContext.broadcast(group)
        part = docs.mapInArrow(leak_rows(shared, pa.int64() if whole else pa.string()), kinds)
        parts.append(materialise(part, f"leaks-{len(parts)}", folder))
        shared.destroy()
        group.clear()

    def close() -> None:
        if rows:
            ids, texts, impacts = zip(*rows, strict=True)
            group.append(build_index(list(ids), list(texts), list(impacts), own[1]))
            rows.clear()
            if sum(map(size_of, group)) > GROUP_BYTES:
                search()

    for r in weighted(benchmark, folder).toLocalIterator():
        if own != (r["kind"], r["longest"]) or len(rows) >= max(1, SLICE >> r["kind"]):
            close()
            own = (r["kind"], r["longest"])
        terms = np.array([x["term"] for x in r["impacts"]], np.int64).view(np.uint64)
        rows.append((r["item_id"] if whole or r["item_id"] is None else str(r["item_id"]), r["text"].encode(), (terms, np.array([x["impact"] for x in r["impacts"]]))))
    close()
    if group or not parts:
        search()
    discard(spark, f"{folder}/items")
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("item_id", F.col("item_id").cast(item_type))
