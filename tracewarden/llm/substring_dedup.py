"""Repeated passages by relative Lempel-Ziv parsing against reference blocks that are dealt by hash.

A document is parsed relative to all documents with a smaller doc_id. No block can hold all of those, and no document can be
read against every block, so both are cut into phrases that meet where they can match:

* every window of `window` words names its smallest k-gram (k = 5) as anchor; equal windows name equal anchors. Consecutive
  windows with one anchor form a phrase. A counting filter of anchors drops phrases whose anchor only one text has; it has a
  fixed size, and where it is crowded it lets more phrases through, but none is lost.
* equal phrases are one, kept with its first document; in later documents it is a factor as a whole, whatever their number.
* the distinct phrases are dealt by anchor to reference blocks of bounded size. A block is indexed by its windows, and each of
  its phrases is parsed greedily against the phrases of earlier documents: at a place, the longest match is found by
  extending all matches word by word, a factor is cut there, and parsing goes on with the first window that the factor does
  not cover, so that windows across a factor's boundary are looked up like others.
* anchors of more phrases than a block should hold have them cut into single windows, which are compared by a grouping.

Factors are duplicate spans, and are merged per document. What is a duplicate is decided on the input alone, so that the
order of documents does not matter. Popular passages meet in map-side minima; nothing gathers the documents of a passage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_words, materialise, merged, mix, pieces, scratch_dir, ship, slices, starts_of, utf8, WordTable

ANCHOR_WORDS = 5
FILTER_BITS = 28
#: Slots of one block of the filter, as a power of two.
BLOCK_BITS = 16
#: Distinct phrases of a reference block, about, and of one anchor before they are cut into windows.
BLOCK_PHRASES, ANCHOR_PHRASES = 150_000, 1_000
#: Rows of one phrase that are joined in one task, about.
HOT_ROWS = 10_000
#: Parts into which the windows of crowded anchors are dealt when they are told their first document.
SPREAD = 32

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# ---------------------------------------------------------------- kernels


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse, to the powers 0 .. size - 1, modulo 2 ** 64."""
    out = []
    with np.errstate(over="ignore"):
        for x in (BASE, INVERSE):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Runs:
    """Hashes of runs of words, from sums over all words before."""

    def __init__(self, flat: np.ndarray):
        size = 1 << 16
        while size <= len(flat):
            size *= 2
        power, self.back = powers(size)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * power[: len(flat)], out=self.sums[1:])

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of the words from s up to e."""
        return mix((self.sums[e] - self.sums[s]) * self.back[s] + (e - s).astype(np.uint64))

    def all_of(self, n: int) -> np.ndarray:
        """Of the n words from each place on."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.back[:m] + np.uint64(n))


def first_least(g: np.ndarray, w: int) -> np.ndarray:
    """For every run of w values, the place of its first least one; found by doubling."""
    n = len(g) - w + 1

    def better(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(g[q] < g[p], q, p)

    power, width = np.arange(len(g), dtype=np.int32), 1
    best, done = None, 0
    while True:
        if w & width:
            part = power[done : done + n]
            best = part if best is None else better(best, part)
            done += width
        if done == w:
            return best
        power, width = better(power[:-width], power[width:]), 2 * width


def phrases(runs: Runs, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of texts' words laid end to end: text number, first word (of all), windows, anchor."""
    k = ANCHOR_WORDS
    total = int(starts[-1])
    m = total - window + 1
    if m <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    g = runs.all_of(k)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    good = np.flatnonzero(doc[:m] == doc[window - 1 :])
    pos, own = first_least(g, window - k + 1)[good], doc[good]
    new = np.ones(len(good), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(new)
    return own[head], good[head], np.diff(np.append(head, len(good))), g[pos[head]]


def _texts(batch: pa.RecordBatch, column: int, table: WordTable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts = utf8(batch.column(column))
    for a, b in slices(texts):
        words = [x.split() for x in texts[a:b]]
        starts = starts_of(np.array([len(x) for x in words], np.int64))
        yield a, hash_words([w for x in words for w in x], table), starts


def _slot(anchor: np.ndarray) -> np.ndarray:
    return (mix(anchor) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def slot_rows(window: int):
    """Texts -> (block, slot, n): slots of the anchors of each text, n = 2 where several texts of a batch have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in pieces(batches):
            for _, flat, starts in _texts(batch, 0, table):
                doc, _, _, anchor = phrases(Runs(flat), starts, window)
                if not len(doc):
                    continue
                own = np.unique(doc << FILTER_BITS | _slot(anchor)) & ((1 << FILTER_BITS) - 1)
                slot, n = np.unique(own, return_counts=True)
                cols = [pa.array((slot >> BLOCK_BITS).astype(np.int32)), pa.array((slot & ((1 << BLOCK_BITS) - 1)).astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int8))]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "slot", "n"])

    return run


def filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks -> (block, bits): the slots that at least two texts have."""
    seen: dict[int, np.ndarray] = {}
    many: dict[int, np.ndarray] = {}
    for batch in batches:
        block, slot, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        order = np.argsort(block, kind="stable")
        block, slot, n = block[order], slot[order], n[order]
        cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            b = int(block[s])
            if b not in seen:
                seen[b], many[b] = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
            u, c = np.unique(slot[s:e], return_counts=True)
            many[b][slot[s:e][n[s:e] > 1]] = True
            many[b][u[(c > 1) | seen[b][u]]] = True
            seen[b][u] = True
    for b, bits in many.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])


def phrase_rows(window: int, shared):
    """(text, doc_id, t) -> phrases whose anchor several texts may have, with the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = WordTable(), np.frombuffer(shared.value, np.uint8)
        for batch in pieces(batches):
            for a, flat, starts in _texts(batch, 0, table):
                runs = Runs(flat)
                doc, s, count, anchor = phrases(runs, starts, window)
                slot = _slot(anchor)
                keep = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                if not len(keep):
                    continue
                doc, s, c, anchor = doc[keep], s[keep], count[keep], anchor[keep]
                row, whole, edge = pa.array(doc + a), runs.hashes(s, s + c + (window - 1)), starts_of(c)
                at = np.repeat(s - edge[:-1], c) + np.arange(edge[-1])
                w = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(runs.hashes(at, at + window).view(np.int64)))
                cols = [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(1).take(row), batch.column(2).take(row)]
                cols += [pa.array((s - starts[doc]).astype(np.int32)), pa.array(c.astype(np.int32)), w]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "whole", "doc_id", "t", "s", "c", "w"])

    return run


def longest_matches(window: np.ndarray, left: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every window of a block's phrases, of how many windows the longest match from there on in an earlier document is.

    window: their hashes, phrase by phrase; left: windows from each to its phrase's end, itself included; rank: number of its
    phrase's document, in order. All matches are extended by a word at a time; a run of windows that no earlier document has
    can't become one by growing.
    """
    length = np.zeros(len(window), np.int64)
    at = np.arange(len(window))
    run = np.unique(window, return_inverse=True)[1]
    size = 0
    while len(at):
        size += 1
        first = np.full(int(run.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, run, rank[at])
        hit = first[run] < rank[at]
        length[at[hit]] = size
        # runs that some later document repeats go on, with all their places
        lives = np.zeros(len(first), bool)
        lives[run[hit]] = True
        keep = lives[run] & (left[at] > size)
        at, run = at[keep], run[keep]
        if len(at):
            pair = np.empty((len(at), 2), np.int64)
            pair[:, 0], pair[:, 1] = run, window[at + size].view(np.int64)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            new = (pair[order[1:]] != pair[order[:-1]]).any(axis=1)
            run = np.empty(len(at), np.int64)
            run[order] = np.concatenate(([0], np.cumsum(new)))
    return length


def parse(count: np.ndarray, window: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of a block's phrases relative to earlier documents: phrase, first window, windows.

    count: windows of each phrase; window: their hashes; rank: number of each phrase's document, in order.
    """
    starts = starts_of(count)
    owner = np.repeat(np.arange(len(count)), count)
    longest = longest_matches(window, starts[1:][owner] - np.arange(len(window)), rank[owner])
    place = np.zeros(len(count), np.int64)
    open_ = np.flatnonzero(count > 0)
    out = []
    while len(open_):
        n = longest[starts[open_] + place[open_]]
        cut = np.flatnonzero(n)
        out.append((open_[cut], place[open_[cut]], n[cut]))
        place[open_] += np.maximum(n, 1)
        open_ = open_[place[open_] < count[open_]]
    phrase, at, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    order = np.lexsort((at, phrase))
    return phrase[order], at[order], n[order]


def parse_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reference block, phrases sorted by document: (document's hash, w, later, ...) -> (..., factors) of those that have
    a factor or that later documents repeat."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    mark = table.column(0).to_numpy()
    rank = np.concatenate(([0], np.cumsum(mark[1:] != mark[:-1])))
    w = table.column(1).combine_chunks()
    count = pa.compute.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
    phrase, at, n = parse(count, w.flatten().to_numpy(zero_copy_only=False), rank)
    edge = np.searchsorted(phrase, np.arange(len(count) + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["o", "n"])
    found = table.append_column("factors", pa.ListArray.from_arrays(pa.array(edge), inner))
    found = found.filter(pa.array((np.diff(edge) > 0) | table.column(2).to_numpy()))
    yield from found.drop_columns(found.column_names[:3]).to_batches(max_chunksize=20_000)


def deal_rows(shared):
    """(anchor, whole, t, s, ...) -> the same and deal: 0, or for the very frequent phrases one of as many numbers as tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, anchor, parts = shared.value
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            at = np.minimum(np.searchsorted(whole, own[1]), len(whole) - 1)
            hot = (whole[at] == own[1]) & (anchor[at] == own[0])
            spot = mix(own[2].view(np.uint64) + own[3].astype(np.uint64))
            deal = np.where(hot, spot % parts[at].astype(np.uint64), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal)], names=[*batch.schema.names, "deal"])

    return run


def cut_rows(one_space: bool):
    """(doc_id, text, spans, ...) -> (doc_id, n_words, n_removed, text of the words outside all spans, merged spans, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, spans = utf8(batch.column(1)), batch.column(2)
            for a, b in slices(texts):
                n_words, n_removed, kept, merged = [], [], [], []
                for i in range(a, b):
                    words = texts[i].split()
                    n_words.append(len(words))
                    own = spans[i].as_py()
                    if not own:
                        n_removed.append(0)
                        kept.append(b" ".join(words) if one_space else None)
                        merged.append([])
                        continue
                    edge = np.zeros(len(words) + 1, np.int32)
                    for x in own:
                        edge[x["s"]] += 1
                        edge[min(x["s"] + x["n"], len(words))] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    merged.append([{"start": int(s), "end": int(e)} for s, e in turn.reshape(-1, 2)])
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                if not one_space:
                    text = pa.compute.if_else(pa.array(np.array(n_removed) > 0), text, batch.column(1).slice(a, b - a))
                cols = [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text]
                cols += [pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), *(c.slice(a, b - a) for c in batch.columns[3:])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_text", "spans", *batch.schema.names[3:]])

    return run


# ---------------------------------------------------------------- the operator


def remove_repeats(documents: DataFrame, window: int = 13, carry: Sequence[str] = (), one_space: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, spans (word ranges [start, end) that were removed).

    Words are split at ASCII white space and taken as they are. A word goes if a window of `window` consecutive words covers
    it whose words also start, in the same order, in a document with a smaller doc_id; windows are judged on the input.
    kept_text joins what stays by single spaces; without one_space, texts from which nothing is removed stay as they are.

    Null, empty and short texts have no window and keep all words. Rows that repeat a doc_id are not earlier than one
    another; a row without a doc_id is earlier than none and keeps all its words. An empty table gives an empty result.
    Columns named in carry go along with their rows, under names that none of the others has; all other columns are ignored.
    """
    if window < ANCHOR_WORDS:
        raise ValueError(f"window must be at least {ANCHOR_WORDS} words")
    spark = documents.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    slots = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(slot_rows(window), "block int, slot int, n byte")
    blocks = materialise(slots.repartition("block").mapInArrow(filter_blocks, "block int, bits binary"), "blocks", folder)
    bits = bytearray(1 << FILTER_BITS >> 3)
    width = 1 << BLOCK_BITS >> 3
    for r in blocks.coalesce(4).toLocalIterator():  # fixed in size, whatever the corpus
        bits[r["block"] * width : (r["block"] + 1) * width] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))
    del bits

    found = docs.where("doc_id IS NOT NULL").select("text", "doc_id", "t")
    found = found.mapInArrow(phrase_rows(window, shared), f"anchor long, whole long, doc_id {id_type}, t long, s int, c int, w array<long>")
    found = materialise(found, "found", folder)
    shared.destroy()
    first = found.groupBy("anchor", "whole").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("last"), F.count("*").alias("rows"), F.first("w").alias("w"))
    first = materialise(first.withColumn("later", F.col("m") < F.col("last")).drop("last"), "first", folder)
    verdict = materialise(parsed(first, id_type, folder), "verdict", folder)

    # rows of very frequent phrases are dealt to several tasks; no more than 2 ** 17 phrases can be so frequent
    size = first.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    part = max(HOT_ROWS, size >> 17)
    hot = verdict.where(F.col("rows") > part).select("whole", "anchor", F.ceil(F.col("rows") / part).cast("long").alias("parts")).orderBy("whole").toArrow()
    at = found.select("anchor", "whole", "t", "s", "c", "doc_id")
    keys = ["anchor", "whole"]
    if len(hot):
        dealing = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in hot.columns))
        at = at.mapInArrow(deal_rows(dealing), f"anchor long, whole long, t long, s int, c int, doc_id {id_type}, deal long")
        dealt = F.when(F.col("rows") > part, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / part).cast("long") - 1)).otherwise(F.array(F.lit(0).cast("long")))
        verdict = verdict.withColumn("deal", F.explode(dealt))
        keys = [*keys, "deal"]
    spans = merged(at, verdict, keys)
    own = F.transform("factors", lambda f: F.struct((F.col("s") + f["o"]).alias("s"), (f["n"] + (window - 1)).alias("n")))
    all_of_it = F.array(F.struct(F.col("s"), (F.col("c") + (window - 1)).alias("n")))
    spans = spans.select("doc_id", "t", F.explode(F.when(F.col("m") < F.col("doc_id"), all_of_it).otherwise(own)).alias("x"))
    spans = materialise(spans.groupBy("doc_id", "t").agg(F.collect_set("x").alias("spans")), "spans", folder)
    discard(spark, *(f"{folder}/{x}" for x in ("blocks", "found", "first", "crowded", "verdict")))
    more = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in carry)
    out = merged(documents.select("doc_id", "text", F.xxhash64("text").alias("t"), *carry), spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans", *carry)
    return out.mapInArrow(cut_rows(one_space), f"doc_id {id_type}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>{more}")


def parsed(first: DataFrame, id_type: str, folder: str) -> DataFrame:
    """Distinct phrases -> (anchor, whole, m, rows, factors) of those that have factors or are repeated as a whole."""
    blocks = max(1, -(-first.count() // BLOCK_PHRASES))
    crowded = first.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > ANCHOR_PHRASES).select("anchor")
    crowded = materialise(crowded, "crowded", folder)
    some = not crowded.isEmpty()
    usual = first.join(crowded, "anchor", "left_anti") if some else first  # few anchors: Spark broadcasts them up to its own bound
    usual = usual.repartition(blocks, "anchor").sortWithinPartitions("m").select(F.xxhash64("m").alias("mark"), "w", "later", "anchor", "whole", "m", "rows")
    out = usual.mapInArrow(parse_block, f"anchor long, whole long, m {id_type}, rows long, factors array<struct<o:int,n:int>>")
    if not some:
        return out
    rest = first.join(crowded, "anchor", "left_semi")
    single = rest.select("anchor", "whole", "m", F.posexplode("w").alias("o", "key"))
    low = single.groupBy("key").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo < hi")
    low = low.select("key", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("deal"))
    single = single.withColumn("deal", F.pmod(F.xxhash64("whole"), F.lit(SPREAD)))
    hits = merged(single, low, ["key", "deal"]).where("lo < m")
    hits = hits.groupBy("anchor", "whole").agg(F.collect_list(F.struct("o", F.lit(1).alias("n"))).alias("factors"))
    rest = merged(rest.select("anchor", "whole", "m", "rows", "later"), hits, ["anchor", "whole"], "left").where("later OR factors IS NOT NULL")
    return out.unionByName(rest.drop("later"))
