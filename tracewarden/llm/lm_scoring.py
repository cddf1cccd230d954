"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over the whole training part with a shuffle, quantised (small counts exactly,
larger ones on a logarithmic scale) and stored in a Bloom filter: a count with code q is stored as the entries
(n-gram, 1) ... (n-gram, q), and is read back by probing until the first miss. The filter lies in blocks by hash range, each
as wide as the n-grams counted in it need, so that every n-gram is stored at every input size. It is never in one place:
texts are taken in slices of consecutive rows, a slice sends its distinct n-grams to their blocks, where they are added up,
stored and read back, and each block answers every slice with the codes of the n-grams that it sent, in their order.

The baseline needs exact counts. Words frequent enough to be among the first HEAD are looked up in a broadcast table of
bounded size; all others go through a join on the word's hash, in which no key can be hot. Words are keyed by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, mix, pieces, scratch_dir, ship, slices, starts_of, utf8

#: Least filter size as a power of two bits, blocks as a power of two, probes per entry. Blocks are doubled as they fill.
FILTER_BITS, BLOCK_BITS, PROBES = 28, 10, 3
#: Share of a block's bits that may be set.
LOAD = 0.4
#: Consecutive rows of a slice as a power of two, and bytes of text of which n-grams are made distinct at once.
ROW_BITS, PART_BYTES = 11, 8_000_000
#: Counts up to EXACT are stored as they are, larger ones as EXACT + steps of a factor STEP.
EXACT, STEP = 8, 1.08
#: Most entries of the broadcast table of frequent words.
HEAD = 1 << 20
#: Pseudo-count of the lower order in the mixture: PRIOR * count(context) ** PRIOR_POWER, PRIOR at least. Contexts keep
#: meeting new words as they grow, so a constant would trust frequent contexts too much.
PRIOR, PRIOR_POWER = 4.0, 0.8

END = b""


def code_of(count: np.ndarray) -> np.ndarray:
    c = np.maximum(count, 1).astype(np.float64)
    big = EXACT + np.floor(np.log(np.maximum(c / EXACT, 1)) / np.log(STEP))
    return np.where(c <= EXACT, c, big).astype(np.int64)


def count_of(code: np.ndarray) -> np.ndarray:
    """The count that a code stands for: itself, or the geometric middle of its step."""
    q = code.astype(np.float64)
    return np.where(q <= EXACT, q, EXACT * STEP ** (q - EXACT + 0.5))


def decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, count_of(code), 0.0)


def _bits_of(key: np.ndarray, level: np.ndarray | int, width: int) -> Iterator[np.ndarray]:
    """Bit numbers within a block of width bits for entries (key, level)."""
    with np.errstate(over="ignore"):
        x = mix(key ^ (np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield (x & np.uint64(width - 1)).astype(np.int64)
            x = mix(x + step)


def _block_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)


class Numbering(dict):
    """Words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (the end is number 0), the tokens' numbers end to end, and where each text starts."""
    words = [x.lower().split() for x in texts]
    flat: list[bytes] = []
    for ws in words:
        flat += ws
        flat.append(END)
    number = Numbering({END: 0})
    index = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    return h, index, starts_of(np.array([len(x) + 1 for x in words], np.int64))


def pair_codes(index: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """number of the token before * n + number of the token; the end stands before the first."""
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[starts[:-1]] = 0
    return before * n + index


def word_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0x5851F42D4C957F2D))


def pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (key, c): counts of words, key = their hash."""
    for batch in pieces(batches, 2500):  # the larger a slice, the fewer rows are shuffled
        texts = utf8(batch.column(0))
        for a, b in slices(texts, PART_BYTES):
            h, index, _ = tokens(texts[a:b])
            c = np.bincount(index, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[c > 0].view(np.int64)), pa.array(c[c > 0].astype(np.int32))], names=["key", "c"])


def packed(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: high bytes of small numbers compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class NGrams:
    """Distinct words and pairs of some texts, and their keys in the order in which blocks are asked."""

    def __init__(self, texts: list[bytes]):
        self.h, self.index, self.starts = tokens(texts)
        n = len(self.h)
        pair, self.where = np.unique(pair_codes(self.index, self.starts, n), return_inverse=True)
        self.before, self.word = pair // n, pair % n
        key = np.concatenate((word_key(self.h), pair_key(self.h[self.before], self.h[self.word])))
        self.order = np.argsort(key)
        self.key = key[self.order]
        with np.errstate(over="ignore"):
            self.check = int(self.key.sum(dtype=np.uint64).view(np.int64))

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """Counts of the keys in the texts for which learn is true."""
        own = np.repeat(learn, np.diff(self.starts))
        words = np.bincount(self.index[own], minlength=len(self.h))
        return np.concatenate((words, np.bincount(self.where[own], minlength=len(self.before))))[self.order]


def whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in order of column 0, their slice -> each slice with its rows, in as many pieces as they came."""
    held: list[pa.RecordBatch] = []
    own = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s = batch.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and s[a] != own:
                yield own, held
                held = []
            own = int(s[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield own, held


def ask_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, row, doc_id, text, held_out) -> what each part of a slice asks of each block: keys, and counts to be added."""
    edge = np.arange(1, 1 << BLOCK_BITS, dtype=np.uint64) << np.uint64(64 - BLOCK_BITS)
    for own, rows in whole_slices(batches):
        texts = [x for r in rows for x in utf8(r.column(3))]
        learn = ~np.concatenate([r.column(4).to_numpy(zero_copy_only=False).astype(bool) for r in rows])
        for part, (a, b) in enumerate(slices(texts, PART_BYTES)):
            grams = NGrams(texts[a:b])
            c = grams.counts(learn[a:b]).astype(np.uint32)
            cut = [0, *np.searchsorted(grams.key, edge).tolist(), len(grams.key)]
            out = []
            for k, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if s < e:  # steps from key to key are smaller than keys
                    step = np.diff(grams.key[s:e], prepend=np.uint64(k) << np.uint64(64 - BLOCK_BITS))
                    out.append((k, packed(step), packed(c[s:e])))
            block, keys, counts = zip(*out, strict=True)
            n = len(block)
            cols = [pa.array([own] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([grams.check] * n, pa.int64()), pa.array(block, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "part", "check", "block", "keys", "counts"])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of ask_blocks for whole blocks -> the codes that the filter holds for their keys, row by row."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for own, part, check, block, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(block, []).append((own, part, check, keys, counts))
    for block in list(held):
        own, part, check, keys, counts = zip(*held.pop(block), strict=True)
        low = np.uint64(block) << np.uint64(64 - BLOCK_BITS)
        sent = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) + low for x in keys]
        key, where = np.unique(np.concatenate(sent), return_inverse=True)
        c = np.bincount(where, np.concatenate([unpacked(x, np.uint32) for x in counts])).astype(np.int64)
        known = key[c > 0]
        rows = [pa.array(np.full(len(known), block, np.int32)), pa.array(np.full(len(known), 2, np.int8)), pa.array(known.view(np.int64)), pa.array(c[c > 0])]
        code = np.zeros(len(key), np.uint16)
        for b in filter_blocks(iter([pa.RecordBatch.from_arrays(rows, names=["block", "n", "key", "c"])])):
            code = LogFrequencyFilter(b.column(1)[0].as_py(), one=True).codes(key).astype(np.uint16)
        cut = np.cumsum([len(x) for x in sent])[:-1]
        codes = [packed(x) for x in np.split(code[where], cut)]
        cols = [pa.array(own, pa.int64()), pa.array(part, pa.int32()), pa.array(check, pa.int64()), pa.array([block] * len(own), pa.int32()), pa.array(codes, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["slice", "part", "check", "block", "codes"])


def filter_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All n-grams of whole blocks, (block, n, key, c) -> (block, bits). A block is doubled until all its entries fit LOAD."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, [("n", "i1"), ("key", "u8"), ("c", "i8")])
        block = batch.column(0).to_numpy(zero_copy_only=False)
        rows["n"] = batch.column(1).to_numpy(zero_copy_only=False)
        rows["key"] = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        rows["c"] = batch.column(3).to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows[order]
        cut = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            held.setdefault(int(block[s]), []).append(rows[s:e])
    for b in list(held):
        x = np.concatenate(held.pop(b))
        q = code_of(x["c"])
        key = np.where(x["n"] == 1, word_key(x["key"]), x["key"])
        width = 1 << (FILTER_BITS - BLOCK_BITS)
        while int(q.sum()) * PROBES > -np.log(1 - LOAD) * width:
            width *= 2
        bits = np.zeros(width, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            key = key[q >= level]
            q = q[q >= level]
            for at in _bits_of(key, level, width):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])


class LogFrequencyFilter:
    """Reads counts back from the filter's bytes: one block of any width, or all blocks of the least width end to end."""

    def __init__(self, data: bytes, one: bool = False):
        self.bits = np.frombuffer(data, np.uint8)
        self.width = 8 * len(data) if one else 1 << (FILTER_BITS - BLOCK_BITS)
        self.one = one

    def _hits(self, key: np.ndarray, level: int) -> np.ndarray:
        """Numbers of the keys whose entry of this level is there; a probe is made only where the one before hit."""
        mask = np.uint64(self.width - 1)
        left, base = np.arange(len(key)), np.zeros(len(key), np.int64) if self.one else _block_of(key) * self.width
        with np.errstate(over="ignore"):
            x = mix(key ^ (np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)))
            step = (x >> np.uint64(32)) | np.uint64(1)
            for probe in range(PROBES):
                if probe:
                    x = mix(x + step)
                at = (x & mask).astype(np.int64) + base
                hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                left, base, x, step = left[hit], base[hit], x[hit], step[hit]
        return left

    def codes(self, key: np.ndarray) -> np.ndarray:
        """Codes; 0 where the first probe misses. Keys are probed block by block, so that a block stays cached."""
        order = np.argsort(key)
        key = key[order]
        code = np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        level = 0
        while len(left):
            level += 1
            left = left[self._hits(key[left], level)]
            code[left] = level
        out = np.empty(len(key), np.int64)
        out[order] = code
        return out

    def counts(self, key: np.ndarray) -> np.ndarray:
        return decoded(self.codes(key))


def read_codes(grams: NGrams, part: int, answers: pa.Table) -> np.ndarray:
    """The counts that the blocks answered, in the order of the words and then the pairs."""
    own = answers.filter(pc.equal(answers.column("part"), part)).sort_by("block")
    code = np.concatenate([unpacked(x, np.uint16) for x in own.column("codes").to_pylist()] or [np.empty(0, np.uint16)])
    if len(code) != len(grams.key) or set(own.column("check").to_pylist()) != {grams.check}:
        raise ValueError("documents came in another order or number when they were read again")
    out = np.empty(len(code))
    out[grams.order] = decoded(code.astype(np.int64))
    return out


def score_slice(head, total: int, distinct: int):
    """A slice's (slice, row, doc_id, text, held_out) and the answers of all blocks -> scores, with the part of the baseline
    that the table of frequent words settles."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, log_p = head.value
        floor = 1.0 / (total + distinct + 1)
        rows = rows.sort_by("row")
        texts = utf8(rows.column("text"))
        out = []
        for part, (a, b) in enumerate(slices(texts, PART_BYTES)):
            grams = NGrams(texts[a:b])
            h, back, starts = grams.h, grams.index, grams.starts
            count = read_codes(grams, part, answers)
            i = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            frequent = keys[i] == h if len(keys) else np.zeros(len(h), bool)
            base = np.where(frequent, log_p[i] if len(keys) else 0.0, 0.0)
            c = count[: len(h)]
            p1 = np.minimum((c + 1) * floor, 1.0)
            prev, word = grams.before, grams.word
            joint = np.minimum(count[len(h) :], np.minimum(c[prev], c[word]))
            prior = PRIOR * np.maximum(c[prev], 1.0) ** PRIOR_POWER
            p2 = np.minimum((joint + prior * p1[word]) / (c[prev] + prior), 1.0)
            lp = np.log10(p2)[grams.where]
            at = starts[:-1]
            known = frequent[back]
            rare = np.flatnonzero(~known)
            doc = np.repeat(np.arange(len(at)), np.diff(starts))
            seldom, tf = np.unique(doc[rare] * len(h) + back[rare], return_counts=True)
            offsets = np.searchsorted(seldom, np.arange(len(at) + 1) * len(h)).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(h[seldom % len(h)].view(np.int64)), pa.array(tf.astype(np.int32))], names=["key", "tf"])
            own = rows.slice(a, b - a)
            cols = [own.column("row"), own.column("doc_id"), own.column("held_out"), pa.array(np.diff(starts)), pa.array(np.add.reduceat(known.astype(np.int64), at))]
            cols += [pa.array(np.add.reduceat(base[back], at)), pa.array(np.add.reduceat(lp, at)), pa.ListArray.from_arrays(pa.array(offsets), inner)]
            out.append(pa.table(cols, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"]))
        return pa.concat_tables(out)

    return run


def score_documents(documents: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out is a condition on the columns of `documents`; the model learns from all rows where it is false. Tokens are the
    words (split at ASCII white space, A-Z lower-cased) and one end per text. base_score is the add-one unigram log10
    probability with exact counts. score is the log10 probability under the filter's model: pairs, smoothed towards words
    with pseudo-counts, words smoothed by adding one.

    Documents are read more than once and must come in the same order each time, as files do; it fails where they don't. A
    block is settled by one task, which holds its share of all slices' n-grams, 1 of 2 ** BLOCK_BITS.

    Null and empty texts are one end token. With no training rows every probability is 1 / 1. Rows are scored one by one, so
    repeated rows count repeatedly in training and give repeated results. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    docs = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    words = docs.where("NOT held_out").select("text").mapInArrow(count_words, "key long, c int").groupBy("key").agg(F.sum("c").alias("c"))
    words = materialise(words, "words", folder)
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = size["total"], size["distinct"]
    least, taken = 1, 0
    levels = words.groupBy("c").agg(F.count("*").alias("m")).orderBy(F.desc("c"))
    for r in levels.toLocalIterator():  # at most HEAD steps: each level holds a word or more
        taken += r["m"]
        if taken > HEAD:
            least = r["c"] + 1
            break
    frequent = words.where(F.col("c") >= least).toArrow()  # columns, not row objects: 16 bytes an entry
    keys = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    log_p = np.log10((frequent["c"].to_numpy().astype(np.float64)[order] + 1) / (total + distinct + 1))
    head = spark.sparkContext.broadcast((keys[order], log_p))

    dealt = docs.withColumn("row", F.monotonically_increasing_id()).select(F.shiftright("row", ROW_BITS).alias("slice"), "row", "doc_id", "text", "held_out")
    asked = dealt.mapInArrow(ask_blocks, "slice long, part int, check long, block int, keys binary, counts binary")
    answers = asked.repartition("block").mapInArrow(answer, "slice long, part int, check long, block int, codes binary")
    kinds = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<key:bigint,tf:int>>"
    part = dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score_slice(head, total, distinct), kinds)
    part = materialise(part, "scores", folder)
    seldom = part.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(words.where(F.col("c") < least), "key", "left")
    log_c = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    rest = seldom.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * log_c).alias("b"))
    rest = materialise(rest, "rest", folder)
    discard(spark, f"{folder}/words")
    out = part.drop("rare").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        "score",
    )
