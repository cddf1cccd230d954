"""Near-duplicate detection with HyperMinHash registers.

Every document's set of word shingles is summarised by buckets that hold the smallest hash value in compressed form: the
count of its leading zeros and the mantissa bits that follow. All buckets see all shingles, each through its own
multiplier, so none is empty and two sets agree in a bucket with probability J plus a small chance of collision. Bands of
registers propose candidates, the register-wise estimate (corrected for those collisions) discards the hopeless ones, and
what is left is confirmed on the full shingle sets.

Groups of copies of any size are handled without listing their pairs:
* documents with equal sets form one class, found with a map-side aggregate; only classes take part in what follows;
* first each class is compared with one leader per band bucket, and confirmed links are merged into components;
* then only members of different components that share a bucket are compared. Buckets are cut into blocks of at most
  BLOCK x BLOCK members, so no task holds a whole bucket, and no pair within a component is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_words, materialise, merged, mix, ngram_hashes, pieces, scratch_dir, ship, slices, spread, utf8, WordTable

BANDS, ROWS = 30, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
BLOCK = 512
#: Rows of one class that are joined in one task, about.
HOT_ROWS = 5_000
#: A true link at the threshold is thrown away by the estimate only beyond this many standard deviations.
MARGIN_SIGMA = 5.0

MULTIPLIERS = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# ---------------------------------------------------------------- kernels


def shingle_sets(texts: list[bytes], n: int, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their counts."""
    words = [x.lower().split() for x in texts]
    sets = []
    flat = hash_words([w for ws in words for w in ws], table)
    at = 0
    for ws in words:
        h, at = flat[at : at + len(ws)], at + len(ws)
        if len(h) == 0:
            sets.append(np.empty(0, np.uint64))
        elif len(h) < n:
            sets.append(ngram_hashes(h, len(h)))
        else:
            sets.append(np.unique(ngram_hashes(h, n)))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def registers(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BUCKETS registers (leading zeros << MANTISSA | mantissa) of each non-empty set; empty sets get zeros."""
    out = np.zeros((len(counts), BUCKETS), np.uint16)
    full = counts > 0
    if not full.any():
        return out
    starts = (np.cumsum(counts) - counts)[full]
    low = np.empty((len(starts), BUCKETS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(BUCKETS):
            low[:, j] = np.minimum.reduceat(shingles * MULTIPLIERS[j], starts)
    out[full] = compress(low)
    return out


def compress(low: np.ndarray) -> np.ndarray:
    """64-bit minimum -> 6 bits of leading zeros and MANTISSA bits after the leading one."""
    length = np.frexp((low >> np.uint64(11)).astype(np.float64))[1]
    zeros = (53 - length).astype(np.uint64)
    mantissa = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


@lru_cache(maxsize=1)
def collision_table() -> np.ndarray:
    """Chance that registers of two unrelated sets of 2**i and 2**j shingles agree."""
    lz = np.arange(0, 44)[:, None]
    step = 2.0 ** -(lz + 1.0 + MANTISSA)
    lower = 2.0 ** -(lz + 1.0) + step * np.arange(1 << MANTISSA)[None, :]
    upper = lower + step
    sizes = 2.0 ** np.arange(0, 25)
    probs = [np.exp(s * np.log1p(-lower)) - np.exp(s * np.log1p(-np.minimum(upper, 1 - 1e-12))) for s in sizes]
    return np.array([[float((p * q).sum()) for q in probs] for p in probs])


def estimate(matches: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from agreeing registers, corrected for accidental agreement."""
    c = collision_table()
    top = len(c) - 1
    i = np.clip(np.rint(np.log2(np.maximum(n_a, 1))), 0, top).astype(int)
    j = np.clip(np.rint(np.log2(np.maximum(n_b, 1))), 0, top).astype(int)
    e = c[i, j]
    return np.clip((matches / BUCKETS - e) / (1 - e), 0, 1)


def floor_estimate(threshold: float) -> float:
    return threshold - MARGIN_SIGMA * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def _regs(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint16).reshape(-1, BUCKETS)


def signature_rows(n: int, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                flat, counts = shingle_sets(texts[a:b], n, table)
                ends = np.cumsum(counts)
                parts = [flat[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                c = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64).view(np.int64)
                cols = [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(c)]
                if with_sets:
                    cols.append(pa.array(parts, pa.binary()))
                else:
                    regs = registers(flat, counts)
                    cols.append(pa.array([r.tobytes() for r in regs], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "c", "sets" if with_sets else "regs"])

    return run


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _regs(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) * np.ones((len(r), 1), np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x100000001B3) + r[:, :, j])
            # the lowest bits name the band, so that equal keys always come from the same band
            key = (key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)[None, :]
            c = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(c)], names=["k", "c"])


def estimate_pairs(least: float):
    """(a, b, na, nb, ra, rb, da, db) -> (a, b, da, db) whose estimate is high enough to be worth confirming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            m = (_regs(batch.column(4)) == _regs(batch.column(5))).sum(axis=1)
            keep = pa.array(estimate(m, n_a, n_b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1, 6, 7)], names=["a", "b", "da", "db"])

    return run


def confirm_pairs(percent: int):
    """(a, b, sa, sb) -> (a, b) with 100 * |intersection| >= percent * |union| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(s) * 100 < percent * len(t) or len(t) * 100 < percent * len(s):
                    keep.append(False)
                    continue
                both = np.concatenate((s, t))
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def compare_blocks(least: float, percent: int):
    """Rows sorted by block: (block, k, side, c, comp, n, regs, sets) -> confirmed links between different components.

    Side 0 holds the block's members, side 1 those that are to be compared with them. A pair that meets in several bands is
    looked at in the first only. Estimates go first; what passes is confirmed on the full sets, best estimates first, and
    members that a confirmed link has joined meanwhile are not compared any more. So a block yields fewer links than it has
    members, however many of its pairs are similar.
    """

    def block(rows: list[tuple]) -> tuple[list[int], list[int]]:
        k, side, c, comp, n, regs = (np.concatenate(x) for x in list(zip(*rows, strict=True))[:6])
        sets = [s for r in rows for s in r[6]]
        band = int(k[0]) & 31
        comp = np.unique(comp, return_inverse=True)[1]
        m, u = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = [], []
        for i in u:
            cand = m[comp[m] != comp[i]]
            if not len(cand):
                continue
            eq = regs[cand] == regs[i]
            est = estimate(eq.sum(axis=1), n[cand], np.full(len(cand), n[i]))
            good = np.flatnonzero(est >= least)
            good = good[eq[good].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            todo = cand[good[np.argsort(-est[good], kind="stable")]]
            own = np.frombuffer(sets[i], np.uint64)
            take = 8
            while len(todo):
                head, todo = todo[:take], todo[take:]
                take *= 4
                flat = np.frombuffer(b"".join(sets[j] for j in head), np.uint64)
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                inter = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(n[head]) - n[head])
                hit = head[100 * inter >= percent * (len(own) + n[head] - inter)]
                for j in hit:
                    if comp[j] != comp[i]:
                        left.append(min(int(c[i]), int(c[j])))
                        right.append(max(int(c[i]), int(c[j])))
                        comp[comp == comp[j]] = comp[i]
                todo = todo[comp[todo] != comp[i]]
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            x, y = block(rows)
            rows.clear()
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)] + [_regs(batch.column(6)), batch.column(7).to_pylist()]
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if rows and key[s] != current:
                    yield from done()
                current = key[s]
                rows.append(tuple(x[s:e] for x in cols))
        if rows:
            yield from done()

    return run


# ---------------------------------------------------------------- components


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(a, b) -> (c, comp): comp is the smallest node reachable from c; only nodes with an edge are returned.

    Smallest-label propagation with pointer jumping. Each round is written to the shared folder, which cuts lineage; labels
    reach a node through a map-side minimum and joins are dealt, so that neither a node with very many links nor a component
    of very many nodes is a hot spot.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, f"{name}-links", folder)
    labels = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("comp"), F.lit(True).alias("moved"))
    labels = materialise(labels, f"{name}-0", folder)
    turn, moved = 0, not labels.isEmpty()
    while moved:
        near = spread(both, labels.select(F.col("c").alias("b"), "comp"), "b").select(F.col("a").alias("c"), "comp", F.lit(None).cast("long").alias("old"))
        low = near.union(labels.select("c", "comp", F.col("comp").alias("old"))).groupBy("c").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        to = labels.select(F.col("c").alias("comp"), F.col("comp").alias("jump"))
        turn += 1
        new = spread(low, to, "comp", "left").select("c", F.least("comp", F.coalesce("jump", "comp")).alias("comp"), "old")
        new = materialise(new.select("c", "comp", (F.col("comp") != F.col("old")).alias("moved")), f"{name}-{turn}", folder)
        moved = not new.where("moved").isEmpty()
        discard(spark, f"{folder}/{name}-{turn - 1}")
        labels = new
    discard(spark, f"{folder}/{name}-links")
    return labels.select("c", "comp")


# ---------------------------------------------------------------- the operator


def near_duplicates(documents: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    Two documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of distinct `shingle`-word shingles
    (words are split at ASCII white space, A-Z lower-cased; fewer words than that form one shingle). component_id is the
    smallest doc_id that links reach, kept is doc_id = component_id, class_id names the set itself (equal sets, equal id).

    Null, empty and white-space texts have no shingles, are linked with nothing and are kept. Rows that repeat a doc_id are
    judged row by row on their own text. A row without doc_id joins the rows of equal set, if these have an id; sets of such
    rows alone are linked with nothing, and their component_id is null. An empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sig = materialise(docs.mapInArrow(signature_rows(shingle, False), f"doc_id {id_type}, n long, c long, regs binary"), "sig", folder)
    # equal sets: one class; registers follow from the set, so any row's will do
    classes = sig.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("rows"))
    classes = materialise(classes, "classes", folder)
    bands = classes.select("c", "regs").mapInArrow(band_rows, "k long, c long")
    bands = materialise(bands, "bands", folder)
    # buckets of several classes, and the leader of each
    shared = bands.groupBy("k").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("c", "k").alias("o"), F.col("c").alias("c"))).alias("l"))
    shared = materialise(shared.where("size > 1").select("k", F.col("l.c").alias("lead")), "shared", folder)
    rows = materialise(merged(bands, shared, "k"), "rows", folder)
    least = floor_estimate(percent / 100)
    info = classes.select("c", "n", "regs", "rep")

    def side(x: str) -> DataFrame:
        return info.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("rep").alias(f"d{x}"))

    def full_sets(reps: DataFrame, name: str) -> DataFrame:
        """(c, sets) of the classes that the documents named in reps have, recomputed from their texts."""
        texts = merged(docs, reps.where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
        sets = texts.mapInArrow(signature_rows(shingle, True), f"doc_id {id_type}, n long, c long, sets binary")
        return materialise(sets.where("n > 0").groupBy("c").agg(F.first("sets").alias("sets")), f"sets-{name}", folder)

    # 1. every member against its bucket's leader
    met = rows.where("c <> lead")
    pairs = met.select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct()
    pairs = merged(merged(pairs, side("a"), "a"), side("b"), "b").select("a", "b", "na", "nb", "ra", "rb", "da", "db")
    pairs = materialise(pairs.mapInArrow(estimate_pairs(least), f"a long, b long, da {id_type}, db {id_type}"), "pairs-1", folder)
    sets = full_sets(pairs.select(F.explode(F.array("da", "db")).alias("doc_id")), "1")
    one = sets.select(F.col("c").alias("a"), F.col("sets").alias("sa"))
    two = sets.select(F.col("c").alias("b"), F.col("sets").alias("sb"))
    full = merged(merged(pairs.select("a", "b"), one, "a"), two, "b").select("a", "b", "sa", "sb")
    links = materialise(full.mapInArrow(confirm_pairs(percent), "a long, b long"), "links-1", folder)
    label = components(links, folder, "comp-1")

    # 2. members of different components that still share a bucket
    tagged = merged(rows.select("k", "c"), label, "c", "left").select("k", "c", F.coalesce("comp", "c").alias("comp"))
    tagged = materialise(tagged, "tagged", folder)
    part = tagged.groupBy("k", "comp").agg(F.count("*").alias("m"))
    part = part.groupBy("k").agg(F.count("*").alias("parts"), F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("top"))
    # in a bucket of two, or where one leader has met everyone apart, the only pair is settled already
    part = part.where("parts > 1 AND size > 2").select(
        "k", F.col("top.comp").alias("main"), F.ceil(F.col("size") / BLOCK).alias("gm"), F.ceil((F.col("size") - F.col("top.m")) / BLOCK).alias("gu")
    )
    part = materialise(part, "parts", folder)
    if not part.isEmpty():
        open_rows = materialise(merged(tagged, part, "k"), "open", folder)
        spot = F.pmod(F.xxhash64("c"), F.lit(1 << 40))

        def cells_of(rows: DataFrame, mark: int, i, j) -> DataFrame:
            return rows.select("k", "c", "comp", F.lit(mark).alias("side"), i.alias("i"), j.alias("j"))

        def all_of(g: str):
            return F.sequence(F.lit(0).cast("long"), F.col(g) - 1)

        # a bucket's members and others in a grid of cells of at most BLOCK of each
        members = cells_of(open_rows, 0, F.array(F.pmod(spot, F.col("gm"))), all_of("gu"))
        others = cells_of(open_rows.where("comp <> main"), 1, all_of("gm"), F.array(F.pmod(spot, F.col("gu"))))
        cells = members.union(others).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
        few = merged(open_rows.select("c").distinct(), info, "c")
        few = materialise(few, "few", folder)
        sets = full_sets(few.select(F.col("rep").alias("doc_id")), "2")
        cells = merged(cells, merged(few.drop("rep"), sets, "c"), "c")
        cells = cells.select(F.xxhash64("k", "i", "j").alias("block"), "k", "side", "c", "comp", "n", "regs", "sets")
        cells = cells.repartition("block").sortWithinPartitions("block", "k")
        more = materialise(cells.mapInArrow(compare_blocks(least, percent), "a long, b long"), "links-2", folder)
        if not more.isEmpty():
            label = components(links.union(more), folder, "comp-2")

    # classes back to documents
    linked = materialise(merged(label, classes.select("c", "rep"), "c"), "linked", folder)
    smallest = linked.groupBy("comp").agg(F.min("rep").alias("low"))
    linked = materialise(spread(linked, smallest, "comp").select("c", "low"), "low", folder)
    of_class = merged(classes.select("c", "rep", "rows"), linked, "c", "left").select("c", "rows", F.coalesce("low", "rep").alias("component_id"))
    of_class = materialise(of_class, "of-class", folder)
    # no more than 2 ** 17 classes can have so many rows: these are broadcast, all others are joined
    total = of_class.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    often = of_class.where(F.col("rows") > max(HOT_ROWS, total >> 17)).select("c", F.col("component_id").alias("known"))
    out = sig.select("doc_id", "n", F.when(F.col("n") > 0, F.col("c")).alias("class_id"), "c").join(F.broadcast(often), "c", "left")
    # rows that need no class get keys of their own, so that they do not meet in one task
    key = F.when((F.col("n") > 0) & F.col("known").isNull(), F.col("c")).otherwise(F.xxhash64("doc_id"))
    out = merged(out.withColumn("c", key), of_class.select("c", "component_id"), "c", "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("known", "component_id")))
    cid = F.coalesce("component_id", "doc_id")
    gone = ("bands", "shared", "rows", "tagged", "parts", "open", "few", "pairs-1", "sets-1", "sets-2", "links-1", "links-2", "linked", "low", "classes")
    discard(spark, *(f"{folder}/{x}" for x in gone))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))
