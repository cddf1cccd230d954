"""What several operators of this folder share: words, hashes, scratch tables, label samples."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: exactly space and \t \n \v \f \r, the set that bytes.split() uses.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: Entries that a worker's word table holds before it starts afresh (about 170 bytes each).
WORD_TABLE = 160_000

#: Bytes of text that are turned into words at once.
SLICE_BYTES = 1_500_000


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one for a local master; an error otherwise,
    as executors elsewhere would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tracewarden-scratch")
    return f"{base.rstrip('/')}/tracewarden-{uuid.uuid4().hex}"


#: Spark's setting that lets the shuffle files of a query go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go when they end."""
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, was)


def materialise(df: DataFrame, name: str, folder: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder (in folders by a column, if one is given) and read it back: cuts lineage,
    survives lost executors. Once it is written nothing reads the shuffle files behind it, so they go at once."""
    path = f"{folder}/{name}"
    with clean_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: by sorting, never by a broadcast, whose build would land on the driver."""
    return left.join(right.hint("merge"), on, how)


def spread(left: DataFrame, right: DataFrame, on: str, how: str = "inner", parts: int = 8) -> DataFrame:
    """merged() where a key may have very many rows on the left and has one at most on the right: the left's rows are dealt to
    parts tasks a key, and the right's rows are repeated for each."""
    deal = F.pmod(F.xxhash64(*left.columns), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    return merged(left.withColumn("_deal", deal), right.withColumn("_deal", every), [on, "_deal"], how).drop("_deal")


def free_prefix(columns: list[str]) -> str:
    """A prefix with which no column begins, in either case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the caller's own PYTHONPATH lacks it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "") or os.environ.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)


# ---------------------------------------------------------------- splits and samples


def id_remainder(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def one_label(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id, y: an id labelled twice counts once, with its largest label; learn is a condition on doc_id."""
    return (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, learn: Column, seed: int = 11) -> DataFrame:
    """All labelled rows for training: (text, y, point), in no order; point is a hash of id and text, which deals and orders
    them."""
    rows = merged(documents.select("doc_id", "text").where(learn), one_label(labels, label, learn), "doc_id")
    return rows.select("text", "y", F.xxhash64("doc_id", "text", F.lit(seed)).alias("point"))


def label_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, seed: int = 11, text_bytes: int | None = None) -> DataFrame:
    """Labelled rows for training: (text, y, point), at most per_class of each class, in no order; point orders them.

    The bound holds for fitting only; learn is a condition on doc_id. Classes are first thinned by a hash of the id with a
    fraction taken from exact class counts, so that few labels are left, which are broadcast (1.5 * per_class of a class,
    about). Rows are then bounded, as an id may have many: those with the smallest hashes of id and text stay. Texts of more
    than text_bytes are not learnt from, if that is given. An id labelled twice counts once, with its largest label.
    """
    lab = one_label(labels, label, learn)
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for y in (0, 1):
        keep = keep | ((F.col("y") == y) & (chance < min(1.0, 1.5 * per_class / max(1, counts.get(y, 0)))))
    rows = documents.select("doc_id", "text")
    if text_bytes is not None:
        rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    rows = rows.join(F.broadcast(lab.where(keep)), "doc_id").select("text", "y", F.xxhash64("doc_id", "text", F.lit(seed)).alias("point"))
    of = [rows.where(F.col("y") == y).orderBy("point").limit(per_class) for y in (0, 1)]
    return of[0].unionByName(of[1])


# ---------------------------------------------------------------- words as 64-bit hashes


class WordTable(dict):
    """bytes of a word -> 64-bit hash, filled as words come and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(words: list[bytes], table: WordTable) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes each, at least one text."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    return mix(out)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
