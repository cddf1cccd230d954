"""Training-data pipeline over `documents`: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes every stage's rows as
Parquet into the shared folder and reads them back for the next, so that a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import discard, materialise, merged, scratch_dir
from tracewarden.llm.decontamination import find_leaks
from tracewarden.llm.near_dedup import near_duplicates
from tracewarden.llm.packing import pack
from tracewarden.llm.quality_classifier import fit_quality, keep_good
from tracewarden.llm.queries import tokenizer_file
from tracewarden.llm.substring_dedup import remove_repeats


class Rows:
    """A stage's documents under names of its own, so that no extra column can clash, and row_key, by which verdicts find their
    rows again: doc_id, or where ids repeat, that and the row's hashes, so that rows of one id are judged apart. Rows without
    doc_id have no key; only equal rows share one. With by_text, the key is 128 bits of hashes of the text alone."""

    def __init__(self, docs: DataFrame, by_text: bool = False):
        self.names = docs.columns
        self.own = [f"c{i}" for i in range(len(self.names))]
        self.id, self.text = (self.own[self.names.index(x)] for x in ("doc_id", "text"))
        rows = docs.toDF(*self.own)
        if by_text:
            text = F.col(self.text)
            self.table = rows.withColumn("row_key", F.struct(F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u")))
            return
        held = rows.where(F.col(self.id).isNotNull())
        self.repeats = not held.groupBy(self.id).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        key = F.col(self.id)
        if self.repeats:
            whole = F.xxhash64(*self.own, *(F.col(c).isNull() for c in self.own))
            key = F.when(key.isNotNull(), F.struct(key.alias("i"), F.xxhash64(self.text).alias("t"), whole.alias("r")))
        self.table = rows.withColumn("row_key", key)

    def texts(self) -> DataFrame:
        return self.table.select(F.col("row_key").alias("doc_id"), F.col(self.text).alias("text"))

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.own).toDF(*self.names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on `labels`, scores as good.

    Null and empty texts are judged as texts without words; rows are judged one by one, repeated ones alike; extra columns
    of any name are kept; an empty table stays empty; with too few labels all rows get one verdict.
    """
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and one of equal rows of one id.

    Texts that are null, empty or white space, and rows without doc_id that equal no row with one, stay; rows that share an
    id but differ are judged apart; extra columns of any name are kept; an empty table stays empty.
    """
    rows = Rows(docs)
    if rows.repeats:
        one = rows.table.where("row_key IS NOT NULL").dropDuplicates()
        rows.table = materialise(one.unionByName(rows.table.where("row_key IS NULL")), "rows", scratch_dir(spark))
    gone = near_duplicates(rows.texts(), percent=80, shingle=5).where("NOT kept").select(F.col("doc_id").alias("row_key"))
    return rows.named(rows.table.join(gone, "row_key", "left_anti"))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 13-word passages that start in an earlier document; texts left without a word go.

    Null, empty and short texts stay as they are, as do texts without such passages and rows without doc_id; where rows
    repeat an id, each loses its own passages; equal rows lose the same; extra columns of any name are kept; an empty table
    stays empty. n_chars, where there is such a column, follows the text.
    """
    rows = Rows(docs)
    out = rows.table.withColumnsRenamed({"row_key": "doc_id"}).withColumn("text", F.col(rows.text))
    out = remove_repeats(out, window=13, carry=[c for c in rows.own if c != rows.text], one_space=False)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    new = {rows.text: F.col("kept_text")}
    if "n_chars" in rows.names:
        n = rows.own[rows.names.index("n_chars")]
        new[n] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType)
    return rows.named(out.select(*[new.get(c, F.col(c)).alias(c) for c in rows.own]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was verified.

    The verdict is on a text, whatever its row, so rows that repeat an id are judged apart and rows without doc_id as well;
    null and empty texts stay; extra columns of any name are kept; an empty table or benchmark removes nothing.
    """
    rows = Rows(docs, by_text=True)
    leaks = find_leaks(rows.texts(), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("row_key"))
    return rows.named(rows.table.join(leaks.distinct(), "row_key", "left_anti"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in sequences of at most 2048 tokens.

    Null and empty texts are the end token alone; repeated rows and rows without doc_id are packed one by one; extra columns
    are left out; an empty table gives an empty result.
    """
    return pack(docs, tokenizer_file(), limit=2048, end_id=0, with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Not expressible in SQL (a learnt model, set similarity and packing); tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name, folder)
        if last:
            discard(spark, f"{folder}/{last}")
        last = name
    return docs
