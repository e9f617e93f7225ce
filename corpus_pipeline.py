"""A training corpus from documents: quality, near-duplicates, benchmark passages, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamlanes.llm.common import WORD, Workspace, read_table, unused_name
from streamlanes.llm.decontam import drop_contaminated
from streamlanes.llm.mixing import pareto_mix
from streamlanes.llm.near_dup import near_duplicates
from streamlanes.llm.quality import keep_good, train_quality
from streamlanes.llm.registry import vocabulary
from streamlanes.llm.token_planes import read_token_planes, write_token_planes

#: Documents whose five-word shingle sets have a Jaccard similarity of so many hundredths or more are near-duplicates.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of these documents.

    Null and empty texts are scored as one passage without characters, very long ones by all passages; a score of
    exactly 0.5 stays; repeated rows stay or go together; null ids are not learnt from but judged. An empty table gives
    an empty table, and a table without labels of both kinds loses nothing. Columns may have any names. Texts pass the
    classifier in short batches, as they are in memory on both sides of it.
    """
    kept = keep_good(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))
    return Workspace(spark, "quality").stage(kept, "kept", batch_rows=1000)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, once.

    Documents without an id, or with a null or empty text, are in no group and stay. Of rows that share an id one
    stays, with the smallest hash of its text; among equal rows it is no matter which. Texts of any length are compared
    whole. An empty table gives an empty table. Columns may have any names.
    """
    gone = near_duplicates(docs, percent=NEAR_PERCENT).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = docs.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        nth = unused_name(docs, "nth_row")
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
        once = kept.join(twice, "doc_id", "left_semi").withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts contain none and stay; texts of any length are tiled whole; repeated rows stay or go together;
    ids are not read. Empty tables lose nothing. Columns may have any names.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document it does not take goes.

    Null and empty texts have no words and go. Rows that are alike in id, source and size share their copies out evenly,
    in the order of their texts' hashes; ids and sources may be null. Texts of any length are taken whole. An empty
    table gives an empty table. Columns may have any names.
    """
    key = ("doc_id", "source", "size")
    taken = pareto_mix(docs).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    size, copies, rows, nth, each = (unused_name(docs, n) for n in ("mix_size", "mix_copies", "mix_rows", "mix_nth", "mix_each"))
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    a, b = sized.alias("a"), taken.select("doc_id", "source", "size", F.col("copies").alias(copies), F.col("rows").alias(rows)).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col(f"a.{size}") == F.col("b.size"))
    joined = a.join(b, same).select("a.*", copies, rows)
    place = F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text")))
    share = (F.expr(f"{copies} div {rows}") + F.when(F.col(nth) <= F.expr(f"{copies} % {rows}"), 1).otherwise(0)).cast("int")
    return joined.withColumn(nth, place).withColumn(each, F.explode(F.array_repeat(F.lit(0), share))).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files in id order and read back.

    A null or empty text has the end's id alone. Null ids come first; repeated rows and ties in id are in any order
    among themselves. Texts of any length are encoded whole. An empty table gives an empty table. Columns may have any
    names; only id and text are read.
    """
    return read_token_planes(write_token_planes(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("mixing", mix), ("token_files", token_files)]

#: Training, sketches and a tokenizer cannot be put into SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to shared storage and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
