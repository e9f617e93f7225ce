"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read_table
from .decontam import find_contamination
from .langid import identify_language
from .mixing import pareto_mix
from .near_dup import near_duplicates
from .oracles import EMBEDDINGS, MIX, NEAR_DUPLICATES, WARC
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .quality import score_quality, train_quality
from .rp_forest import embedding_near_duplicates
from .secrets import scan_secrets
from .token_planes import read_token_planes, write_token_planes
from .url_filter import filter_urls
from .warc import normalise_archives, read_warc, write_warc
from .whitening import whiten


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict = {}
#: The others learn from samples, tile, or write files in formats that SQL cannot read; tests hold them against brute force.
ORACLES: dict = {"op2_warc_normaliser": WARC, "op3_rp_forest": EMBEDDINGS, "op5_pareto_mix": MIX, "op6_bottom_k_near_dup": NEAR_DUPLICATES}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op6_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


@query
def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_planes(write_token_planes(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


@query
def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(normalise_archives(write_warc(read_table(spark, sf_dir, "pages"))))


@query
def op8_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query
def op7_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


@query
def op4_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


@query
def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_masked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # The contract's texts: in every tenth document the words from a place on repeat.
    words = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("g", F.floor(F.col("h") / 10))
    words = words.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("w")
    a = F.when(n > 0, F.col("g") % n).otherwise(0).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    words = words.withColumn("a", a).withColumn("p", p)
    tail = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    texts = words.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(texts, least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@query
def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(read_table(spark, sf_dir, "embeddings"), components=8)
    each = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


@query
def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
