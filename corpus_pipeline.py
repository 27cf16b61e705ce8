"""A corpus pipeline over documents: quality rules, near duplicates, secrets, source mix, SentencePiece ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm import parity_join, piece_codec, quality_rules, secret_scan, source_mix, tokenizer_files
from veilsift.llm.queries import piece_digests
from veilsift.llm.staging import stage
from veilsift.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more of their 5-word shingles, the one with the smallest id stays, rows
    without an id last. Rows that share an id, or have none, are told apart by two hashes of all their columns; rows that
    agree in every column become one.
    """
    ship(spark)
    keyed = docs.withColumn("_h1", F.xxhash64(*docs.columns)).withColumn("_h2", F.xxhash64(F.lit(1), *docs.columns))
    row = F.struct(F.col("doc_id").isNull().alias("lacks"), F.col("doc_id").alias("id"), "_h1", "_h2")
    groups = parity_join.similar_groups(keyed.withColumn("_row", row), n=5, num=80, den=100, key="_row")
    first = groups.filter(F.col("_row").eqNullSafe(F.col("component_id"))).select("_row._h1", "_row._h2")
    return keyed.join(first.hint("merge"), ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in angle brackets; n_chars follows."""
    ship(spark)
    return secret_scan.redact(docs, "text", "n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids, the decoded text and the pieces' byte spans."""
    ship(spark)
    return piece_digests(piece_codec.encode(docs, tokenizer_files.path("piece_bpe_32k.model"), "text", ["doc_id"]), "doc_id")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secrets),
    ("source_mix", mixture),
    ("sentencepiece", pieces),
]

#: SQL has no SentencePiece encoder; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
