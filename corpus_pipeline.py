"""From raw documents to packed training sequences: five stages, each one of the operators of ``millrace.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Between stages the
rows are written as Parquet to the shared folder and read again, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import shared_folder
from millrace.llm import neardup, packing, rules, secrets, suffixes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return rules.keep_good(docs)


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The same columns with another text, and ``n_chars`` of that."""
    new = docs.withColumn("text", text)
    return new.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else new


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return neardup.keep_first(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than 50 words, or of 400 bytes, that occur more than once; those
    with nothing left go."""
    cut = suffixes.remove_repeats(docs, out="_repeats", with_text=True, words=51)
    removed, kept = F.col("_repeats.n_removed") > 0, F.col("_repeats.kept")
    left = cut.where(~removed | (F.btrim(kept, F.lit(rules.WHITE)) != ""))
    return with_text(left, F.when(removed, kept).otherwise(F.col("text"))).select(*docs.columns)


def hidden_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark of its kind."""
    found = secrets.scan(docs, "text", out="_secrets", redact=lambda kind: f"[{kind} removed]")
    return with_text(found, F.col("_secrets.redacted")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences, with their token ids."""
    return packing.pack(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", hidden_secrets),
    ("best-fit packing", pack),
]

#: Near copies, suffix arrays, Markov models and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
