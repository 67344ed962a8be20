"""A training corpus from ``documents``, in five stages; each works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, language, near_dup, packing, secrets
from skein.llm.common import documents, settle, shared_dir, tokenizer_path


def _whole(docs: DataFrame) -> DataFrame:
    """The text of each row beside the row itself, so that no column of the documents meets one that an operator adds."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a text without a letter or near none of the languages goes.

    Null and empty texts go; repeated rows stay or go together. If nothing is labelled, all go. An empty table stays empty.
    """
    found = language.identify(_whole(docs), language.train(docs), keep=["doc"])
    return found.where(~F.col("rejected")).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five words and a similarity of 0.8: that of the smallest doc_id.

    A doc_id stays if any of its rows does, with all its rows; rows without doc_id and documents without
    words stay. An empty table stays empty.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have none and stay; repeated rows stay or go together. An empty benchmark or table changes nothing.
    """
    found = decontaminate.hits(_whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc"], unnamed=True)
    return found.where(F.col("n_hit") == 0).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret.

    Null and empty texts have none and stay; all rows of a text stay or go together. An empty table stays empty.
    """
    found = secrets.scan(docs.select("doc_id", "text"), f"{shared_dir(spark)}/ledger").where(F.size("spans") > 0)
    held = found.select("blob").distinct()
    rows = _whole(docs).withColumn("named", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.join(held, F.col("named") == F.col("blob"), "left_anti").select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens.

    A null or empty text is its end id alone; rows that repeat a doc_id are documents of their own. An empty table stays empty.
    """
    found = settle(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), packing.END, special=True))
    return packing.packed(found).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the language model nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
