"""The corpus pipeline: language ID, quality rules, exact dedup, SimHash near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import exact, langid, nearcopies, packing, quality
from docspark.llm.common import apart, stage, table, tokenizer

POLICY, END_ID, WINDOW = "v1", 1, 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter go."""
    plain, names = apart(docs)
    found = langid.predict(plain, langid.training_sample(docs), names["text"], tuple(names.values()))
    return found.filter(F.col("lang_pred") != "und").select(*names.values()).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality.keep_good(docs, quality.POLICIES[POLICY])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact.keep_one(docs, exact.DigestIndex(spark))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, Jaccard similarity 0.8 or more), the one with the smallest doc_id."""
    return nearcopies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    return packing.pieces(docs, tokenizer(), END_ID, WINDOW)


STAGES = [("language_id", language), ("quality_rules", rules), ("exact_dedup", exact_copies), ("simhash", near_copies), ("packing", packed)]
#: SQL cannot express automata, SimHash and BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
