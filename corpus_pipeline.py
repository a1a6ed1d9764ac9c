"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. A stage deletes its scratch tables itself, but for one with a few numbers a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, common, line_dedup, minhash, mixing, quality_rules
from spanloom.llm.queries import tokenizers


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, or nearly stand, in an earlier place; n_chars follows the text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_first(docs, 5, 80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of ids and decoded bytes, and the ids."""
    public = tokenizers()
    return bpe.bpe_codec(docs, bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN, keep=True).drop("decoded")


STAGES = [("quality_rules", good_documents), ("line_dedup", fresh_lines), ("near_dedup", one_of_each), ("mixing", mixed), ("bpe", tokens)]

#: Copies, links and merges have no practical SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        here = common.Scratch(spark, f"pipeline_{name}")
        docs = here.written(stage(spark, docs, sf_dir))
        if before:
            before.free()
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)
