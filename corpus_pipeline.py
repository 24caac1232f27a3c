"""A corpus from documents to token ids: reject toxic texts, keep one of each near-duplicate group, drop benchmark
copies, mix sources to their weights, write token ids. Each stage sees all that the stage before kept.

All stages read doc_id, text and source whole, keep null and empty texts unless they say otherwise, take very long texts
whole, give an empty table for an empty one, and pass other columns through untouched, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diffquarry.llm import decontaminate, mixing, simhash, token_store, toxicity
from diffquarry.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7 by a model of the labelled rows that aren't held out. Equal texts score alike; without
    labels of both kinds nothing is rejected."""
    return toxicity.reject(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of SimHash near-duplicates. Rows with a null doc_id stay; rows that repeat
    the smallest doc_id all stay. Texts without words are one group."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth lies in windows of benchmark items; equal texts share their fate, and an empty
    benchmark drops nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them, twice at most. Rows without words don't occur; a null source is a source."""
    return mixing.copies(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the ORC files. Null doc_ids come first; repeated
    rows are each written."""
    return token_store.with_crc(token_store.store(docs, token_store.vocabulary()))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
