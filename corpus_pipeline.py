"""A corpus pipeline: quality, near-duplicates, benchmark contamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and hands what it reads back to the next.

All stages take an empty table (no rows come out), nulls in any column, empty and very long texts, ties and
repeated rows; but for the last one they return the input's columns as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefloom.llm import base, decontam, mixing, neardup, quality, tokens


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the classifier of ``labels`` rejects. Null and empty texts have the share of good labels as score."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the least doc_id's. Rows without a doc_id stay, and so do wordless texts."""
    return neardup.deduplicated(docs, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts of which ``benchmark`` items hold a twentieth or more. Null and wordless texts stay."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its Poisson count, in the global order of hashes. A null source is a source of its own."""
    return mixing.mixture(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row from its token files. Null texts have the end id alone."""
    return tokens.token_table(docs)


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: No SQL tells what neighbours vote or how a tokenizer cuts; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = base.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
