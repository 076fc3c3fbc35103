"""A training-data pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, benchmark
decontamination, and mixing of sources. Each stage works on what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import write_table
from provena.llm.decontaminate import contamination
from provena.llm.line_dedup import dedup_lines
from provena.llm.mixing import mix_sources
from provena.llm.near_duplicates import keep_one_of_each_group, near_duplicates
from provena.llm.quality import quality_rules

#: SQL can't express the hashed permutations of the mixing stage; tests hold the stages against brute force.
ORACLE_SQL = None


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars that of the new text."""
    return out.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without over-frequent lines."""
    return _as_documents(quality_rules(docs).where("kept"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; those of which nothing is left but blanks go."""
    out = dedup_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _as_documents(out.where(left), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id."""
    return keep_one_of_each_group(docs, near_duplicates(docs.select("doc_id", "text")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _as_documents(out.where(~F.col("contaminated")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as drawn under the source weights: their columns and the epoch, block and order of each draw."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
