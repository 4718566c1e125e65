"""Training-corpus pipeline: each stage's result is written as Parquet and read as the next one's
documents. All stages but the last return the columns of documents.

Cases, in every stage: rows with null ids, sources or languages stay rows of their own; null and empty texts fail the quality rules and go
in the first stage (a later stage keeps them, as they hold no line, shingle or benchmark window to go by); repeated rows
are judged alike, and near-dedup keeps one of them; texts of any length are read whole; further columns pass through
all stages but the last; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import decontam, line_dedup, mixing, neardup, quality_rules
from loanlens.llm import queries as Q
from loanlens.llm.tables import cut, read_documents

NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id."""
    return neardup.keep_first(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of the benchmark go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage),
          ("benchmark decontamination", benchmark_stage), ("mixing sources to target weights", mixing_stage)]

ORACLE_SQL = f"""
WITH s1 AS MATERIALIZED (SELECT documents.* FROM documents JOIN ({Q.ORACLE['op3_quality_rules']}) USING (doc_id) WHERE kept),
s2 AS MATERIALIZED (SELECT s1.doc_id, s1.source, x.text FROM s1 JOIN ({Q.line_dedup_sql('s1', "coalesce(kept, '') AS text")}) x USING (doc_id)),
s3 AS MATERIALIZED (SELECT s2.* FROM s2 JOIN ({Q.near_sql('s2', NEAR_SHINGLE, NEAR_PERCENT)}) USING (doc_id) WHERE kept),
s4 AS MATERIALIZED (SELECT s3.* FROM s3 JOIN ({Q.decontam_sql('s3')}) USING (doc_id) WHERE NOT contaminated)
{Q.mixing_sql('s4', 'doc_id, source, size, source_size, target, CAST(e AS BIGINT) AS epochs')}
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
