"""The corpus pipeline: five operators in a row over `documents`.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and gives a table that is written as
Parquet and read again as the next stage's docs. All but the last give the columns of documents.

ORACLE_SQL is None: learned scores and hashed fingerprints have no SQL form. tests/llm hold the run against a
version of the stages in plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, lines, packing, quality, resemblance
from kindred.llm import shared as S
from kindred.llm.queries import END_ID, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).withColumn("_score", quality.score(F.col("text"), model)).where(F.col("_score") >= 0.7).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; n_chars follows the text."""
    out = lines.drop_shared_lines(docs.select(*COLUMNS), min_docs=10)
    return out.withColumn("text", F.col("_lines.kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a resemblance of 0.8 of five-word shingles) the document of smallest id. Rows
    that share an id stay or go together, a null id stays."""
    groups = resemblance.near_copies(docs, words=5, similarity=0.8)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none of which tiles of five words or more cover 0.8."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), tile=5, coverage=0.8).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the Hilbert curve."""
    return packing.pack(docs, tokenizer_path(), END_ID, 4096)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = S.stage_table(docs, f"pipeline-{name}")
    return docs
