"""The corpus pipeline: quality rules, near-duplicates, secret scans and packing, one after another over documents.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all but the last return the columns
of documents.

Defined cases: a null or repeated doc_id is no key anywhere: verdicts are computed beside rows or joined by written row numbers, and
of near copies with equal or null ids the first row stays. Null and empty texts fail the quality rules; after them every text has
words, is worked on whole, however long, and repeated rows are near copies. Empty tables give empty tables. Extra columns, whatever
their names, are carried along by all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import near_dups, packing, quality, secrets, tokens
from attestra.llm.common import materialize, named, unused
from attestra.session import ship_package

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality.quality_filter(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; texts without words are groups of their own."""
    ship_package(spark)
    row = unused(docs.columns, "row_number")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_dups.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = rows.select(F.col(row).alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"))
    first = ids.join(groups, "row").groupBy("group").agg(F.min(F.struct("key", "row")).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(first, row, "left_semi").select(*[named(rows, c) for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported secret replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into windows of 1024."""
    ship_package(spark)
    return packing.pack(docs, tokens.vocabulary_path(), 1024, with_ids=False)


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_dup_stage), ("secret_scans", secret_stage), ("packing", packing_stage)]
#: Near-duplicates and packing have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
