"""Reading the tables of a scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "rules scan_reports scan_results findings decoded_content raw_reports rule_records documents seen_hashes "
    "watch_phrases eval_items reading_labels region nation customer supplier part orders lineitem events embeddings"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temporary view, for SQL over the raw data."""
    for name in TABLES:
        try:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        except Exception:  # a table may be missing in a directory of the user's own
            continue
