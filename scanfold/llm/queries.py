"""The queries p2, p6, p7, p8 and p9 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm import encoding, leaks, level, lookalike, redaction


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").select("finding_id", "snippet", F.coalesce("location.file", "path").alias("file"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every credential in a snippet."""
    found = redaction.find_credentials(_snippets(spark, d), "finding_id", "snippet", "file")
    return found.select("finding_id", "secret").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered snippet with its credentials masked."""
    return redaction.redact(_snippets(spark, d), "finding_id", "snippet", "file")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Snippets and decoded texts as one table (kind, row_id, text)."""
    snippets = table(spark, d, "findings").select(F.lit("snippet").alias("kind"), F.col("finding_id").alias("row_id"), F.col("snippet").alias("text"))
    decoded = table(spark, d, "decoded_content").select(F.lit("decoded").alias("kind"), F.col("decoded_id").alias("row_id"), F.col("decoded").alias("text"))
    return snippets.unionByName(decoded)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that show a watch phrase in other characters than its own."""
    phrases = table(spark, d, "watch_phrases")
    rows = _shown(spark, d).select(F.concat_ws(":", "kind", "row_id").alias("key"), "text").where(F.col("key").contains(":"))
    found = lookalike.disguised_phrases(rows, "key", "text", phrases, "phrase_id", "phrase")
    part = F.split("key", ":")
    return found.select(part[0].alias("kind"), part[1].cast("long").alias("row_id"), "phrase_id")


def p6_one_form(spark: SparkSession, d: str) -> DataFrame:
    """All snippets and decoded texts in their one form."""
    rows = _shown(spark, d).select(F.struct("kind", "row_id").alias("key"), "text")
    return lookalike.one_form(rows.select(F.concat_ws(":", "key.kind", "key.row_id").alias("key"), "text"), "key", "text").select(
        F.split("key", ":")[0].alias("kind"), F.get(F.split("key", ":"), F.lit(1)).cast("long").alias("row_id"), "text"
    )


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of byte_bpe_50k for each document."""
    return encoding.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document that leaks evaluation items, and the items."""
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document with English prose, and its reading level."""
    return level.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), "doc_id", "text", "level")


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p6_found, p6_one_form, p7_ids, p8_found, p9_found)}
