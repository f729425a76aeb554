"""Trust decisions, baselines and cached results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.session import remove, small

KIND_KEYS = {"skill": "skill", "mcp_server": "mcp", "plugin": "plugin", "npm_package": "npm", "rust_crate": "crate"}


def trust_key(kind: Column, name: Column) -> Column:
    short = F.lit(None).cast("string")
    for k, v in KIND_KEYS.items():
        short = F.when(kind == k, v).otherwise(short)
    return F.concat(short, F.lit(":"), name)


def apply_trust(findings: DataFrame, trust: DataFrame, component_key: str, component_hash: str, rule: str) -> DataFrame:
    """``findings`` with ``suppressed_by``: the key of a trust entry of the same component hash that accepts the rule.

    An entry of level ``full`` accepts every rule, one of level ``accepted`` those it lists, or all if it lists none;
    others accept none. An entry for other contents, or none, leaves the finding as it is.
    """
    t = small(trust.where(F.col("level").isin("full", "accepted")).dropDuplicates(["key"]).select(F.col("key").alias("__key"), F.col("component_hash").alias("__hash"), F.col("level").alias("__level"), F.col("accepted_rules").alias("__rules")))
    j = findings.join(t, (F.col(component_key) == F.col("__key")) & (F.col(component_hash) == F.col("__hash")), "left")
    takes = (F.col("__level") == "full") | (F.coalesce(F.size("__rules"), F.lit(0)) <= 0) | F.array_contains("__rules", F.col(rule))
    return j.withColumn("suppressed_by", F.when(F.col("__key").isNotNull() & F.coalesce(takes, F.lit(False)), F.col("__key"))).drop("__key", "__hash", "__level", "__rules")


def quarantine(files: DataFrame, trust: DataFrame, component_key: str, path: str) -> DataFrame:
    """(component_key, path): a critical finding at the first file of every quarantined component."""
    bad = small(trust.where(F.col("level") == "quarantined").select(F.col("key").alias(component_key)).distinct())
    return files.join(bad, component_key).groupBy(component_key).agg(F.min(path).alias(path)).withColumns({"rule_id": F.lit("TRUST-Q01"), "severity": F.lit("critical")})


def upsert(trust: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of ``new`` replace those of the same key."""
    return trust.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def revoke(trust: DataFrame, key: str) -> DataFrame:
    """Without the entry of this key, or of this bare name under any kind."""
    return trust.where(~((F.col("key") == key) | F.col("key").endswith(f":{key}")))


TRUST = "key string, component_hash string, level string, accepted_rules array<string>"


def load_trust(spark: SparkSession, path: str) -> DataFrame:
    """The stored decisions by key, ascending; none if nothing is stored."""
    return read_or_empty(spark, path, TRUST).orderBy("key")


def save(df: DataFrame, path: str) -> None:
    """Store decisions or a baseline, in place of what is there. The new table is whole before the old one goes."""
    spark, fresh = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    remove(spark, path)
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (fresh, path))
    a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


CACHE = "content_hash string, profile_hash string, cached_at timestamp, result string"


def cache_put(results: DataFrame, path: str) -> None:
    """Add results (in the columns of ``CACHE``) to a cache; a lookup takes the latest of a hash and profile."""
    results.where(F.col("content_hash").isNotNull()).select("content_hash", "profile_hash", "cached_at", "result").write.mode("append").parquet(path)


def cache_entries(spark: SparkSession, path: str) -> DataFrame:
    """The latest result of each content and profile."""
    c = read_or_empty(spark, path, CACHE)
    return c.groupBy("content_hash", "profile_hash").agg(F.max_by(F.struct("cached_at", "result"), F.struct("cached_at", "result")).alias("x")).select("content_hash", "profile_hash", "x.*")


def cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """(n_entries, n_bytes, size): what a cache holds."""
    c = cache_entries(spark, path).agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(F.octet_length("result")), F.lit(0)).alias("n_bytes"))
    return c.withColumn("size", size_text(F.col("n_bytes")))


def size_text(n: Column) -> Column:
    """Bytes, KB, MB or GB, with one decimal from KB on."""
    unit = lambda k, u: F.concat(F.format_string("%.1f", n / F.lit(float(1024**k))), F.lit(f" {u}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def cache_clear(spark: SparkSession, path: str) -> None:
    remove(spark, path)


def new_files(files: DataFrame, baseline: DataFrame, on: list[str]) -> DataFrame:
    """Files that the baseline doesn't hold unchanged: anti join on path and content hash. Null hashes are always new."""
    return files.join(baseline.select(*on).distinct(), on, "left_anti")


def new_findings(findings: DataFrame, baseline: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Findings whose fingerprint the baseline doesn't hold."""
    return findings.join(baseline.select(fingerprint).distinct(), fingerprint, "left_anti")


def cached(files: DataFrame, cache: DataFrame, content_hash: str, profile: str, at: Column, days: int = 7) -> DataFrame:
    """``files`` with ``cache_hit``: a stored result of the same content and profile, not older than ``days``.

    The cache is cut to one entry per hash before the join, so a very frequent content meets one row. Null hashes
    never hit.
    """
    fresh = cache.where((F.col("profile_hash") == profile) & (F.col("cached_at") > at - F.make_dt_interval(F.lit(days)))).select(F.col("content_hash").alias("__h")).distinct()
    j = files.join(fresh, F.col(content_hash) == F.col("__h"), "left")
    return j.withColumn("cache_hit", F.col("__h").isNotNull()).drop("__h")
