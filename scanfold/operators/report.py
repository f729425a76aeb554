"""Aggregates of findings: counts, maximum severity, risk score, verdict and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T

WEIGHTS = {"critical": 40, "high": 15, "medium": 5, "low": 2}


def distinct_findings(findings: DataFrame, row_id: str = "finding_id") -> DataFrame:
    """One row per finding: redelivered rows agree in all but the time of receipt, the first receipt stays.

    Rows without an id are kept as they are. Only ids meet in the shuffle, so a rule, path or report that
    holds most findings is no hot spot.
    """
    known = findings.where(F.col(row_id).isNotNull())
    return known.dropDuplicates([row_id]).unionByName(findings.where(F.col(row_id).isNull()))


def active(suppressed_by: Column) -> Column:
    return suppressed_by.isNull()


def risk_score(rank: Column, where: Column | None = None) -> Column:
    """min(100, 40 critical + 15 high + 5 medium + 2 low), over rows or those of a condition."""
    total = F.lit(0)
    for name, w in WEIGHTS.items():
        cond = rank == T.SEVERITIES.index(name)
        total = total + w * F.count_if(cond if where is None else cond & where)
    return F.least(F.lit(100), total).cast("int")


def verdict(max_rank: Column) -> Column:
    """From the highest active severity; no finding, or only informative ones, is CLEAN."""
    names = ["CLEAN", "MINOR", "WARNINGS", "HIGH RISK", "DANGEROUS"]
    return F.coalesce(T.pick(names, max_rank), F.lit("CLEAN"))


def install_gate(max_rank: Column, allow_high: bool = False, force: bool = False) -> Column:
    """blocked, or allowed: critical always blocks, high unless ``allow_high``, medium unless ``force``."""
    return (
        F.when(max_rank >= 4, "blocked")
        .when((max_rank == 3) & F.lit(not allow_high), "blocked")
        .when((max_rank == 2) & F.lit(not force), "blocked")
        .otherwise("allowed")
    )


def summary(findings: DataFrame, by: list[str], rank: str = "rank", suppressed: str = "suppressed_by", fail_on: int = 4) -> DataFrame:
    """Per group: findings, active ones, highest severities, risk scores, label, verdict, gate and exit code."""
    live = active(F.col(suppressed))
    out = findings.groupBy(*by).agg(
        F.count("*").alias("n_findings"),
        F.count_if(live).alias("n_active"),
        F.max(rank).alias("max_rank"),
        F.max(F.when(live, F.col(rank))).alias("max_active_rank"),
        risk_score(F.col(rank)).alias("risk_score"),
        risk_score(F.col(rank), live).alias("active_risk_score"),
    )
    return out.withColumns(
        {
            "max_severity": T.severity_name(F.col("max_rank")),
            "risk_label": T.risk_label(F.col("risk_score")),
            "verdict": verdict(F.col("max_active_rank")),
            "gate": install_gate(F.col("max_active_rank")),
            "exit_code": F.when(F.col("max_active_rank") >= fail_on, 1).otherwise(0),
        }
    ).drop("max_rank")


def component_hash(files: DataFrame, component: str, content_hash: str) -> DataFrame:
    """(component, component_hash): one hash over a component's distinct file hashes.

    A tree of two levels: the sorted hashes with the same first byte make one hash, and those of up to 256
    bytes make the component's, so that no task sorts a whole component. Null hashes don't count; a
    component without any has the hash of the empty text.
    """
    h = F.lower(F.col(content_hash))
    joined = lambda c: F.when(F.size(c) > 0, F.concat(F.array_join(F.array_sort(c), "\n"), F.lit("\n"))).otherwise("")
    leaves = files.select(component, h.alias("__h")).distinct().groupBy(component, F.substr("__h", F.lit(1), F.lit(2)).alias("__b"))
    leaves = leaves.agg(F.sha2(joined(F.collect_list("__h")), 256).alias("__leaf")).where(F.col("__b").isNotNull() | F.col(component).isNotNull())
    rows = leaves.withColumn("__leaf", F.when(F.col("__b").isNotNull(), F.concat_ws(":", "__b", "__leaf")))
    return rows.groupBy(component).agg(F.sha2(joined(F.collect_list("__leaf")), 256).alias("component_hash"))
