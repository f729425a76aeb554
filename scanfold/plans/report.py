"""Queries over delivered findings and results: counts, scores, roll-ups, distinct rules; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.functions.keys import hash_key, rule_key
from scanfold.operators import report
from scanfold.sources.tables import table


def _findings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "severity", "suppressed_by", *columns)
    return report.distinct_findings(f).withColumn("rank", T.severity_rank(F.col("severity")))


def report_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings and active findings of each report by severity."""
    f = _findings(spark, d, "report_id").groupBy("report_id", "rank").agg(F.count("*").alias("n"), F.count_if(F.col("suppressed_by").isNull()).alias("n_active"))
    return f.select("report_id", T.severity_name(F.col("rank")).alias("severity"), "n", "n_active")


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """Score, label, verdict and gate of each report that has findings."""
    return report.summary(_findings(spark, d, "report_id"), ["report_id"]).drop("max_active_rank")


def file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings and highest severity of each file."""
    return report.summary(_findings(spark, d, "path"), ["path"]).select("path", "n_findings", "max_severity", "verdict")


def component_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Files, findings and state of each component; CLEAN where nothing was found."""
    results = table(spark, d, "scan_results").select("result_id", "component_id").where(F.col("component_id").isNotNull()).dropDuplicates(["result_id"])
    per_file = _findings(spark, d, "result_id").groupBy("result_id").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    j = results.join(per_file, "result_id", "left").groupBy("component_id")
    j = j.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), F.max("rank").alias("rank"))
    return j.select("component_id", "n_files", "n_findings", F.coalesce(T.severity_name(F.col("rank")), F.lit("CLEAN")).alias("state"))


def scope_counters(spark: SparkSession, d: str) -> DataFrame:
    """Files by installation scope in each report."""
    r = table(spark, d, "scan_results").select("result_id", "report_id", "install_scope").dropDuplicates(["result_id"])
    count = lambda s: F.count_if(F.col("install_scope") == s)
    return r.groupBy("report_id").agg(F.count("*").alias("n_files"), count("installed").alias("n_installed"), count("dev_only").alias("n_dev_only"))


def category_density(spark: SparkSession, d: str) -> DataFrame:
    """Files with four or more findings of the injection categories, which reads as a detector's own file.

    Counted by a partial aggregate and joined back by nothing: the count is the result.
    """
    f = _findings(spark, d, "path", "category").where(F.col("category").isin("prompt_injection", "authority_impersonation"))
    return f.groupBy("path").agg(F.count("*").alias("n_injections")).where("n_injections >= 4")


def component_hashes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "scan_results").where(F.col("component_id").isNotNull()).select("component_id", hash_key(F.col("content_hash")).alias("h"))
    return report.component_hash(r, "component_id", "h")


def result_titles(spark: SparkSession, d: str) -> DataFrame:
    """The titles of a result's findings in the order of their place, joined; a result has few."""
    f = _findings(spark, d, "result_id", "byte_offset", "title").groupBy("result_id")
    ordered = F.array_sort(F.collect_list(F.struct("byte_offset", "finding_id", "title")))
    return f.agg(F.array_join(F.transform(ordered, lambda x: x["title"]), ", ").alias("titles"))


def first_finding_per_rule(spark: SparkSession, d: str) -> DataFrame:
    """The first finding of every rule, by time and id: what a report shows of the rule."""
    f = _findings(spark, d, "rule_id", "title", "detected_at").withColumn("rule", rule_key(F.col("rule_id"))).where(F.col("rule").isNotNull())
    first = F.min_by(F.struct("finding_id", "title"), F.struct("detected_at", "finding_id"))
    return f.groupBy("rule").agg(first.alias("x"), F.count("*").alias("n")).select("rule", "x.finding_id", "x.title", "n")


def rules_per_message(spark: SparkSession, d: str) -> DataFrame:
    """The distinct rules of a result's findings, in the order they first appear."""
    f = _findings(spark, d, "result_id", "byte_offset", "rule_id").where(F.col("rule_id").isNotNull()).groupBy("result_id")
    ordered = F.array_sort(F.collect_list(F.struct("byte_offset", "finding_id", rule_key(F.col("rule_id")).alias("rule"))))
    return f.agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["rule"])), ",").alias("rules"))


def cache_size(spark: SparkSession, d: str) -> DataFrame:
    """Entries and bytes of a cache that keeps every text once."""
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("h"), F.octet_length("text").alias("n")).dropDuplicates(["h"])
    return t.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text: the copy that is scanned, and how many it stands for."""
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return t.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).where("n_copies > 1")


def finding_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of every finding, by which a baseline knows it again."""
    root = F.regexp_extract("path", r"^(/srv/scan/[^/]+)", 1)
    f = _findings(spark, d, "rule_id", "path", "snippet").where(F.col("finding_id").isNotNull())
    return f.select("finding_id", T.fingerprint(F.col("rule_id"), T.relative_path(F.col("path"), root), F.col("snippet")).alias("fingerprint"))


def platform_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Reports, files and time by platform, with a row for all of them."""
    r = table(spark, d, "scan_reports").select(F.coalesce("platform", F.lit("(none)")).alias("platform"), "installed_file_count", "dev_only_file_count", "total_time_ms")
    g = r.rollup("platform").agg(F.count("*").alias("n_reports"), F.sum("installed_file_count").alias("installed"), F.sum("dev_only_file_count").alias("dev_only"), F.sum("total_time_ms").alias("total_ms"))
    return g.withColumn("platform", F.coalesce("platform", F.lit("(all)")))


def slowest_results(spark: SparkSession, d: str) -> DataFrame:
    """The twenty results that took longest, a top-k report."""
    r = table(spark, d, "scan_results").select("result_id", "path", "scan_time_ms").dropDuplicates(["result_id"])
    return r.orderBy(F.desc_nulls_last("scan_time_ms"), "result_id").limit(20)


def result_latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every result, and how many there were."""
    r = table(spark, d, "scan_results").where(F.col("result_id").isNotNull())
    return r.groupBy("result_id").agg(F.max("arrival_no").alias("arrival_no"), F.count("*").alias("n_deliveries"))


QUERIES = {
    f.__name__: f
    for f in (
        report_severity_counts, report_summary, file_summary, component_rollup, scope_counters, category_density, component_hashes, result_titles, first_finding_per_rule,
        rules_per_message, cache_size, duplicate_texts, finding_fingerprints, platform_rollup, slowest_results, result_latest_delivery,
    )
}

_SEV = "['info','low','medium','high','critical']"
_F = f"""
with d as (select * from findings qualify row_number() over (partition by finding_id order by received_at) = 1),
f as (select *, coalesce(list_position({_SEV}, lower(trim(severity))) - 1, 2) rank from d)
"""
_RULE = "upper(regexp_extract(rule_id, '([A-Za-z]+)', 1)) || '-' || ltrim(regexp_extract(rule_id, '([0-9]+)', 1), '0')"
_RISK = "least(100, 40 * count(*) filter (rank = 4 {w}) + 15 * count(*) filter (rank = 3 {w}) + 5 * count(*) filter (rank = 2 {w}) + 2 * count(*) filter (rank = 1 {w}))::int"
_SUMMARY = f"""
s as (select {{by}}, count(*) n_findings, count(*) filter (suppressed_by is null) n_active, max(rank) mr, max(rank) filter (suppressed_by is null) ar,
      {_RISK.format(w="")} risk_score, {_RISK.format(w="and suppressed_by is null")} active_risk_score from f group by {{by}})
"""
_HASH = r"nullif(regexp_extract(lower(trim(content_hash, chr(9) || chr(10) || chr(13) || chr(32))), '^(?:sha-?256\s*[:=-]\s*)?(?:0x)?([0-9a-f]{64})$', 1), '')"
ORACLE = {
    "report_severity_counts": _F + f"select report_id, {_SEV}[rank + 1] severity, count(*) n, count(*) filter (suppressed_by is null) n_active from f group by report_id, rank",
    "report_summary": _F
    + ","
    + _SUMMARY.format(by="report_id")
    + f"""select report_id, n_findings, n_active, risk_score, active_risk_score, {_SEV}[mr + 1] max_severity,
      case when risk_score = 0 then 'Clean' when risk_score <= 25 then 'Low Risk' when risk_score <= 50 then 'Moderate Risk' when risk_score <= 75 then 'High Risk' else 'Critical Risk' end risk_label,
      coalesce(['CLEAN','MINOR','WARNINGS','HIGH RISK','DANGEROUS'][ar + 1], 'CLEAN') verdict, case when ar >= 2 then 'blocked' else 'allowed' end gate, case when ar >= 4 then 1 else 0 end exit_code from s""",
    "file_summary": _F + "," + _SUMMARY.format(by="path") + f"select path, n_findings, {_SEV}[mr + 1] max_severity, coalesce(['CLEAN','MINOR','WARNINGS','HIGH RISK','DANGEROUS'][ar + 1], 'CLEAN') verdict from s",
    "component_rollup": _F
    + f""", r as (select result_id, any_value(component_id) component_id from scan_results where component_id is not null group by result_id),
      p as (select result_id, count(*) n, max(rank) rank from f group by result_id)
      select component_id, count(*) n_files, coalesce(sum(n), 0)::bigint n_findings, coalesce({_SEV}[max(rank) + 1], 'CLEAN') state from r left join p using (result_id) group by component_id""",
    "scope_counters": """with r as (select result_id, any_value(report_id) report_id, any_value(install_scope) install_scope from scan_results group by result_id)
      select report_id, count(*) n_files, count(*) filter (install_scope = 'installed') n_installed, count(*) filter (install_scope = 'dev_only') n_dev_only from r group by report_id""",
    "category_density": _F + "select path, count(*) n_injections from f where category in ('prompt_injection', 'authority_impersonation') group by path having count(*) >= 4",
    "component_hashes": f"""with h as (select distinct component_id, {_HASH} h from scan_results where component_id is not null),
      l as (select component_id, substr(h, 1, 2) b, sha256(string_agg(h, chr(10) order by h) || chr(10)) leaf from h group by all),
      k as (select component_id, case when b is not null then b || ':' || leaf end x from l)
      select component_id, sha256(coalesce(string_agg(x, chr(10) order by x) || chr(10), '')) component_hash from k group by component_id""",
    "result_titles": _F + "select result_id, string_agg(title, ', ' order by byte_offset nulls first, finding_id) titles from f group by result_id",
    "first_finding_per_rule": _F + f", r as (select *, {_RULE} rule from f where rule_id is not null) select rule, arg_min(finding_id, (detected_at, finding_id)) finding_id, arg_min(title, (detected_at, finding_id)) title, count(*) n from r group by rule",
    "rules_per_message": _F
    + f""", r as (select result_id, {_RULE} rule, byte_offset, finding_id, row_number() over (partition by result_id, {_RULE} order by byte_offset nulls first, finding_id) k from f where rule_id is not null)
      select result_id, string_agg(rule, ',' order by byte_offset nulls first, finding_id) rules from r where k = 1 group by result_id""",
    "cache_size": "with t as (select distinct sha256(text) h, strlen(text) n from documents where text is not null) select count(*) n_entries, coalesce(sum(n), 0)::bigint n_bytes from t",
    "duplicate_texts": "select sha256(text) content_hash, min(doc_id) doc_id, count(*) n_copies from documents where text is not null group by 1 having count(*) > 1",
    "finding_fingerprints": _F
    + r"""select finding_id, sha256(coalesce(rule_id, '') || chr(0) || coalesce(case when starts_with(path, '/srv/scan/') then regexp_replace(path, '^/srv/scan/[^/]+/', '') else path end, '') || chr(0) || coalesce(trim(snippet, ' '), '')) fingerprint from f where finding_id is not null""",
    "platform_rollup": """with r as (select coalesce(platform, '(none)') platform, * exclude (platform) from scan_reports)
      select coalesce(platform, '(all)') platform, count(*) n_reports, sum(installed_file_count)::bigint installed, sum(dev_only_file_count)::bigint dev_only, sum(total_time_ms)::bigint total_ms from r group by rollup (platform)""",
    "slowest_results": "with r as (select result_id, any_value(path) path, any_value(scan_time_ms) scan_time_ms from scan_results group by result_id) select * from r order by scan_time_ms desc nulls last, result_id limit 20",
    "result_latest_delivery": "select result_id, max(arrival_no) arrival_no, count(*) n_deliveries from scan_results where result_id is not null group by result_id",
}
