"""Queries of the scan: positions, snippets, contexts, rules and their tests; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold import rules as R
from scanfold.functions import text as T
from scanfold.operators import scan
from scanfold.sources.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "path", "text")


def _found(spark: SparkSession, d: str, context: str | None = None, min_rank: int = 0) -> DataFrame:
    patterns, _ = R.compile_rules(table(spark, d, "rules"), context)
    return scan.findings(_files(spark, d), patterns, "doc_id", "text", "path", min_rank)


def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every match of every rule in every document, with its place."""
    return _found(spark, d).select("doc_id", "rule_id", "pattern_no", "match_no", "matched", "byte_offset", "line", "col", "severity")


def scan_message_context(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the rules for messages, from medium severity on."""
    return _found(spark, d, "message", 2).select("doc_id", "rule_id", "pattern_no", "match_no", "byte_offset", "severity")


def scan_snippets(spark: SparkSession, d: str) -> DataFrame:
    """What is around every match."""
    return _found(spark, d).select("doc_id", "rule_id", "pattern_no", "match_no", "snippet")


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Documents that end with calls as the patterns of one rule describe them, under a name that the rule is for."""
    w = Window.orderBy("rule_id")  # rules are configuration: few rows
    call = lambda p: F.concat(F.regexp_extract(p, r"\\b([a-z]+)", 1), F.lit("(x, "), F.regexp_extract(p, r"([a-z]+)[^a-z]*$", 1), F.lit(");"))
    r = table(spark, d, "rules").select((F.row_number().over(w) - 1).alias("no"), F.array_join(F.transform("patterns", call), "\n").alias("calls"), F.coalesce(F.get("file_names", F.lit(0)), F.concat(F.lit("x."), F.coalesce(F.get("file_extensions", F.lit(0)), F.lit("py")))).alias("name"))
    doc = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "text", (F.col("doc_id") % 120).cast("int").alias("no"))
    return doc.join(F.broadcast(r), "no").select("doc_id", F.concat(F.format_string("p/%d/", "doc_id"), "name").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "calls").alias("text"))  # 120 rules


def scan_planted(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the planted documents by rule: how many, in how many documents, and where."""
    patterns, _ = R.compile_rules(table(spark, d, "rules"))
    f = scan.findings(_planted(spark, d), patterns, "doc_id", "text", "path")
    return f.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("byte_offset").alias("offsets"), F.sum("line").alias("lines"), F.sum("col").alias("cols"))


def scan_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity; a row for each of the five, found or not."""
    n = _found(spark, d).groupBy("severity").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in T.SEVERITIES], "severity string")
    return every.join(F.broadcast(n), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def scan_rule_totals(spark: SparkSession, d: str) -> DataFrame:
    """Findings, documents and first place by rule."""
    f = _found(spark, d)
    return f.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"), F.min(F.struct("doc_id", "byte_offset"))["doc_id"].alias("first_doc"))


def rule_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The rules in listing order, with what they apply to."""
    r = table(spark, d, "rules")
    return r.select("rule_id", "category", "severity", "enabled", F.size("patterns").alias("n_patterns"), F.array_join(F.array_sort("file_extensions"), ",").alias("extensions"))


def rules_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rules").groupBy("source").agg(F.count("*").alias("n_rules"), F.count_if("enabled").alias("n_enabled"))


def rules_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Rules by tag, tags in lower case."""
    t = table(spark, d, "rules").select("rule_id", F.explode("metadata.tags").alias("t"))
    return t.select("rule_id", F.lower("t").alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("n_rules"))


def rule_self_tests(spark: SparkSession, d: str) -> DataFrame:
    """Test cases passed and failed, by rule."""
    t = R.self_tests(table(spark, d, "rules"))
    return t.groupBy("rule_id").agg(F.count("*").alias("n_tests"), F.count_if("passed").alias("n_passed"))


QUERIES = {f.__name__: f for f in (scan_findings, scan_message_context, scan_snippets, scan_planted, scan_severity_counts, scan_rule_totals, rule_inventory, rules_by_source, rules_tagged, rule_self_tests)}

# texts x patterns, the places of the matches from the texts between them
SCAN_SQL = r"""
with p as (select rule_id, severity, exclude_patterns, file_extensions, file_names, contexts, unnest(patterns) pattern, generate_subscripts(patterns, 1) - 1 pattern_no from rules where enabled),
c as (select doc_id, path, text, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) ext, lower(regexp_extract(path, '([^/]*)$', 1)) name, p.*
      from documents d, p where text <> '' and {where} regexp_matches(text, pattern)),
f as (select * from c where (len(file_extensions) = 0 or list_contains(file_extensions, ext)) and (len(file_names) = 0 or list_contains(list_transform(file_names, lambda x: lower(x)), name))),
m as (select *, regexp_extract_all(text, pattern) ms, regexp_split_to_array(text, pattern) gs from f),
e as (select *, unnest(range(len(ms))) match_no from m),
x as (select *, ms[match_no + 1] matched,
      array_to_string(list_transform(range(match_no), lambda i: gs[i + 1] || ms[i + 1]), '') || gs[match_no + 1] pre from e),
s as (select *, case when ext in ('md', 'txt', 'rst', 'adoc') and not regexp_matches(rule_id, '^(INJECT-|AUTH-|HIDDEN-|MDCODE-)') then least(1, list_position(['info','low','medium','high','critical'], severity) - 1)
      else list_position(['info','low','medium','high','critical'], severity) - 1 end sev_rank
      from x where len(list_filter(exclude_patterns, lambda q: regexp_matches(matched, q))) = 0),
found as (select doc_id, path, text, rule_id, pattern_no, match_no::int match_no, matched, strlen(pre) byte_offset, 1 + length(pre) - length(replace(pre, chr(10), '')) line,
      1 + strlen(string_split(pre, chr(10))[-1]) col, sev_rank, ['info','low','medium','high','critical'][sev_rank + 1] severity, pre from s)
"""
_SQL = SCAN_SQL.format(where="")
_TESTS = """
with t as (select rule_id, patterns, exclude_patterns, true expected, unnest(metadata.test_cases.should_match) text from rules
union all select rule_id, patterns, exclude_patterns, false, unnest(metadata.test_cases.should_not_match) from rules),
m as (select rule_id, expected, len(list_filter(patterns, lambda p: regexp_matches(text, p))) > 0 hit,
      len(list_filter(flatten(list_transform(patterns, lambda p: regexp_extract_all(text, p))), lambda y: len(list_filter(exclude_patterns, lambda q: regexp_matches(y, q))) = 0)) > 0 matched from t)
select rule_id, count(*) n_tests, count(*) filter (matched = expected) n_passed from m group by rule_id"""
ORACLE = {
    "scan_findings": _SQL + "select doc_id, rule_id, pattern_no, match_no, matched, byte_offset, line, col, severity from found",
    "scan_message_context": SCAN_SQL.format(where="(len(contexts) = 0 or list_contains(contexts, 'message')) and") + "select doc_id, rule_id, pattern_no, match_no, byte_offset, severity from found where sev_rank >= 2",
    "scan_planted": SCAN_SQL.format(where="").replace("with p as", r"""with pr as (select row_number() over (order by rule_id) - 1 as no, array_to_string(list_transform(patterns, lambda x: regexp_extract(x, '\\b([a-z]+)', 1) || '(x, ' || regexp_extract(x, '([a-z]+)[^a-z]*$', 1) || ');'), chr(10)) calls,
  coalesce(file_names[1], 'x.' || coalesce(file_extensions[1], 'py')) as fname from rules),
planted as (select doc_id, 'p/' || doc_id || '/' || fname path, coalesce(text, '') || chr(10) || calls as text from documents join pr on no = doc_id % 120 where doc_id is not null),
p as""").replace("from documents d, p", "from planted d, p")
    + "select rule_id, severity, count(*) n, count(distinct doc_id) n_docs, sum(byte_offset)::bigint offsets, sum(line)::bigint lines, sum(col)::bigint cols from found group by all",
    # as many characters to either side as fill fifty bytes
    "scan_snippets": _SQL
    + """, w as (select *, substr(text, length(pre) + length(matched) + 1) post from found),
y as (select *, case when strlen(pre) <= 50 then pre else right(pre, list_filter(range(1, 51), lambda k: strlen(right(pre, k::bigint)) >= 50)[1]::bigint) end a,
      case when strlen(post) <= 50 then post else left(post, list_filter(range(1, 51), lambda k: strlen(left(post, k::bigint)) >= 50)[1]::bigint) end b from w)
select doc_id, rule_id, pattern_no, match_no, case when a = pre then '' else '...' end || replace(a || matched || b, chr(10), '\\n') || case when b = post then '' else '...' end snippet from y""",
    "scan_severity_counts": _SQL + "select severity, count(f.doc_id) n from (select unnest(['info','low','medium','high','critical']) severity) left join found f using (severity) group by severity",
    "scan_rule_totals": _SQL + "select rule_id, count(*) n_findings, count(distinct doc_id) n_docs, min(doc_id) first_doc from found group by rule_id",
    "rule_inventory": "select rule_id, category, severity, enabled, len(patterns) n_patterns, array_to_string(list_sort(file_extensions), ',') extensions from rules",
    "rules_by_source": "select source, count(*) n_rules, count(*) filter (enabled) n_enabled from rules group by source",
    "rules_tagged": "select tag, count(*) n_rules from (select distinct rule_id, lower(unnest(metadata.tags)) tag from rules) group by tag",
    "rule_self_tests": _TESTS,
}
