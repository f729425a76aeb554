"""Queries of references, context, trust, baselines, dependencies, sinks and streams; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.functions.keys import hash_key, rule_key
from scanfold.operators import deps, js, paths, post, report, trace, trust
from scanfold.plans.paths import ROOT
from scanfold.plans.report import _F, _HASH, _RULE, _SEV, _findings
from scanfold.session import work_dir
from scanfold.sinks import report as sinks
from scanfold.sources.tables import table
from scanfold.streaming import watch

CUT = "2024-01-04 00:00:00"
NOW = "2024-01-11 00:00:00"
# a form, and the rules that report it with where
PLANTED = [
    ("window['eval'](code);", [("AST-EXEC-001", 0), ("AST-EXEC-001", 0)]), ('globalThis["ev" + "al"];', [("AST-EXEC-003", 0)]), ("self['\\x65val'];", [("AST-EXEC-004", 0)]), ("(0, eval)(code);", [("AST-EXEC-005", 0)]),
    ("const run = eval; run(code);", [("AST-EXEC-002", 18)]), ("const { exec: go } = require('child_process');", [("AST-SHELL-001", 8)]), ("function f() { const run = eval } run(code);", []),
]
HOSTS = [(f"{w}.{v}{n}.{t}", "/", "test host") for w in ("cache", "frame", "window", "policy") for v in ("amber", "ember", "slate") for n in range(1, 100) for t in ("test", "example")]


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Documents in one tree, each with references to two others; skill files are instruction files."""
    doc = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    skill = F.coalesce(F.col("source") == "skill", F.lit(False))
    path = F.when(skill, F.format_string("/r/s%d/SKILL.md", "doc_id")).otherwise(F.format_string("/r/d/%d.md", "doc_id"))
    refs = F.when(skill, F.format_string("\nread ../d/%d.md\n", F.col("doc_id") + 1)).otherwise(F.format_string("\nSee [next](./%d.md) or `d/%d.md`.\n", F.col("doc_id") + 1, F.col("doc_id") * 2))
    return doc.select(path.alias("path"), F.concat("t", refs).alias("text"), F.lit("/r").alias("root"))


def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return trace.references(_linked(spark, d), "path", "text", "root")


def agent_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Files that instruction files lead to in at most three steps, and by which."""
    files = _linked(spark, d)
    starts = files.where(trace.is_instruction(F.col("path"))).select(F.col("path").alias("instruction"))
    return trace.reachable(trace.references(files, "path", "text", "root"), starts)


def trusted_domains(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose snippet names a trusted host."""
    files = [work_dir(spark, "hosts") for _ in range(2)]
    for at, part in zip(files, (HOSTS[:1000], HOSTS[1000:])):  # an official file and a community file
        spark.createDataFrame([(part,)], "domains array<struct<domain string, path_prefix string, purpose string>>").coalesce(1).write.json(at)
    return post.trusted_domain(_findings(spark, d, "snippet").where(F.col("finding_id").isNotNull()), "finding_id", "snippet", post.load_domains(spark, *files))


def _trust_of(components: DataFrame) -> DataFrame:
    c = F.col("component_id")
    level = F.when(c < 5, "full").when(c < 10, "accepted").when(c < 12, "quarantined").otherwise("unknown")
    rules = F.when(c < 8, F.array(F.lit("MASK-3"), F.lit("LEAK-4"))).otherwise(F.array().cast("array<string>"))
    # every third component has changed since it was decided on
    decided = F.when(c % 3 == 2, F.sha2(F.col("component_hash"), 256)).otherwise(F.col("component_hash"))
    return components.select(trust.trust_key(F.lit("skill"), c.cast("string")).alias("key"), decided.alias("component_hash"), level.alias("level"), rules.alias("accepted_rules"))


def _component_hashes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "scan_results").where(F.col("component_id").isNotNull()).select("component_id", hash_key(F.col("content_hash")).alias("h"))
    return report.component_hash(r, "component_id", "h")


def trust_apply(spark: SparkSession, d: str) -> DataFrame:
    """Findings suppressed by trust decisions on their component."""
    hashes = _component_hashes(spark, d)
    results = table(spark, d, "scan_results").select("result_id", "component_id").where(F.col("component_id").isNotNull()).dropDuplicates(["result_id"])
    f = _findings(spark, d, "result_id", "rule_id").drop("suppressed_by").join(results, "result_id").join(hashes, "component_id")
    f = f.withColumns({"key": trust.trust_key(F.lit("skill"), F.col("component_id").cast("string")), "rule": rule_key(F.col("rule_id"))})
    out = trust.apply_trust(f, _trust_of(hashes), "key", "component_hash", "rule")
    return out.groupBy("component_id").agg(F.count("*").alias("n"), F.count("suppressed_by").alias("n_suppressed"))


def trust_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """A finding at the first file of every quarantined component."""
    files = table(spark, d, "scan_results").where(F.col("component_id").isNotNull()).select(F.concat(F.lit("skill:"), "component_id").alias("key"), "path")
    return trust.quarantine(files, _trust_of(_component_hashes(spark, d)), "key", "path")


def baseline_new_files(spark: SparkSession, d: str) -> DataFrame:
    """Files scanned since the cut that the baseline doesn't hold unchanged."""
    r = table(spark, d, "scan_results").select("path", hash_key(F.col("content_hash")).alias("content_hash"), "received_at").where(F.col("path").isNotNull())
    cut = F.lit(CUT).cast("timestamp")
    return trust.new_files(r.where(F.col("received_at") >= cut), r.where(F.col("received_at") < cut), ["path", "content_hash"]).groupBy("path").agg(F.count("*").alias("n"))


def baseline_new_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings made since the cut whose fingerprint isn't known."""
    f = _findings(spark, d, "rule_id", "path", "snippet", "detected_at").where(F.col("finding_id").isNotNull())
    f = f.select("finding_id", "detected_at", T.fingerprint(rule_key(F.col("rule_id")), F.col("path"), F.col("snippet")).alias("fingerprint"))
    cut = F.lit(CUT).cast("timestamp")
    return trust.new_findings(f.where(F.col("detected_at") >= cut), f.where(F.col("detected_at") < cut)).select("finding_id")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that a cache of at most seven days answers."""
    r = table(spark, d, "scan_results").select("arrival_no", hash_key(F.col("content_hash")).alias("content_hash"), "received_at")
    cache = r.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("received_at").alias("cached_at")).withColumn("profile_hash", F.lit("p1"))
    return trust.cached(r, cache, "content_hash", "p1", F.lit(NOW).cast("timestamp")).groupBy("cache_hit").agg(F.count("*").alias("n"))


def deps_typosquat(spark: SparkSession, d: str) -> DataFrame:
    """Words of the evaluation items that imitate words of the watch phrases: names alike but for two letters or a form."""
    words = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()
    return deps.typosquats(words(table(spark, d, "eval_items"), "text"), words(table(spark, d, "watch_phrases"), "phrase"))


def deps_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Snippets that would be dangerous as install scripts."""
    f = _findings(spark, d, "snippet").where(F.col("finding_id").isNotNull() & F.col("snippet").isNotNull())
    m = f.select("finding_id", F.to_json(F.struct(F.struct(F.col("snippet").alias("postinstall")).alias("scripts"))).alias("text"))
    return deps.install_scripts(m, "finding_id", "text").select("finding_id", "hook")


def ast_planted(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that begin with one of seven forms, by the document's number: what is found in the first lines."""
    n = F.col("doc_id") % len(PLANTED)
    first = F.element_at(F.array(*[F.lit(x) for x, _ in PLANTED]), (n + 1).cast("int"))
    docs = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", F.concat(first, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"), F.format_string("s/%d.%s", "doc_id", F.when(F.col("doc_id") % 2 == 0, "js").otherwise("ts")).alias("path"))
    return js.ast_findings(docs, "doc_id", "text", "path").where("line = 1").groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def ast_findings(spark: SparkSession, d: str) -> DataFrame:
    """Obfuscated calls in JavaScript documents and in snippets of JavaScript files."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", "path")
    snippets = _findings(spark, d, "snippet", "path").select(F.concat(F.lit("f"), "finding_id").alias("id"), F.replace("snippet", F.lit("\\n"), F.lit("\n")).alias("text"), "path")
    return js.ast_findings(docs.unionByName(snippets), "id", "text", "path")


def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d, "rule_id", "title", "path", "location")
    out = sinks.sarif_results(f.withColumns({"start_line": F.col("location.start_line"), "start_column": F.col("location.start_column"), "rule_id": rule_key(F.col("rule_id"))}))
    return out.groupBy("rule_id", "level", "suppressed").agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"))


def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    f = _findings(spark, d, "rule_id", "title", "description", "detected_at").withColumn("rule_id", rule_key(F.col("rule_id")))
    return sinks.sarif_rules(f, ["detected_at", "finding_id"])


def alerts_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and kind, run as a stream over what is there."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.run_to_table(watch.windowed_counts(stream, "ts", "event_type"), "alerts")


def message_alerts_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest event, if it was within a day of the end."""
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("alert"))
    return watch.latest_alerts(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), 86_400).select("user_id", "alert", "ts")


def message_alerts_live(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest event, if it was within an hour of the end: the batch form of expiring alerts."""
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("alert"))
    return watch.latest_alerts(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), 3600).select("user_id", "alert", "ts")


QUERIES = {
    f.__name__: f
    for f in (
        reference_edges, agent_reachable, trusted_domains, trust_apply, trust_quarantine, baseline_new_files, baseline_new_findings, cache_lookup,
        deps_typosquat, deps_scripts, ast_planted, ast_findings, sarif_results, sarif_rules, alerts_windowed, message_alerts_ttl, message_alerts_live,
    )
}

_EDGES = """with n as (select doc_id, coalesce(source = 'skill', false) skill, case when source = 'skill' then '/r/s' || doc_id || '/SKILL.md' else '/r/d/' || doc_id || '.md' end path from documents where doc_id is not null),
e as (select distinct a.path src, b.path dst from n a join n b on (b.doc_id = a.doc_id + 1 or (b.doc_id = 2 * a.doc_id and not a.skill)) where not b.skill)
"""
_HASHES = f"""h as (select distinct component_id, {_HASH} h from scan_results where component_id is not null),
l as (select component_id, substr(h, 1, 2) b, sha256(string_agg(h, chr(10) order by h) || chr(10)) leaf from h group by all)"""
_WORDS = "select distinct unnest(regexp_extract_all(lower({c}), '[a-z]+')) as name from {t}"
_SINGLE = "array_to_string(list_transform(regexp_extract_all({c}, '" + "|".join(f"{x}+" for x in "abcdefghijklmnopqrstuvwxyz") + "'), lambda y: y[1]), '')"
ORACLE = {
    "deps_typosquat": f"""with m as ({_WORDS.format(c="phrase", t="watch_phrases")}), n as ({_WORDS.format(c='"text"', t="eval_items")}), a as (select name from n where length(name) > 2 and name not in (select name from m)),
      b as (select name imitates from m where length(name) > 2),
      x as (select name, imitates, case when {_SINGLE.format(c="name")} = {_SINGLE.format(c="imitates")} then 2 when length(imitates) > 4 and levenshtein(name, imitates) <= 2 then 3 end how from a, b)
      select name, imitates, case how when 2 then 'doubled' else 'distance' end technique from x where how is not null qualify row_number() over (partition by name order by how, imitates) = 1""",
    "ast_planted": "with p as (select unnest([" + ", ".join(f"{{'m': {k}, 'r': '{r}', 's': {a}}}" for k, (_, found) in enumerate(PLANTED) for r, a in found) + "]) x) select x.r rule_id, case when x.r like 'AST-SHELL%' then 'high' else 'critical' end severity, count(*) n, sum(x.s)::bigint starts "
    f"from documents join p on doc_id % {len(PLANTED)} = x.m where doc_id is not null group by x.r",
    "reference_edges": _EDGES + "select src, dst from e",
    "agent_reachable": _EDGES
    + """, r1 as (select distinct src instruction, dst path, 1 depth from e where src like '%/SKILL.md'), r2 as (select distinct instruction, dst path, 2 depth from r1 join e on r1.path = e.src),
      r3 as (select distinct instruction, dst path, 3 depth from r2 join e on r2.path = e.src)
      select instruction, path, min(depth) depth from (from r1 union all from r2 union all from r3) group by all""",
    "trust_apply": _F
    + f""", r as (select result_id, any_value(component_id) c from scan_results where component_id is not null group by result_id)
      select c component_id, count(*) n, count(*) filter (c % 3 <> 2 and (c < 5 or (c < 8 and {_RULE} in ('MASK-3', 'LEAK-4')) or (c >= 8 and c < 10))) n_suppressed from f join r using (result_id) group by c""",
    "trust_quarantine": "select 'skill:' || component_id \"key\", min(path) path, 'TRUST-Q01' rule_id, 'critical' severity from scan_results where component_id in (10, 11) group by component_id",
    "baseline_new_files": f"""with r as (select path, {_HASH} h, received_at from scan_results where path is not null)
      select path, count(*) n from r a where received_at >= timestamptz '{CUT}+00' and not exists (select 1 from r b where b.received_at < timestamptz '{CUT}+00' and a.path = b.path and a.h = b.h) group by path""",
    "baseline_new_findings": _F
    + f""", k as (select finding_id, detected_at, sha256(coalesce({_RULE}, '') || chr(0) || coalesce(path, '') || chr(0) || coalesce(trim(snippet, ' '), '')) x from f where finding_id is not null)
      select finding_id from k where detected_at >= timestamptz '{CUT}+00' and x not in (select x from k where detected_at < timestamptz '{CUT}+00')""",
    "cache_lookup": f"""with r as (select arrival_no, {_HASH} h, received_at from scan_results), c as (select h, min(received_at) t from r where h is not null group by h)
      select coalesce(t > timestamptz '{NOW}+00' - interval 7 day, false) cache_hit, count(*) n from r left join c using (h) group by 1""",
    "deps_scripts": _F + "select finding_id, 'postinstall' hook from f where finding_id is not null and (" + " or ".join(f"regexp_matches(snippet, '{p}')" for p in deps.SCRIPT_PATTERNS) + ")",
    "sarif_results": _F
    + f"""select case when rule_id is not null then {_RULE} end rule_id, case when rank >= 3 then 'error' when rank = 2 then 'warning' else 'note' end "level", suppressed_by is not null suppressed, count(*) n, sum(location.start_line)::bigint lines from f group by all""",
    "sarif_rules": _F
    + f""", r as (select *, {_RULE} r from f where rule_id is not null) select r rule_id, title, description, case when rank >= 3 then 'error' when rank = 2 then 'warning' else 'note' end "level"
      from r qualify row_number() over (partition by r order by detected_at, finding_id) = 1""",
    "alerts_windowed": "select date_trunc('hour', ts) \"start\", event_type kind, count(*) n from events group by all",
    "message_alerts_ttl": "select user_id, event_type alert, ts from events qualify row_number() over (partition by user_id order by ts desc, event_type desc) = 1 and ts >= (select max(ts) from events) - interval 1 day",
    "message_alerts_live": "select user_id, event_type alert, ts from events qualify row_number() over (partition by user_id order by ts desc, event_type desc) = 1 and ts >= (select max(ts) from events) - interval 1 hour",
    "trusted_domains": _F
    + r""", u as (select finding_id, unnest(regexp_extract_all(snippet, 'https?://([a-zA-Z0-9._-]+)(/[^\s|"'')\]>]*)?', 1)) host, unnest(regexp_extract_all(snippet, 'https?://([a-zA-Z0-9._-]+)(/[^\s|"'')\]>]*)?', 2)) rest,
        generate_subscripts(regexp_extract_all(snippet, 'https?://([a-zA-Z0-9._-]+)(/[^\s|"'')\]>]*)?', 1), 1) n from f where finding_id is not null)
      select finding_id, arg_min(host || ' (test host)', n) trusted_domain from u where regexp_matches(host, '^(cache|frame|window|policy)\.(amber|ember|slate)[1-9][0-9]?\.(test|example)$') and starts_with(rest, '/') group by finding_id""",
}
