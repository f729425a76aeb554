"""Queries that run single parts of a scan over whole tables: discovery, names, filters, stores, dependencies, reports; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold import rules as R
from scanfold.config import Config
from scanfold.engine import Engine
from scanfold.functions import model
from scanfold.functions import text as T
from scanfold.functions.keys import hash_key, rule_key
from scanfold.operators import components, decode, deps, paths, post, scan, trace, trust
from scanfold.plans.paths import _P as _PATHS
from scanfold.plans.paths import ROOT, _in, _paths, _relative
from scanfold.plans.report import _F, _HASH, _RULE, _findings
from scanfold.plans.scan import SCAN_SQL
from scanfold.session import work_dir, written
from scanfold.sinks import report as sinks
from scanfold.sources import discovery
from scanfold.sources.tables import table
from scanfold.streaming import watch

INJECTIONS = ("CLOAK-", "WIPE-")  # the families of the rules table that report injected instructions
DISABLED = ("SPAWN-001", "PLANT-002")
SMALL_FILE = 4096  # bytes; of the query that shows the size limit
VERSIONS = ["1.0.0", "1.2.3", "2.0.0"]


def path_agent_walk(spark: SparkSession, d: str) -> DataFrame:
    """What a walk of an agent's folder keeps: no folder is pruned."""
    return discovery.agent_walk(_paths(spark, d))


def home_discovery(spark: SparkSession, d: str) -> DataFrame:
    """What an agent would read from each scanned root, if that were its home folder."""
    return discovery.agent_home(_paths(spark, d), F.regexp_extract("path", ROOT, 1))


def project_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of each scanned root by its manifests."""
    return paths.project_type(_paths(spark, d).withColumn("root", F.regexp_extract("path", ROOT, 1)), "path", "root")


def _repo_files(spark: SparkSession, d: str) -> DataFrame:
    """Skill documents as SKILL.md, configuration as package.json and Cargo.toml, of folders by their number."""
    doc = table(spark, d, "documents").where(F.col("doc_id").isNotNull())
    name = F.when(F.col("source") == "skill", "SKILL.md").when(F.col("source") == "config", F.when(F.col("doc_id") % 2 == 0, "package.json").otherwise("Cargo.toml"))
    body = F.when(F.col("source") == "skill", F.col("text")).when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("repo").alias("name"), F.col("path").alias("main"))))
    body = F.coalesce(body, F.concat(F.lit('[package]\nversion = "1"\nname = "'), "path", F.lit('"\n')))
    return doc.select(F.format_string("/r/d%d/%s", F.col("doc_id"), name).alias("path"), body.alias("text")).where(name.isNotNull())


def component_names(spark: SparkSession, d: str) -> DataFrame:
    """Components named by their manifests: heading, JSON and TOML names."""
    return components.detect(_repo_files(spark, d), "path", "text").select("root", "kind", "name")


def components_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """Components, the deepest first."""
    return components.by_depth(components.detect(_paths(spark, d), "path")).select("root", "kind", "depth")


def repository_names(spark: SparkSession, d: str) -> DataFrame:
    """Repositories' names from their addresses."""
    r = table(spark, d, "documents").where(F.col("repo").isNotNull()).select("repo").distinct()
    url = F.concat(F.lit("https://github.com/"), "repo", F.lit(".git/"))
    return r.select("repo", model.repository_name(url).alias("name"), model.is_repository_url(url).alias("is_repository"), model.is_repository_url(F.col("repo")).alias("bare"))


def rule_categories(spark: SparkSession, d: str) -> DataFrame:
    """Rules' categories read back from the words of a rule file."""
    return table(spark, d, "rules").select("rule_id", model.category(F.upper(F.replace("category", F.lit("_"), F.lit(" ")))).alias("category"))


def rules_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Rules by each filter of the listing."""
    r = table(spark, d, "rules")
    some = {"official": R.select_rules(r, source="official"), "author": R.select_rules(r, author="BIRCH"), "tag": R.select_rules(r, tag="Runtime"), "id": R.select_rules(r, rule_id="lea"), "all": R.select_rules(r, "official", "-", None, "a")}
    out = None
    for name, found in some.items():
        part = found.select(F.lit(name).alias("filter"), "rule_id")
        out = part if out is None else out.unionByName(part)
    return out


def rules_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each enabled rule and why it can't be used, null if it can."""
    good, bad = R.compile_rules(table(spark, d, "rules"))
    return spark.createDataFrame([*({p.rule_id: None for p in good}.items()), *bad], "rule_id string, fault string")


def _rule_folder(spark: SparkSession, d: str) -> str:
    """The rules written as rule files."""
    r = table(spark, d, "rules").select(
        F.col("rule_id").alias("id"), "title", "description", "severity", "category", "patterns", "exclude_patterns", "file_extensions", "file_names", "contexts", "remediation", "enabled",
        F.struct("metadata.author", "metadata.author_url", "metadata.version", "metadata.created", "metadata.updated", "metadata.references", "metadata.tags").alias("metadata"), F.col("metadata.test_cases").alias("test_cases"),
    )
    folder = work_dir(spark, "rule-files")
    r.groupBy("category").agg(F.collect_list(F.struct(*[c for c in r.columns if c != "category"])).alias("rules")).repartition("category").write.partitionBy("category").json(folder)  # a file of rules for each category, as users keep them
    return folder


def rules_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The rules read back from rule files."""
    r = R.load_rules(spark, _rule_folder(spark, d), "external")
    return r.select("rule_id", "title", "severity", "category", "enabled", "source", F.array_join("patterns", "\n").alias("patterns"), F.array_join("contexts", ",").alias("contexts"), F.array_join("metadata.tags", ",").alias("tags"))


def scan_without_rules(spark: SparkSession, d: str) -> DataFrame:
    """Findings while some rules are switched off."""
    patterns, _ = R.compile_rules(table(spark, d, "rules"), None, DISABLED)
    return scan.findings(table(spark, d, "documents").select("doc_id", "path", "text"), patterns, "doc_id", "text", "path").groupBy("rule_id").agg(F.count("*").alias("n"))


def scan_file_results(spark: SparkSession, d: str) -> DataFrame:
    """A result for each document, without a hash if it is larger than a limit."""
    return scan.results(table(spark, d, "documents"), "doc_id", "text", "path", SMALL_FILE)


def message_scan(spark: SparkSession, d: str) -> DataFrame:
    """Chats and issues of at least 20 characters, scanned as messages."""
    patterns, _ = R.compile_rules(table(spark, d, "rules"), "message")
    m = watch.long_messages(table(spark, d, "documents").where(F.col("source").isin("chat", "issue", "paste")).select("doc_id", "path", "text"), "text")
    return scan.findings(m, patterns, "doc_id", "text", "path").select("doc_id", "rule_id", "pattern_no", "match_no", "severity")


def engine_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """All that a check of the documents finds, by rule: rules of the table and of a folder, hidden payloads, random strings, scripts."""
    rules = table(spark, d, "rules")
    engine = Engine(spark, rules.where(F.col("source") == "official"), Config(rule_folders=(_rule_folder(spark, d),), disabled_rules=()))
    return engine.check(table(spark, d, "documents")).groupBy("rule_id").agg(F.count("*").alias("n"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Documents in one tree: skill files lead to the next document, others to the next and to that of twice their number; a third are examples."""
    doc = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    skill = F.coalesce(F.col("source") == "skill", F.lit(False))
    at = lambda n: F.format_string("%s/%d.md", F.when(n % 3 == 0, "examples").otherwise("d"), n)
    n = F.col("doc_id")
    path = F.when(skill, F.format_string("/r/s%d/SKILL.md", n)).otherwise(F.concat(F.lit("/r/"), at(n)))
    refs = F.when(skill, F.concat(F.lit("\nread ../"), at(n + 1), F.lit("\n"))).otherwise(F.concat(F.lit("\nSee [next](../"), at(n + 1), F.lit(") or `"), at(n * 2), F.lit("`.\n")))
    return doc.select(path.alias("path"), F.concat("t", refs).alias("text"), F.lit("/r").alias("root"))


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    files = _tree(spark, d)
    starts = files.where(trace.is_instruction(F.col("path"))).select(F.col("path").alias("instruction"))
    led = trace.referenced_by(trace.reachable(trace.references(files, "path", "text", "root"), starts))
    return files.select("path", paths.install_scope(T.relative_path(F.col("path"), F.lit("/r"))).alias("scope")).join(led, "path", "left").withColumn("reachable", F.col("referenced_by").isNotNull())


def referenced_by(spark: SparkSession, d: str) -> DataFrame:
    """Files that instructions lead to, and the names of those that do."""
    files = _tree(spark, d)
    starts = files.where(trace.is_instruction(F.col("path"))).select(F.col("path").alias("instruction"))
    return trace.referenced_by(trace.reachable(trace.references(files, "path", "text", "root"), starts))


def installed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that are installed, and development files that an instruction leads to."""
    return paths.installed_only(_scoped(spark, d)).select("path", "scope", "reachable")


def tree_scope_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files by scope below each folder of the tree, and the reachable ones."""
    top = F.regexp_replace(F.regexp_extract("path", "^/r/([^/]+)/", 1), "[0-9]+", "")
    return paths.scope_counts(_scoped(spark, d).withColumn("top", top), ["top"])


def detection_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Why a finding may be a detector's own: its snippet, its path, or how many injections the file has."""
    f = _findings(spark, d, "path", "snippet", "rule_id").where(F.col("finding_id").isNotNull()).withColumn("rule", rule_key(F.col("rule_id")))
    n = f.where(post.is_injection(F.col("rule"), INJECTIONS)).groupBy("path").agg(F.count("*").alias("injections"))
    return f.join(n, "path", "left").select("finding_id", post.detection_context(F.col("snippet"), F.col("path"), F.col("injections")).alias("context"))


def adjusted_severities(spark: SparkSession, d: str) -> DataFrame:
    """Every finding's severity after its surroundings are taken into account, and why it changed.

    Reachable is what the instruction files among the scanned paths lead to: each names the README.md and the notes beside it.
    """
    f = _findings(spark, d, "path", "rule_id", "snippet").where(F.col("finding_id").isNotNull() & F.col("path").isNotNull()).withColumn("rule_id", rule_key(F.col("rule_id")))
    f = written(f, "findings")  # read by each of the steps below
    files = f.select("path").distinct().withColumn("root", F.regexp_extract("path", ROOT, 1))
    files = files.withColumn("text", F.when(trace.is_instruction(F.col("path")), "Read README.md first, then run `setup.sh`, see [notes](NOTES.md)."))
    starts = files.where(trace.is_instruction(F.col("path"))).select(F.col("path").alias("instruction"))
    led = trace.reachable(trace.references(files, "path", "text", "root"), starts).select("path").distinct().withColumn("reachable", F.lit(True))
    inj = f.where(post.is_injection(F.col("rule_id"), INJECTIONS)).groupBy("path").agg(F.count("*").alias("injections"))
    dom = post.trusted_domain(f, "finding_id", "snippet", HOSTS)
    f = f.join(inj, "path", "left").join(led, "path", "left").join(dom, "finding_id", "left").withColumns({"reachable": F.coalesce("reachable", F.lit(False)), "scope": paths.install_scope(_relative())})
    return post.adjust(f, post.is_injection(F.col("rule_id"), INJECTIONS)).select("finding_id", T.severity_name(F.col("rank")).alias("severity"), "reason")


HOSTS = [(f"{w}.{v}{n}.{t}", "/", "test host") for w in ("cache", "frame", "window", "policy") for v in ("amber", "ember", "slate") for n in range(1, 100) for t in ("test", "example")]


def high_entropy_strings(spark: SparkSession, d: str) -> DataFrame:
    """Quoted strings of many bytes and high entropy, in stored pieces as they stood in code and in snippets."""
    p = table(spark, d, "decoded_content").where(F.col("original").isNotNull()).select("decoded_id", "original").distinct()
    quoted = p.select(F.concat(F.lit("d"), "decoded_id").alias("id"), F.concat(F.lit('x = "'), "original", F.lit('"')).alias("text"))
    s = table(spark, d, "findings").where(F.col("finding_id").isNotNull()).select("finding_id", "snippet").distinct().select(F.concat(F.lit("f"), "finding_id").alias("id"), F.col("snippet").alias("text"))
    return decode.high_entropy(quoted.unionByName(s), "id", "text", least=4.5).select("id", F.md5("string").alias("string_md5"), "entropy")


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for each result: its path's words as names of packages, in versions that follow from its number."""
    r = table(spark, d, "scan_results").where(F.col("result_id").isNotNull() & F.col("path").isNotNull()).groupBy("result_id").agg(F.min("path").alias("path"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("path", r"^/srv/scan/", "")), "[^a-z]+"), lambda w: w != ""))
    version = F.concat(F.when(F.col("result_id") % 2 == 0, "^").otherwise(" ~"), F.get(F.array(*map(F.lit, VERSIONS)), (F.col("result_id") % 3).cast("int")))
    body = F.struct(F.map_from_entries(F.transform(words, lambda w: F.struct(w, version))).alias("dependencies"), F.struct(F.lit("node -e 1").alias("postinstall"), F.lit("tsc").alias("prepare")).alias("scripts"))
    return r.select("result_id", F.to_json(body).alias("text"))


def deps_malicious(spark: SparkSession, d: str) -> DataFrame:
    """Packages of the manifests that are on a list of malicious ones, in the versions listed."""
    known = spark.createDataFrame([("mirror", ["1.2.3"], "steals"), ("helper", [], "any version"), ("warden", ["9.9.9"], "another")], "name string, versions array<string>, reason string")
    return deps.malicious(deps.dependencies(_manifests(spark, d), "result_id", "text"), known).select("result_id", "name", "version", "reason")


def deps_sections(spark: SparkSession, d: str) -> DataFrame:
    """Packages by section and plain version."""
    p = deps.dependencies(_manifests(spark, d), "result_id", "text")
    return p.groupBy("section", "name", deps.plain_version(F.col("version")).alias("version")).agg(F.count("*").alias("n"))


def model_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The question about each document, clipped to what a model takes."""
    doc = table(spark, d, "documents").where(F.col("text").isNotNull())
    p = model.prompt(F.col("path"), F.col("source"), F.col("text"))
    return doc.select("doc_id", F.md5(p).alias("prompt_md5"), F.length(p).alias("n"))


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Findings of answers in three forms, of which those held with confidence count."""
    f = _findings(spark, d, "title", "category", "path").where(F.col("finding_id").isNotNull() & F.col("path").isNotNull())
    body = F.to_json(F.struct(F.array(F.struct(((F.col("finding_id") % 10) / 10).alias("confidence"), "category", F.col("title").alias("description"), F.col("severity"))).alias("findings")))
    forms = [F.struct(F.array(F.struct(body.alias("text"))).alias("content")), F.struct(F.array(F.struct(F.struct(body.alias("content")).alias("message"))).alias("choices")), F.struct(body.alias("response"))]
    response = F.when(F.col("finding_id") % 3 == 0, F.to_json(forms[0])).when(F.col("finding_id") % 3 == 1, F.to_json(forms[1])).otherwise(F.to_json(forms[2]))
    return model.model_findings(f.select("path", response.alias("r")), "path", "r").groupBy("path", "rule_id", "severity", "category").agg(F.count("*").alias("n"))


def snippet_heads(spark: SparkSession, d: str) -> DataFrame:
    """Snippets clipped for a listing."""
    return _findings(spark, d, "snippet").where(F.col("finding_id").isNotNull()).select("finding_id", T.truncate(F.col("snippet"), 80).alias("head"))


def trust_store(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on components stored, replaced, revoked and listed by key."""
    c = table(spark, d, "scan_results").where(F.col("component_id").isNotNull()).select("component_id").distinct()
    entry = lambda df, level: df.select(trust.trust_key(F.lit("npm_package"), F.col("component_id").cast("string")).alias("key"), F.lit("h").alias("component_hash"), F.lit(level).alias("level"), F.array().cast("array<string>").alias("accepted_rules"))
    at = work_dir(spark, "trust")
    trust.save(entry(c, "accepted"), at)
    trust.save(trust.upsert(trust.load_trust(spark, at), entry(c.where("component_id % 4 = 1"), "full")), at)
    trust.save(trust.revoke(trust.load_trust(spark, at), "7"), at)
    return trust.load_trust(spark, at).select("key", "level")


def baseline_stored(spark: SparkSession, d: str) -> DataFrame:
    """Results that a stored baseline doesn't hold unchanged, by day of delivery."""
    r = table(spark, d, "scan_results").where(F.col("path").isNotNull()).select("path", hash_key(F.col("content_hash")).alias("content_hash"), "received_at")
    at = work_dir(spark, "baseline")
    trust.save(r.where(F.col("received_at") < F.lit("2024-01-03 00:00:00").cast("timestamp")).select("path", "content_hash").distinct(), at)
    known = trust.read_or_empty(spark, at, "path string, content_hash string")
    return trust.new_files(r, known, ["path", "content_hash"]).groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def cache_stored(spark: SparkSession, d: str) -> DataFrame:
    """Texts' results put into a cache in two rounds, and what it then holds."""
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("content_hash"), F.lit("p").alias("profile_hash"), F.col("received_at").alias("cached_at"), F.col("text").alias("result")).distinct()
    at = work_dir(spark, "cache")
    trust.cache_put(t, at)
    trust.cache_put(t.withColumn("cached_at", F.col("cached_at") + F.expr("interval 1 day")), at)
    return trust.cache_stats(spark, at).select("n_entries", "n_bytes", "size")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The findings as JSON lines, read back: how many of each rule and severity."""
    f = _findings(spark, d, "rule_id", "path", "location").withColumn("rule_id", rule_key(F.col("rule_id"))).select("finding_id", "rule_id", "path", "rank", F.col("location.start_line").alias("start_line"))
    at = work_dir(spark, "report")
    sinks.write_json(f, at)
    back = spark.read.schema("finding_id long, rule_id string, path string, rank int, start_line int").json(at)
    return back.groupBy("rule_id", "rank").agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"), F.count_distinct("path").alias("n_paths"))


def report_document(spark: SparkSession, d: str) -> DataFrame:
    """The largest report as documents of all formats: how often each severity's mark stands in them."""
    f = _findings(spark, d, "report_id", "rule_id", "title", "description", "path", "snippet", "location").withColumns({"rule_id": rule_key(F.col("rule_id")), "start_line": F.col("location.start_line"), "start_column": F.col("location.start_column")})
    top = f.where(F.col("report_id").isNotNull()).groupBy("report_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "report_id").first()
    if top is None:
        return spark.createDataFrame([], "format string, marks long, rules long")
    one = f.where(F.col("report_id") == top["report_id"]).drop("location")
    sarif, md, cli, js = (sinks.render(one, k, {"verdict": "DANGEROUS"}) for k in ("sarif", "md", "cli", "json"))
    rows = [("sarif", sarif.count('"ruleId"'), sarif.count('"shortDescription"')), ("md", md.count("\n- severity: "), md.count("\n### ")), ("cli", cli.count(" line "), 0), ("json", js.count('"suppressed_by"'), js.count('"rule_id"'))]
    return spark.createDataFrame(rows, "format string, marks long, rules long")


def readable_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes, every seventh of them with a byte that is no UTF-8: what can be read as text."""
    doc = table(spark, d, "documents").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    odd = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = doc.select(F.concat(F.lit("file:///r/"), "doc_id").alias("path"), F.col("received_at").alias("modificationTime"), F.concat(F.encode("text", "utf-8"), odd).alias("content"))
    return watch.text_files(raw).select("path", F.md5("text").alias("text_md5"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Events as contents of files, run as a stream: each content of a file once."""
    e = _event_stream(spark, d).select(F.concat(F.lit("/e/"), "user_id").alias("path"), F.col("event_type").alias("text"), "ts")
    return watch.run_to_table(watch.once_per_content(e, "400 days").select("path", "text"), "once", "append")


def alert_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as alerts, run as a stream with a state for each user: what it says at first."""
    e = _event_stream(spark, d).select("user_id", F.col("event_type").alias("alert"), "ts")
    return watch.run_to_table(watch.alert_state(e, "user_id", "ts"), "alerts", "update").select("channel", "alert", "ts", "state")


QUERIES = {
    f.__name__: f
    for f in (
        readable_files, stream_once, alert_states, path_agent_walk, home_discovery, project_types, component_names, components_by_depth, repository_names, rule_categories, rules_filtered, rules_checked, rules_from_files, scan_without_rules, scan_file_results,
        message_scan, engine_rule_counts, referenced_by, installed_files, tree_scope_counts, detection_contexts, adjusted_severities, high_entropy_strings, deps_malicious, deps_sections, model_prompts, model_answers,
        snippet_heads, trust_store, baseline_stored, cache_stored, report_lines, report_document,
    )
}

_FOUND = SCAN_SQL.format(where="")
_KINDS = "case when {e} in ('js','ts','mjs','cjs','py') then 'plugin' when {e} in ('json','yaml','yml','toml') then 'config' when {e} in ('md','txt') then 'prompt' when {e} in ('sh','bash','zsh','ps1','psm1','psd1','bat','cmd') then 'hook' else 'other' end"
_SKILL = r"case when name = 'SKILL.md' then string_split(path, '/')[-2] else regexp_replace(name, '^(.+)\.[^.]*$', '\1') end"
_AT = "case when {n} % 3 = 0 then 'examples/' else 'd/' end || {n} || '.md'"
_TREE = f"""with n as (select doc_id, coalesce(source = 'skill', false) skill, case when source = 'skill' then '/r/s' || doc_id || '/SKILL.md' else '/r/' || {_AT.format(n="doc_id")} end path from documents where doc_id is not null),
e as (select distinct a.path src, b.path dst from n a join n b on (b.doc_id = a.doc_id + 1 or (b.doc_id = 2 * a.doc_id and not a.skill)) where not b.skill),
r1 as (select distinct src instruction, dst path from e where src like '%/SKILL.md'), r2 as (select distinct instruction, dst path from r1 join e on r1.path = e.src), r3 as (select distinct instruction, dst path from r2 join e on r2.path = e.src),
led as (select path, string_agg(distinct regexp_extract(instruction, '([^/]*)$', 1), ', ') referenced_by from (from r1 union all from r2 union all from r3) where path <> instruction group by path),
s as (select n.path, case when n.path like '/r/examples/%' then 'dev_only' else 'installed' end scope, led.path is not null reachable from n left join led using (path))
"""
_WORDS = " or ".join(f"contains(low, '{w}')" for w in post.DETECTION_WORDS)
_CALLS = " or ".join(f"contains(low, '{w}')" for w in post.REGEX_CALLS)
_SECURE = " or ".join(f"contains(lower(path), '{w}')" for w in post.SECURITY_PATHS)
_PREFIX = "({c} like 'CLOAK-%' or {c} like 'WIPE-%')"
_CONTEXT = f"""case when contains(line, 'r"') or contains(line, 'r''') or contains(line, 'r#"') or {_CALLS} or regexp_matches(line, '(?:^|[^0-9)/])/(?:\\\\.|[^/\\\\]){{3,}}/') or (({_WORDS}) and (contains(line, '"') or contains(line, ''''))) then 'string_literal'
  when {_SECURE} then 'security_tool_path' when coalesce(injections, 0) >= 4 then 'high_density' end"""
_CTX = (
    _F
    + f""", g as (select *, {_RULE} rule, trim(snippet, ' ') line, lower(trim(snippet, ' ')) low from f where finding_id is not null),
n as (select path, count(*) injections from g where {_PREFIX.format(c="rule")} group by path),
c as (select g.*, n.injections, {_CONTEXT} context from g left join n using (path))
"""
)
_DEV = [*(f"{x}/**" for x in paths.DEV_DIRS), *paths.DEV_FILES]
_MANIFESTS = r"""with r as (select result_id, min(path) path from scan_results where result_id is not null and path is not null group by result_id),
w as (select result_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(path, '^/srv/scan/', '')), '[^a-z]+'), lambda x: x <> ''))) name from r),
m as (select result_id, name, case when result_id % 2 = 0 then '^' else ' ~' end || ['1.0.0','1.2.3','2.0.0'][result_id % 3 + 1] "version" from w)
"""


def _sql_text(x: str) -> str:
    return x.replace("'", "''")


_ASK = [_sql_text(x) for x in model.QUESTION.split("%s")]
ORACLE = {
    "readable_files": "select '/r/' || doc_id path, md5(text) text_md5 from documents where doc_id is not null and text is not null and doc_id % 7 <> 0",
    "stream_once": "select distinct '/e/' || user_id path, event_type as text from events where ts is not null",
    "alert_states": "select user_id::varchar channel, event_type alert, ts, 'new' state from events where user_id is not null qualify row_number() over (partition by user_id order by ts desc, event_type desc) = 1",
    "path_agent_walk": _PATHS + f"select path, {_KINDS.format(e='ext')} kind, name from p where ext in {_in(discovery.AGENT_FILES)}",
    "home_discovery": _PATHS
    + f""", k as (select path, name, {_KINDS.format(e="ext")} kind, {_SKILL} skill, ext, rel, len(string_split(rel, '/')) - 1 deep from p where rel <> path and ext not in {_in(paths.BINARY)}),
      c as (select path, 0 n, kind, name label from k where starts_with(rel, 'plugins/') and ext in {_in(discovery.PLUGIN_FILES)} union all select path, 1, 'config', 'settings.json' from k where rel = 'settings.json'
        union all select path, 2, 'hook', name from k where starts_with(rel, 'hooks/') and deep <= 2 union all select path, 3, 'mcp_server', 'settings.json (servers)' from k where rel = 'settings.json'
        union all select path, 4, 'mcp_server', '.claude.json' from k where rel = '.claude.json' union all select path, 5, 'prompt', 'CLAUDE.md (global)' from k where rel = 'CLAUDE.md'
        union all select path, 7, kind, 'command: ' || skill from k where starts_with(rel, 'commands/') and deep <= 4 and ext in {_in(discovery.SKILL_FILES)}
        union all select path, 8, kind, 'skill: ' || skill from k where starts_with(rel, 'skills/') and deep <= 4 and ext in {_in(discovery.SKILL_FILES)})
      select path, kind, label as name from c qualify row_number() over (partition by path order by kind not in ('mcp_server', 'plugin', 'hook'), n) = 1""",
    "project_types": _PATHS
    + r"""select regexp_extract(path, '^(/srv/scan/[^/]+)', 1) root, case when bool_or(rel = 'package.json') then 'npm' when bool_or(rel = 'Cargo.toml') then 'cargo' when bool_or(rel in ('pyproject.toml', 'setup.py')) then 'python' else 'unknown' end project_type from p group by 1""",
    "component_names": r"""select '/r/d' || doc_id root, case when source = 'skill' then 'skill' when doc_id % 2 = 0 then 'npm_package' else 'rust_crate' end kind,
      coalesce(case when source = 'skill' then nullif(trim(regexp_extract(text, '(?m)^[ \t]*# +(\S[^\r\n]*)\r?$', 1)), '') when doc_id % 2 = 0 then repo else path end, 'd' || doc_id) as name
      from documents where doc_id is not null and source in ('skill', 'config')""",
    "components_by_depth": _PATHS
    + """, m as (select regexp_replace(path, '/[^/]*$', '') root, case name when 'SKILL.md' then 'skill' when 'mcp.json' then 'mcp_server' when 'plugin.json' then 'plugin' when 'package.json' then 'npm_package' when 'Cargo.toml' then 'rust_crate' end kind,
        list_position(['Cargo.toml','package.json','plugin.json','mcp.json','SKILL.md'], name) prio from p)
      select root, kind, len(string_split(root, '/'))::int depth from m where kind is not null qualify row_number() over (partition by root order by prio desc) = 1""",
    "repository_names": "select distinct repo, regexp_extract(repo, '([^/:]*)$', 1) as name, true is_repository, starts_with(repo, 'github.com/') bare from documents where repo is not null",
    "rule_categories": r"""select rule_id, case when category in ('code_execution','shell_execution','prompt_injection','credential_access','data_exfiltration','obfuscation','sensitive_file_access','authority_impersonation') then category else replace(category, '_', ' ') end category from rules""",
    "rules_filtered": """select 'official' "filter", rule_id from rules where source = 'official' union all select 'author', rule_id from rules where contains(lower(metadata.author), 'birch')
      union all select 'tag', rule_id from rules where list_contains(list_transform(metadata.tags, lambda x: lower(x)), 'runtime') union all select 'id', rule_id from rules where contains(lower(rule_id), 'lea')
      union all select 'all', rule_id from rules where source = 'official' and contains(metadata.author, '-') and contains(lower(rule_id), 'a')""",
    "rules_checked": "select rule_id, null::varchar fault from rules where enabled and len(patterns) > 0",
    "rules_from_files": """select rule_id, title, lower(severity) severity, category, enabled, 'external' source, array_to_string(patterns, chr(10)) patterns, coalesce(array_to_string(contexts, ','), '') contexts, array_to_string(metadata.tags, ',') tags from rules""",
    "scan_without_rules": _FOUND + f"select rule_id, count(*) n from found where rule_id not in {_in(list(DISABLED))} group by rule_id",
    "scan_file_results": f"select doc_id, path, case when coalesce(strlen(text), 0) <= {SMALL_FILE} then sha256(coalesce(text, '')) end content_hash, coalesce(strlen(text), 0)::int n_bytes, coalesce(strlen(text), 0) <= {SMALL_FILE} scanned from documents",
    "message_scan": SCAN_SQL.format(where="source_ok and length(text) >= 20 and (len(contexts) = 0 or list_contains(contexts, 'message')) and").replace("from documents d, p", "from (select *, source in ('chat', 'issue', 'paste') source_ok from documents) d, p")
    + "select doc_id, rule_id, pattern_no, match_no, severity from found",
    # the rules of the table's official part come twice, from the table and from the folder
    "engine_rule_counts": _FOUND + ", o as (select rule_id, count(*) c from (select rule_id from rules where source = 'official' union all select rule_id from rules) group by rule_id) select rule_id, (count(*) * any_value(c))::bigint n from found join o using (rule_id) where path is not null group by rule_id",
    "referenced_by": _TREE + "select path, referenced_by from led",
    "installed_files": _TREE + "select path, scope, reachable from s where scope = 'installed' or reachable",
    "tree_scope_counts": _TREE
    + """select regexp_replace(regexp_extract(path, '^/r/([^/]+)/', 1), '[0-9]+', '', 'g') top, count(*) n_files, count(*) filter (scope = 'installed' or reachable) n_installed, count(*) filter (not (scope = 'installed' or reachable)) n_dev_only, count(*) filter (reachable) n_reachable from s group by 1""",
    "detection_contexts": _CTX + "select finding_id, context from c",
    "adjusted_severities": _CTX
    + rf""", fp as (select distinct path, regexp_extract(path, '^(/srv/scan/[^/]+)', 1) root, regexp_replace(path, '/[^/]*$', '') dir from f where path is not null),
      i as (select * from fp where regexp_extract(path, '([^/]*)$', 1) in {_in(paths.INSTRUCTIONS)}),
      t as (select i.path src, i.root, i.dir, unnest(['README.md', 'setup.sh', 'NOTES.md']) ref from i),
      led as (select distinct coalesce(a.path, b.path) path from t left join fp a on a.path = t.dir || '/' || t.ref left join fp b on b.path = t.root || '/' || t.ref where coalesce(a.path, b.path) is not null and coalesce(a.path, b.path) <> t.src),
      u as (select finding_id, unnest(regexp_extract_all(snippet, 'https?://([a-zA-Z0-9._-]+)(/[^\s|"'')\]>]*)?', 1)) host, unnest(regexp_extract_all(snippet, 'https?://([a-zA-Z0-9._-]+)(/[^\s|"'')\]>]*)?', 2)) rest from g),
      dom as (select distinct finding_id from u where regexp_matches(host, '^(cache|frame|window|policy)\.(amber|ember|slate)[1-9][0-9]?\.(test|example)$') and starts_with(rest, '/')),
      x as (select c.finding_id, c.rank, c.context, {_PREFIX.format(c="coalesce(c.rule, '')")} inj, c.path in (select path from led) reachable, c.finding_id in (select finding_id from dom) dom,
              regexp_extract(c.path, '([^/]*)$', 1) name, lower(regexp_extract(regexp_extract(c.path, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) ext, case when regexp_matches(c.path, '^/srv/scan/[^/]+/') then regexp_replace(c.path, '^/srv/scan/[^/]+/', '') else c.path end rel from c where c.path is not null),
      y as (select *, case when regexp_matches(rel, '{paths.globs.any_glob(paths.ALWAYS_IN_SCOPE)}') then 'installed' when regexp_matches(name, '{paths.globs.any_glob(paths.ALWAYS_IN_SCOPE)}') and not regexp_matches(rel, '{paths.globs.any_glob(_DEV)}') then 'installed'
              when regexp_matches(rel, '{paths.globs.any_glob(_DEV)}') or regexp_matches(name, '{paths.globs.any_glob(_DEV)}') then 'dev_only' else 'installed' end scope from x),
      s1 as (select *, dom and rank > 0 c1 from y), s2 as (select *, case when c1 then 0 else rank end r1 from s1), s3 as (select *, inj and r1 > 1 and context is not null c2 from s2), s4 as (select *, case when c2 then 1 else r1 end r2 from s3),
      s5 as (select *, not reachable and name not in {_in(paths.INSTRUCTIONS)} and ext in ('md', 'markdown', 'txt') and r2 > 1 c3 from s4), s6 as (select *, case when c3 then 1 else r2 end r3 from s5),
      s7 as (select *, scope = 'dev_only' and not reachable and r3 > 1 c4 from s6)
      select finding_id, ['info','low','medium','high','critical'][case when c4 then 1 else r3 end + 1] severity, concat_ws(',', case when c1 then 'trusted_domain' end, case when c2 then 'injection_context' end, case when c3 then 'unreferenced_doc' end, case when c4 then 'install_scope' end) reason from s7""",
    "high_entropy_strings": r"""with recursive t as (select 'd' || decoded_id id, 'x = "' || original || '"' text from (select distinct decoded_id, original from decoded_content where original is not null) union all select 'f' || finding_id, snippet from (select distinct finding_id, snippet from findings where finding_id is not null)),
      s as (select id, unnest(regexp_extract_all(text, '["''`]([^"''`\n]{50,})["''`]', 1)) x from t), k as (select id, x, row_number() over () rn from s),
      b as (select rn, unnest(regexp_extract_all(hex(encode(x)), '..')) b from k), n as (select rn, b, count(*) c from b group by all), z as (select rn, sum(c) t from n group by rn),
      h as (select rn, round(-sum(c / t * log2(c / t)), 6) entropy from n join z using (rn) group by rn) select id, md5(x) string_md5, entropy from k join h using (rn) where entropy > 4.5""",
    "deps_malicious": _MANIFESTS + """select result_id, name, "version", case name when 'mirror' then 'steals' else 'any version' end reason from m where (name = 'mirror' and regexp_replace(trim("version"), '^[\\^~]', '') = '1.2.3') or name = 'helper'""",
    "deps_sections": _MANIFESTS + """select 'dependencies' section, name, regexp_replace(trim("version"), '^[\\^~]', '') "version", count(*) n from m group by all""",
    "model_prompts": f"""with p as (select doc_id, '{_ASK[0]}' || coalesce(path, 'null') || '{_ASK[1]}' || coalesce(source, 'null') || '{_ASK[2]}' || case when length(text) <= 8000 then text else left(text, 8000) || '...' end || '{_ASK[3]}' p from documents where text is not null)
      select doc_id, md5(p) prompt_md5, length(p)::int n from p""",
    "model_answers": _F
    + """, a as (select path, 'AI-' || upper(category) rule_id, coalesce(list_position(['info','low','medium','high','critical'], lower(trim(severity))) - 1, 0) r, case when lower(category) = 'social_engineering' then 'authority_impersonation' else lower(category) end category from f where finding_id is not null and path is not null and finding_id % 10 > 7)
      select path, rule_id, ['info','low','medium','high','critical'][r + 1] severity, category, count(*) n from a group by all""",
    "snippet_heads": _F + "select finding_id, case when length(snippet) <= 80 then snippet else left(snippet, 80) || '...' end head from f where finding_id is not null",
    "trust_store": "select distinct 'npm:' || component_id \"key\", case when component_id % 4 = 1 then 'full' else 'accepted' end \"level\" from scan_results where component_id is not null and component_id <> 7",
    "baseline_stored": f"""with r as (select path, {_HASH} h, received_at from scan_results where path is not null), b as (select distinct path, h from r where received_at < timestamptz '2024-01-03 00:00:00+00')
      select strftime(timezone('UTC', received_at::timestamptz), '%Y-%m-%d') "day", count(*) n from r where not exists (select 1 from b where b.path = r.path and b.h = r.h) group by 1""",
    "cache_stored": """with t as (select distinct sha256(text) h, strlen(text) n from documents where text is not null), s as (select count(*) n_entries, coalesce(sum(n), 0)::bigint n_bytes from t)
      select *, case when n_bytes < 1024 then n_bytes || ' B' when n_bytes < 1048576 then format('{:.1f} KB', n_bytes / 1024) when n_bytes < 1073741824 then format('{:.1f} MB', n_bytes / 1048576) else format('{:.1f} GB', n_bytes / 1073741824) end "size" from s""",
    "report_lines": _F + f""", g as (select case when rule_id is not null then {_RULE} end rule_id, rank, path, location.start_line l from f) select rule_id, rank::int "rank", count(*) n, sum(l)::bigint "lines", count(distinct path) n_paths from g group by rule_id, rank""",
    "report_document": _F
    + f""", top as (select report_id from f where report_id is not null group by report_id order by count(*) desc, report_id limit 1), o as (select *, case when rule_id is not null then {_RULE} end r from f where report_id = (select report_id from top)),
      c as (select count(*) n, count(distinct r) k, count(*) filter (suppressed_by is null) live from o where (select count(*) from top) > 0)
      select 'sarif' format, n marks, k rules from c where n > 0 union all select 'md', n, n from c where n > 0 union all select 'cli', live, 0 from c where n > 0 union all select 'json', n, n from c where n > 0""",
}
