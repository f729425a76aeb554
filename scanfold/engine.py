"""The scan as a whole: from files to adjusted, trusted and compared findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold import rules as R
from scanfold.config import Config
from scanfold.functions import text as T
from scanfold.operators import components, decode, js, paths, post, report, scan, trace, trust

COLUMNS = "path rule_id title description snippet rank start_line start_column end_line byte_offset".split()


def text_source(spark: SparkSession, text: str, kind: str = "txt") -> DataFrame:
    """A text given as an argument or on standard input, as a table of one file (path, text). A blank one is an error."""
    if not text.strip():
        raise ValueError("there is no text to scan")
    return spark.createDataFrame([(f"<stdin>.{kind}", text)], "path string, text string")


class Engine:
    """Scans tables of files (path, text) with a table of rules.

    ``rules`` is in the columns of the rules table; ``config.rule_folders`` add to it. Rules that can't be used are
    listed in ``rejected``, the others run.
    """

    def __init__(self, spark: SparkSession, rules: DataFrame, config: Config | None = None, context: str | None = None):
        self.spark, self.config = spark, config or Config()
        for folder in self.config.folders():
            rules = rules.select(*R.RULE_COLUMNS).unionByName(R.load_rules(spark, folder), allowMissingColumns=True)
        self.rules = rules
        self.patterns, self.rejected = R.compile_rules(rules, context, self.config.disabled_rules)
        self.profile = self.config.profile(self.patterns)

    def check(self, texts: DataFrame, path: str = "path", text: str = "text", decode_depth: int = decode.MAX_DEPTH, with_scripts: bool = True) -> DataFrame:
        """Findings of the texts by themselves: rules, hidden payloads, entropy, scripts. No surroundings, no trust."""
        files = texts.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
        known = files.withColumn("file", F.col("path"))
        f = scan.findings(known, self.patterns, "path", "text", "file").withColumns({"description": F.col("matched"), "rank": F.col("sev_rank")})
        out = f.withColumnsRenamed({"line": "start_line", "col": "start_column"}).select(*COLUMNS)
        if decode_depth:
            layers = decode.decode_layers(files, "path", "text", decode_depth)
            hidden = layers.select(F.struct("path", "depth", "byte_offset").alias("key"), "decoded", "path").withColumn("key", F.to_json("key"))
            hit = scan.matches(hidden, self.patterns, "key", "decoded", "path")
            per = hit.groupBy("key", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "pattern_no", "match_no", "title"))), lambda x: x["title"]), ", ").alias("description"), F.min("matched").alias("snippet"))
            out = out.unionByName(self._plain(per, "OBFUSC-PAYLOAD", "Hidden payload", 4))
        strings = decode.high_entropy(files, "path", "text", self.config.entropy_threshold)
        out = out.unionByName(self._plain(strings.select("path", F.lit(None).cast("string").alias("description"), T.truncate(F.col("string"), 80).alias("snippet")), "ENTROPY-001", "High entropy string", 1))
        if with_scripts:
            a = js.ast_findings(known, "path", "text", "file")
            a = a.select("path", "rule_id", F.col("function").alias("title"), F.lit(None).cast("string").alias("description"), F.col("function").alias("snippet"), T.severity_rank(F.col("severity")).alias("rank"), F.col("line").alias("start_line"))
            out = out.unionByName(a, allowMissingColumns=True)
        return out.where(F.col("rank") >= T.SEVERITIES.index(self.config.min_severity))

    @staticmethod
    def _plain(df: DataFrame, rule: str, title: str, rank: int) -> DataFrame:
        none = F.lit(None)
        return df.select("path", F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), "description", "snippet", F.lit(rank).alias("rank"), none.cast("int").alias("start_line"), none.cast("int").alias("start_column"), none.cast("int").alias("end_line"), none.cast("long").alias("byte_offset"))

    def scan(self, files: DataFrame, root: str, whitelist: list[str] | None = None) -> DataFrame:
        """Findings of the files below ``root``, adjusted to their surroundings; ``whitelist`` is what a manifest ships.

        Adds scope, reachable, component_root, content_hash, reason, original_rank and suppressed_by (null, see ``trust``).
        """
        cfg = self.config.skip()
        kept = files.where(paths.is_scanned(F.col("path")) & ~F.coalesce(paths.should_skip(F.col("path"), cfg), F.lit(False)))
        if self.config.third_party_only:
            kept = kept.where(~paths.is_trusted_source(F.col("path"), cfg))
        kept = kept.select("path", "text", F.lit(root).alias("root"))
        starts = kept.where(trace.is_instruction(F.col("path"))).select(F.col("path").alias("instruction"))
        led = trace.referenced_by(trace.reachable(trace.references(kept, "path", "text", "root"), starts))
        info = kept.select("path", F.sha2("text", 256).alias("content_hash"), paths.install_scope(T.relative_path(F.col("path"), F.lit(root)), whitelist).alias("scope"))
        info = components.assign(info.join(led, "path", "left").withColumn("reachable", F.col("referenced_by").isNotNull()), "path", components.detect(kept, "path", "text"))
        found = self.check(kept)
        injection = F.col("rule_id").rlike("^(?:INJECT|AUTH)-")
        count = found.where(injection).groupBy("path").agg(F.count("*").alias("injections"))
        found = found.withColumn("__n", F.xxhash64("path", "rule_id", "byte_offset", "snippet"))
        hosts = post.trusted_domain(found, "__n", "snippet")
        joined = found.join(info, "path").join(count, "path", "left").join(hosts, "__n", "left")
        out = post.adjust(joined, injection, self.config.include_dev, whitelist is not None).drop("__n", "injections")
        return out.where(F.col("rank") >= T.SEVERITIES.index(self.config.min_severity)).withColumn("suppressed_by", F.lit(None).cast("string"))

    def trust(self, findings: DataFrame, decisions: DataFrame) -> DataFrame:
        """``suppressed_by`` from decisions (key, component_hash, level, accepted_rules) on components, keyed by folder."""
        hashes = report.component_hash(findings.select("component_root", "content_hash").where(F.col("component_root").isNotNull()), "component_root", "content_hash")
        j = findings.drop("suppressed_by").join(hashes, "component_root", "left")
        return trust.apply_trust(j, decisions, "component_root", "component_hash", "rule_id").drop("component_hash")

    def compare(self, findings: DataFrame, baseline: DataFrame, root: str) -> DataFrame:
        """Findings that a baseline, an earlier result of ``scan``, doesn't hold."""
        mark = lambda df: df.withColumn("fingerprint", T.fingerprint(F.col("rule_id"), T.relative_path(F.col("path"), F.lit(root)), F.col("snippet")))
        return trust.new_findings(mark(findings), mark(baseline)).drop("fingerprint")

    def summary(self, findings: DataFrame) -> DataFrame:
        """One row: counts, scores, verdict, gate and exit code of all findings."""
        out = report.summary(findings.withColumn("__all", F.lit(1)), ["__all"]).drop("__all", "max_active_rank")
        return out
