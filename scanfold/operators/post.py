"""What a finding's surroundings make of its severity, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.operators.paths import INSTRUCTIONS
from scanfold.operators.scan import CAP_EXEMPT
from scanfold.session import small

# Signs that a text detects attacks instead of being one.
SECURITY_PATHS = (
    "guard sentinel detector scanner security audit vettr bastion firewall protection shield defense defence sanitiz validator checker filter waf".split()
)
DETECTION_WORDS = "pattern regex detect test_case should_match blacklist blocklist denylist allowlist whitelist sanitize validate filter check match rule signature indicator".split()
REGEX_CALLS = ["re.compile(", "re.match(", "re.search(", "re.findall(", "re.sub(", "new regexp(", "regexp(", "regex::new(", "regexset::new(", "regex!("]
URL = r"""https?://([a-zA-Z0-9._-]+)(/[^\s|"')\]>]*)?"""
# Hosts of common installers.
TRUSTED_DOMAINS = [
    ("ollama.com", None, "LLM runtime installer"), ("sh.rustup.rs", None, "Rust toolchain installer"), ("brew.sh", None, "package manager"), ("get.docker.com", None, "container engine installer"),
    ("install.python-poetry.org", None, "Python packaging"), ("get.sdkman.io", None, "JVM toolkit"), ("starship.rs", None, "shell prompt"), ("bun.sh", None, "JavaScript runtime"), ("deno.land", None, "JavaScript runtime"),
    ("code.visualstudio.com", None, "editor"), ("ohmyz.sh", None, "shell framework"), ("get.rvm.io", None, "Ruby versions"), ("raw.githubusercontent.com", "/nvm-sh", "Node versions"),
    ("raw.githubusercontent.com", "/Homebrew", "package manager"), ("foundry.paradigm.xyz", None, "contract toolchain"), ("astral.sh", None, "Python toolchain"), ("tailscale.com", None, "VPN"), ("fnm.vercel.app", None, "Node versions"),
]
HIGH_DENSITY = 4
MAX_DOMAINS = 100_000  # of a file of trusted hosts, which is configuration


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def in_string_literal(snippet: Column) -> Column:
    """Raw strings, calls that make regular expressions, regular expression literals, or a detection word beside a quote."""
    line, low = F.trim(snippet), F.lower(F.trim(snippet))
    raw = _any(line, ['r"', "r'", 'r#"'])
    calls = _any(low, REGEX_CALLS)
    # slashes are used up in pairs, so a pair that is too short hides the next one
    literal = line.rlike(r"^(?:[^/]|(?<=[0-9)])/|/(?:\\.|[^/\\]){0,2}/)*?(?<![0-9)])/(?:\\.|[^/\\]){2,}(?:\\.|[^/\\])/")
    words = _any(low, DETECTION_WORDS) & (line.contains('"') | line.contains("'"))
    return raw | calls | literal | words


def detection_context(snippet: Column, path: Column, injections: Column) -> Column:
    """Why an injection finding is likely a detector's own; null if it isn't. The first reason counts."""
    return (
        F.when(in_string_literal(snippet), "string_literal")
        .when(_any(F.lower(path), SECURITY_PATHS), "security_tool_path")
        .when(F.coalesce(injections, F.lit(0)) >= HIGH_DENSITY, "high_density")
    )


def is_injection(rule_id: Column, families: tuple[str, ...] = ("INJECT-", "AUTH-")) -> Column:
    """Does the rule belong to a family that reports injected instructions?"""
    out = F.lit(False)
    for f in families:
        out = out | F.coalesce(rule_id.startswith(f), F.lit(False))
    return out


def load_domains(spark: SparkSession, *files: str) -> list[tuple]:
    """The hosts of JSON files, official ones first as they are given: (host, path prefix or None, purpose)."""
    schema = "domains array<struct<domain string, path_prefix string, purpose string>>"
    out = []
    for f in files:
        rows = spark.read.schema(schema).option("multiLine", True).json(f).select(F.explode("domains").alias("d")).select("d.*").limit(MAX_DOMAINS + 1).collect()
        if len(rows) > MAX_DOMAINS:
            raise ValueError(f"{f} has more than {MAX_DOMAINS} hosts")
        out += [tuple(r) for r in rows if r.domain]
    return out


def trusted_domain(findings: DataFrame, row_id: str, snippet: str, domains: list[tuple] | None = None) -> DataFrame:
    """(row_id, trusted_domain): the first installer host a snippet's addresses name, by the order of the list."""
    rows = [(k, d, p, f"{d} ({why})") for k, (d, p, why) in enumerate(TRUSTED_DOMAINS if domains is None else domains)]
    table = findings.sparkSession.createDataFrame(rows, "ord int, host string, prefix string, label string")
    urls = F.arrays_zip(F.regexp_extract_all(snippet, F.lit(URL), F.lit(1)).alias("h"), F.regexp_extract_all(snippet, F.lit(URL), F.lit(2)).alias("p"))
    u = findings.where(F.col(snippet).contains("://")).select(row_id, F.posexplode_outer(urls).alias("n", "u")).where(F.col("u").isNotNull()).select(row_id, "n", F.col("u.h").alias("host"), F.col("u.p").alias("rest"))
    hit = u.join(small(table), "host").where(F.col("prefix").isNull() | F.startswith("rest", "prefix"))
    return hit.groupBy(row_id).agg(F.min_by("label", F.struct("n", "ord")).alias("trusted_domain"))


def adjust(findings: DataFrame, injection: Column, include_dev: bool = False, manifest_based: bool = False) -> DataFrame:
    """Findings with ``rank`` adjusted, and ``original_rank`` and ``reason`` where it was.

    Needs the columns rank, rule_id, path, snippet, trusted_domain, reachable, scope and injections. In order:
    a trusted installer's address makes it info; an injection in the context of detection, low; a document no
    instruction leads to, low; development files, low unless the rule's family is exempt. Each step sees the
    severity the one before left; the first change keeps the original.
    """
    ext = T.extension(F.col("path"))
    exempt = F.lit(False)
    for p in () if manifest_based else CAP_EXEMPT:
        exempt = exempt | F.coalesce(F.col("rule_id").startswith(p), F.lit(False))
    steps = [
        ("trusted_domain", F.col("trusted_domain").isNotNull() & (F.col("__r") > 0), 0),
        ("injection_context", injection & (F.col("__r") > 1) & detection_context(F.col("snippet"), F.col("path"), F.col("injections")).isNotNull(), 1),
        ("unreferenced_doc", ~F.col("reachable") & ~T.file_name(F.col("path")).isin(*INSTRUCTIONS) & ext.isin("md", "markdown", "txt") & (F.col("__r") > 1), 1),
    ]
    if not include_dev:
        steps.append(("install_scope", (F.col("scope") == "dev_only") & ~F.col("reachable") & ~exempt & (F.col("__r") > 1), 1))
    out = findings.withColumns({"__r": F.col("rank"), "reason": F.lit("")})
    for name, cond, to in steps:
        c = F.coalesce(cond, F.lit(False))
        out = out.withColumn("__c", c).withColumns({"__r": F.when(F.col("__c"), to).otherwise(F.col("__r")), "reason": F.when(F.col("__c"), F.concat_ws(",", F.nullif("reason", F.lit("")), F.lit(name))).otherwise(F.col("reason"))})
    return out.withColumns({"original_rank": F.when(F.col("reason") != "", F.col("rank")), "rank": F.col("__r")}).drop("__r", "__c")
