"""Rules as data: loading, checking, and compiling their patterns for Spark.

A rule is a row; its patterns are regular expressions. The compiler rewrites them for Java,
and takes from each the literals that any match must hold, so that a scan can reject most
texts by plain substring search before a regular expression runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse

RULE_FILE = """category string, rules array<struct<id string, title string, description string, severity string, pattern string,
patterns array<string>, exclude_patterns array<string>, file_extensions array<string>, file_names array<string>, contexts array<string>,
remediation string, enabled boolean, category string, metadata struct<author string, author_url string, version string, created string, updated string,
`references` array<string>, tags array<string>>, test_cases struct<should_match array<string>, should_not_match array<string>>>>"""
RULE_COLUMNS = "rule_id title description severity category patterns exclude_patterns file_extensions file_names contexts remediation enabled source metadata".split()
CONTEXTS = ("code", "config", "message", "skill", "plugin")


def load_rules(spark: SparkSession, path: str, source: str = "external") -> DataFrame:
    """Rules of the JSON files at ``path`` (a file, a folder or a glob), one row each, in the columns of the rules table.

    ``patterns`` goes before ``pattern``; a rule with neither never matches. A file that doesn't parse gives no rule.
    """
    raw = spark.read.schema(RULE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    r = raw.select(F.col("category").alias("__c"), F.explode("rules").alias("r"))
    empty = F.array().cast("array<string>")
    meta = F.struct("r.metadata.*", F.col("r.test_cases").alias("test_cases"))
    return r.select(
        F.col("r.id").alias("rule_id"),
        "r.title",
        "r.description",
        F.lower("r.severity").alias("severity"),
        F.coalesce("r.category", "__c").alias("category"),
        F.coalesce("r.patterns", F.when(F.col("r.pattern").isNotNull(), F.array("r.pattern")), empty).alias("patterns"),
        *[F.coalesce(f"r.{c}", empty).alias(c) for c in ("exclude_patterns", "file_extensions", "file_names", "contexts")],
        "r.remediation",
        F.coalesce("r.enabled", F.lit(True)).alias("enabled"),
        F.lit(source).alias("source"),
        F.when(F.coalesce(F.col("r.metadata").isNotNull() | F.col("r.test_cases").isNotNull(), F.lit(False)), meta).alias("metadata"),
    )


def select_rules(rules: DataFrame, source: str | None = None, author: str | None = None, tag: str | None = None, rule_id: str | None = None) -> DataFrame:
    """Filters of a rule listing: source (equal), author (part, any case), tag (equal, any case), id (part, any case)."""
    if source:
        rules = rules.where(F.col("source") == source)
    if author:
        rules = rules.where(F.lower("metadata.author").contains(author.lower()))
    if tag:
        rules = rules.where(F.exists("metadata.tags", lambda t: F.lower(t) == tag.lower()))
    if rule_id:
        rules = rules.where(F.lower("rule_id").contains(rule_id.lower()))
    return rules


def java_pattern(pattern: str) -> str:
    """The pattern as Java must read it: Unicode classes, `.` that stops at line feeds only, `$` at the very end, or before line feeds under `m`."""
    out, in_class, k, lines = [], False, 0, [False]  # is `m` on, for each group that is open
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class:
            flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]*)?([:)])", pattern[k:])
            on = lines[-1] if not flags else "m" in flags[1] or lines[-1] and "m" not in (flags[2] or "")
            if flags and flags[3] == ")":
                lines[-1] = on
                out.append(flags[0])
                k += len(flags[0])
                continue
            lines.append(on)
        elif c == ")" and not in_class and len(lines) > 1:
            lines.pop()
        out.append("\\z" if c == "$" and not in_class and not lines[-1] else c)
        k += 1
    body = "".join(out)
    return ("(?Ud)" if re.search(r"\\[sSwWdDbB]|\.|\(\?i|(?<!\\)\$", body) else "") + body


def required_literals(pattern: str) -> tuple[list[str], bool]:
    """Texts that every match holds, the longest first, and whether case matters. None are found in odd patterns."""
    try:
        tree = sre_parse.parse(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))
    except Exception:
        return [], True
    exact = not (tree.state.flags & re.I or re.search(r"\(\?[a-z]*i", pattern))
    found: list[str] = []

    def walk(items) -> None:
        run = ""
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if len(run) > 0:
                found.append(run)
            run = ""
            if op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        if run:
            found.append(run)

    walk(tree)
    keep = sorted({x if exact else x.lower() for x in found if len(x) >= 2 and (exact or x.isascii())}, key=lambda x: (-len(x), x))
    return keep[:3], exact


@dataclass(frozen=True)
class Pattern:
    rule_id: str
    pattern_no: int
    pattern: str
    literals: tuple[str, ...]
    exact: bool
    excludes: tuple[str, ...]
    extensions: tuple[str, ...]
    names: tuple[str, ...]
    severity_rank: int
    title: str


def compile_rules(rules: DataFrame, context: str | None = None, disabled: tuple[str, ...] = ()) -> tuple[list[Pattern], list[tuple[str, str]]]:
    """(patterns to run, rejected): enabled rules that apply in the context.

    A rule whose pattern can't be compiled, can match the empty text, or uses what the rule language lacks
    (look-around, back-references) is rejected alone, with a message; the others go on. Rules come to the
    driver one by one: they are configuration. ``scan.matches`` takes them in blocks.
    """
    if context and context not in CONTEXTS:
        raise ValueError(f"unknown context {context!r}; one of {', '.join(CONTEXTS)}")
    rows = rules.where("enabled").select("rule_id", "title", "severity", "patterns", "exclude_patterns", "file_extensions", "file_names", "contexts").toLocalIterator()
    ranks = {"info": 0, "low": 1, "medium": 2, "med": 2, "high": 3, "critical": 4, "crit": 4}
    good, bad = [], []
    for r in sorted(rows, key=lambda r: r.rule_id or ""):
        if not r.rule_id or r.rule_id in disabled or context and r.contexts and context not in r.contexts:
            continue
        why = next((w for p in [*(r.patterns or []), *(r.exclude_patterns or [])] if (w := _fault(p))), None)
        if why:
            bad.append((r.rule_id, why))
            continue
        for k, p in enumerate(r.patterns or []):
            lits, exact = required_literals(p)
            low = lambda xs: tuple(x.lower().lstrip(".") for x in xs or [])
            good.append(
                Pattern(r.rule_id, k, p, tuple(lits), exact, tuple(r.exclude_patterns or []), low(r.file_extensions), tuple(x.lower() for x in r.file_names or []), ranks.get((r.severity or "").lower(), 2), r.title or "")
            )
    return good, bad


def _fault(pattern: str) -> str | None:
    if re.search(r"\(\?(?:=|!|<=|<!)", pattern):
        return "look-around isn't supported"
    if re.search(r"\\[1-9]", pattern):
        return "back-references aren't supported"
    try:
        if re.compile(re.sub(r"\\x\{[0-9A-Fa-f]+\}", "x", re.sub(r"\\p\{[^}]*\}|\\z", "x", pattern))).match(""):
            return "it matches the empty text"
    except re.error as x:
        return str(x)
    return None


def self_tests(rules: DataFrame) -> DataFrame:
    """One row per test case of a rule: (rule_id, expected, text, matched, passed). Each case is matched by itself,
    whatever the rule's files and contexts are."""
    cases = lambda name, want: rules.select("rule_id", "patterns", "exclude_patterns", F.lit(want).alias("expected"), F.explode(f"metadata.test_cases.{name}").alias("text"))
    t = cases("should_match", True).unionByName(cases("should_not_match", False))
    kept = lambda p: F.exists(F.regexp_extract_all("text", p, F.lit(0)), lambda m: ~F.exists("exclude_patterns", lambda x: F.regexp_like(m, x)))
    t = t.withColumn("matched", F.coalesce(F.exists("patterns", kept), F.lit(False)))
    return t.select("rule_id", "expected", "text", "matched", (F.col("matched") == F.col("expected")).alias("passed"))
