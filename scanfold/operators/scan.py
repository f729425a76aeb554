"""Scanning a table of texts with a table of rules.

The join of texts and patterns runs in two steps. First every text gets the list of the
patterns that could match it: those whose files it is of, and whose required literals it
holds. That is substring search, and leaves few pairs. Then each pair's regular expression
runs in the JVM. Of the pairs that match, the few that there are, the texts between the matches
give the places (``places``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.operators import places
from scanfold.rules import Pattern, java_pattern
from scanfold.session import spread

DOC_EXTENSIONS = ["md", "txt", "rst", "adoc"]
CAP_EXEMPT = ("INJECT-", "AUTH-", "HIDDEN-", "MDCODE-")
MAX_SCAN_BYTES = 10 << 20
BLOCK = 5_000  # patterns of one pass over the texts
BITS = 60  # literals in one set
GROUP = 60  # patterns in one expression: larger ones exceed what the JVM compiles


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _candidates(patterns: list[Pattern]) -> tuple[list[str], str]:
    """Bit sets of the literals that a row with the columns __t and __low holds, and array<int> of the patterns that could match it.

    Patterns share literals, so each is looked for once; what a pattern needs is a mask of the sets __b0, __b1, ... The columns __ext and
    __name say which rules are for the file. SQL texts: as expressions put together piece by piece they would cost the driver a second.
    """
    at = {x: k for k, x in enumerate(dict.fromkeys((p.exact, x) for p in patterns for x in p.literals))}
    looks = [f"CASE WHEN contains({'__t' if exact else '__low'}, {_quoted((x,))}) THEN {1 << k % BITS}L ELSE 0L END" for (exact, x), k in at.items()]
    sets = [" | ".join(looks[a : a + BITS]) for a in range(0, len(looks), BITS)]
    by_files: dict[tuple, list[str]] = {}
    for k, p in enumerate(patterns):
        masks: dict[int, int] = {}
        for x in p.literals:
            n = at[p.exact, x]
            masks[n // BITS] = masks.get(n // BITS, 0) | 1 << n % BITS
        holds = " AND ".join(f"(__b{n} & {m}L) = {m}L" for n, m in masks.items())
        by_files.setdefault((p.extensions, p.names), []).append(f"CASE WHEN {holds or 'true'} THEN {k} END")
    parts = []
    for (exts, names), group in by_files.items():
        applies = " AND ".join(f"{c} IN ({_quoted(v)})" for c, v in (("__ext", exts), ("__name", names)) if v) or "true"
        for a in range(0, len(group), GROUP):
            parts.append(f"CASE WHEN {applies} THEN array_compact(array({', '.join(group[a : a + GROUP])})) ELSE CAST(array() AS array<int>) END")
    return sets, f"flatten(array({', '.join(parts)}))" if parts else "CAST(array() AS array<int>)"


def matches(files: DataFrame, patterns: list[Pattern], row_id: str, text: str, path: str, max_bytes: int = MAX_SCAN_BYTES) -> DataFrame:
    """(row_id, path, rule_id, title, rule_rank, pattern_no, match_no, matched, byte_offset, end_offset, line, col, end_line, snippet).

    Every non-overlapping match of every pattern, in order, less those whose matched text alone an exclude pattern
    matches. Null and empty texts have none. Texts of more than ``max_bytes`` aren't scanned, which ``results`` reports.
    Offsets count bytes, lines and columns from 1. More than ``BLOCK`` patterns take a pass over the texts for each block.
    """
    spark = files.sparkSession
    if len(patterns) > BLOCK:
        parts = [matches(files, patterns[a : a + BLOCK], row_id, text, path, max_bytes) for a in range(0, len(patterns), BLOCK)]
        return reduce(DataFrame.unionByName, parts)
    rows = [(k, p.rule_id, p.pattern_no, java_pattern(p.pattern), list(map(java_pattern, p.excludes)), p.severity_rank, p.title) for k, p in enumerate(patterns)]
    table = spark.createDataFrame(rows, "__k int, rule_id string, pattern_no int, __p string, __x array<string>, rule_rank int, title string")
    src = files.select(F.col(row_id).alias("__id"), F.col(path).alias("__path"), F.col(text).alias("__t")).where((F.octet_length("__t") > 0) & (F.octet_length("__t") <= max_bytes))
    low = F.lower("__t") if any(not p.exact for p in patterns) else F.col("__t")
    src = spread(src).select("*", low.alias("__low"), T.extension(F.col("__path")).alias("__ext"), F.lower(T.file_name(F.col("__path"))).alias("__name"))
    sets, candidates = _candidates(patterns)
    src = src.select("*", *[F.expr(x).alias(f"__b{k}") for k, x in enumerate(sets)])
    # explode would add a filter on the list, and with it build the list twice
    pairs = src.select("__id", "__path", "__t", F.explode_outer(F.expr(candidates)).alias("__k")).where(F.col("__k").isNotNull()).join(F.broadcast(table), "__k")  # at most BLOCK rows
    found = pairs.withColumn("__m", F.regexp_extract_all("__t", F.col("__p"), F.lit(0))).where(F.size("__m") > 0).withColumn("__g", F.split("__t", F.col("__p"), -1))
    each = places.placed(found.select("__id", "__path", "rule_id", "title", "rule_rank", "pattern_no", "__x", "__m", "__g"), "__m", "__g")
    return each.where(~F.exists("__x", lambda x: F.regexp_like("matched", x))).drop("__x").withColumnsRenamed({"__id": row_id, "__path": path})


def results(files: DataFrame, row_id: str, text: str, path: str, max_bytes: int = MAX_SCAN_BYTES) -> DataFrame:
    """(row_id, path, content_hash, n_bytes, scanned): one row for each file, also for those too large to be scanned, which have no hash."""
    n = F.octet_length(text)
    small_enough = F.coalesce(n <= max_bytes, F.lit(True))
    return files.select(row_id, path, F.when(small_enough, F.sha2(F.coalesce(text, F.lit("")), 256)).alias("content_hash"), F.coalesce(n, F.lit(0)).alias("n_bytes"), small_enough.alias("scanned"))


def snippet(text: Column, start: Column, end: Column, around: int = places.CONTEXT_BYTES) -> Column:
    """One match's snippet as an expression: the text from ``around`` bytes before to as many after, widened to whole characters.

    `...` stands where it is clipped, a line feed is shown as the two characters ``\\n``.
    """
    data = F.encode(text, "utf-8")
    n = F.octet_length(text)
    inside = lambda p: F.hex(F.substr(data, (p + 1).cast("int"), F.lit(1))).rlike("^[89AB]")

    def widen(p: Column, step: int) -> Column:
        out = p + 3 * step
        for k in (2, 1, 0):
            out = F.when(~inside(p + k * step), p + k * step).otherwise(out)
        return out

    a = F.greatest(start - around, F.lit(0))
    b = F.least(end + around, n)
    a = F.when(a > 0, widen(a, -1)).otherwise(a)
    b = F.when(b < n, widen(b, 1)).otherwise(b)
    body = F.decode(F.substr(data, (a + 1).cast("int"), (b - a).cast("int")), "utf-8")
    shown = F.replace(body, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.when(a > 0, "...").otherwise(""), shown, F.when(b < n, "...").otherwise(""))


def findings(files: DataFrame, patterns: list[Pattern], row_id: str, text: str, path: str, min_rank: int = 0) -> DataFrame:
    """Matches as findings: severity capped to low in documentation unless the rule is of a content family."""
    m = matches(files, patterns, row_id, text, path)
    exempt = F.lit(False)
    for x in CAP_EXEMPT:
        exempt = exempt | F.col("rule_id").startswith(x)
    capped = T.extension(F.col(path)).isin(*DOC_EXTENSIONS) & ~exempt
    rank = F.when(capped, F.least("rule_rank", F.lit(1))).otherwise(F.col("rule_rank"))
    return m.withColumn("sev_rank", rank).withColumn("severity", T.severity_name(F.col("sev_rank"))).where(F.col("sev_rank") >= min_rank)
