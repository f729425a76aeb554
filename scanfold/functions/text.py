"""Scalar functions on paths and texts, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["info", "low", "medium", "high", "critical"]


def extension(path: Column) -> Column:
    """The last dotted suffix in lower case; '' for none, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def line_of(prefix: Column) -> Column:
    """The 1-based line that follows the text before it."""
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"))) + 1).cast("int")


def column_of(prefix: Column) -> Column:
    """The 1-based column in bytes that follows the text before it."""
    return (F.octet_length(F.substring_index(prefix, "\n", -1)) + 1).cast("int")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n)), F.lit("...")))


def severity_rank(severity: Column, unknown: int | None = 2) -> Column:
    """0 to 4 for info to critical, in any case; aliases med and crit. Others get ``unknown``, null stays null."""
    low = F.lower(F.trim(severity))
    out = F.when(low.isNull(), None)
    for k, name in enumerate(SEVERITIES):
        out = out.when(low.isin(name, *{"medium": ["med"], "critical": ["crit"]}.get(name, [])), k)
    return out.otherwise(F.lit(unknown))


def pick(names: list[str], index: Column) -> Column:
    """The name at a 0-based index; null for a null index.

    The test is needed: with ANSI errors on, element_at of an array without nulls is taken to be never null.
    """
    return F.when(index.isNotNull(), F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int")))


def severity_name(rank: Column) -> Column:
    return pick(SEVERITIES, rank)


def sarif_level(rank: Column) -> Column:
    return F.when(rank >= 3, "error").when(rank == 2, "warning").otherwise("note")


def risk_label(score: Column) -> Column:
    return F.when(score == 0, "Clean").when(score <= 25, "Low Risk").when(score <= 50, "Moderate Risk").when(score <= 75, "High Risk").otherwise("Critical Risk")


def fingerprint(rule_id: Column, relative_path: Column, snippet: Column) -> Column:
    """SHA-256 over rule, path and trimmed snippet, separated by NUL; a null part counts as empty."""
    parts = [F.coalesce(x, F.lit("")) for x in (rule_id, relative_path, F.trim(snippet))]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def relative_path(path: Column, root: Column) -> Column:
    """The path below the root; unchanged if it isn't below it."""
    clean = F.regexp_replace(root, r"/+$", "")
    return F.when(F.startswith(path, F.concat(clean, F.lit("/"))), F.substr(path, F.length(clean) + 2)).otherwise(path)


def normal_path(path: Column) -> Column:
    """`.` and `..` folded, separators made `/`."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda acc, p: (
        F.when(p.isin(".", ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(path.rlike(r"^[/\\]"), "/").otherwise(""), F.array_join(folded, "/"))


def entropy(text: Column) -> Column:
    """Shannon entropy over the bytes, in bits; 0 for empty text."""
    codes = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    n = F.size(codes)
    share = lambda c: F.size(F.filter(codes, lambda x: x == c)) / n
    total = F.aggregate(F.transform(F.array_distinct(codes), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def is_printable(text: Column) -> Column:
    """More than 70 % letters, digits, white space and ASCII punctuation; false for empty text."""
    odd = F.regexp_replace(text, r"""[\p{L}\p{N}\s!-/:-@\[-`{-~]""", "")
    return (F.length(text) > 0) & ((F.length(text) - F.length(odd)) / F.greatest(F.length(text), F.lit(1)) > 0.7)
