"""Canonical forms of keys that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_key(rule_id: Column) -> Column:
    """One form for all writings of a rule id.

    Case, outer white space, the separator between letters and number, and leading
    zeros of the number don't matter: `grant_5`, ` GRANT-005`, `GRANT005` are one
    rule. An id of another shape stands for itself, trimmed and in upper case. A
    null or blank id gives null.
    """
    up = F.upper(F.regexp_replace(rule_id, r"^[\s ]+|[\s ]+$", ""))
    shape = r"^([A-Z]+)[^A-Z0-9]*0*([0-9]+)$"
    word, number = F.regexp_extract(up, shape, 1), F.regexp_extract(up, shape, 2)
    return F.when(word != "", F.concat(word, F.lit("-"), number)).otherwise(F.when(up != "", up))


def hash_key(content_hash: Column) -> Column:
    """The 64 lower-case hex digits of a SHA-256 hash, null if it is none.

    Outer white space, case and a `sha256:` or `sha256-` mark don't matter.
    """
    low = F.lower(F.regexp_replace(content_hash, r"^[\s ]+|[\s ]+$", ""))
    got = F.regexp_extract(low, r"^(?:sha-?256\s*[:=-]\s*)?(?:0x)?([0-9a-f]{64})$", 1)
    return F.when(got != "", got)
