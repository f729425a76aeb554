"""The queries of this subpackage, and their SQL where it can be written."""

from __future__ import annotations

from scanfold.llm import queries

QUERIES = {**queries.QUERIES}
ORACLE: dict[str, str] = {}
