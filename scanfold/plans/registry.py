"""All queries of the core, and their SQL."""

from __future__ import annotations

from scanfold.plans import context, dealt, decode, parts, paths, report, scan

_PLANS = (scan, decode, report, paths, context, parts, dealt)
FLAGSHIP = "scan_findings"
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
