"""Report sinks: JSON, SARIF, Markdown and a terminal text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T

FORMATS = {"json": "json", "sarif": "sarif", "md": "markdown", "markdown": "markdown", "cli": "text", "text": "text", "terminal": "text"}
MAX_SHOWN = 100_000  # findings of a document that is put together on the driver


def sarif_results(findings: DataFrame, rank: str = "rank", root: str | None = None) -> DataFrame:
    """SARIF's results as rows: rule_id, level, message, uri, start_line, start_column, suppressed. Suppressed ones stay."""
    uri = F.col("path") if root is None else T.relative_path(F.col("path"), F.lit(root))
    return findings.select("rule_id", T.sarif_level(F.col(rank)).alias("level"), F.col("title").alias("message"), uri.alias("uri"), "start_line", "start_column", F.col("suppressed_by").isNotNull().alias("suppressed"))


def sarif_rules(findings: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """SARIF's distinct rules: each described by its first finding in the given order."""
    first = F.min_by(F.struct("title", "description", T.sarif_level(F.col(rank)).alias("level")), F.struct(*order))
    return findings.where(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(first.alias("x")).select("rule_id", "x.*")


def write_json(findings: DataFrame, path: str) -> None:
    """One JSON object per finding and line, with as many files as partitions."""
    findings.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _bounded(findings: DataFrame) -> list:
    rows = findings.limit(MAX_SHOWN + 1).collect()
    if len(rows) > MAX_SHOWN:
        raise ValueError(f"more than {MAX_SHOWN} findings for one document; write them as JSON lines instead")
    return rows


def sarif_document(findings: DataFrame, tool: str, version: str, root: str | None = None) -> str:
    """A SARIF 2.1.0 file of one report; refuses more findings than ``MAX_SHOWN``."""
    results = [r.asDict() for r in _bounded(sarif_results(findings, root=root).orderBy("uri", "start_line", "rule_id"))]
    rules = [r.asDict() for r in _bounded(sarif_rules(findings, ["path", "start_line"]).orderBy("rule_id"))]

    def result(r: dict) -> dict:
        region = {k: v for k, v in (("startLine", r["start_line"]), ("startColumn", r["start_column"])) if v is not None}
        return {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": region}}]}

    described = [{"id": r["rule_id"], "shortDescription": {"text": r["title"] or ""}, "fullDescription": {"text": r["description"] or ""}, "defaultConfiguration": {"level": r["level"]}} for r in rules]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": described}}, "results": [result(r) for r in results]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=2)


def markdown(findings: DataFrame, summary: dict) -> str:
    """A Markdown report: summary table, counts by severity, and each finding."""
    rows = _bounded(findings.orderBy(F.desc("rank"), "path", "start_line"))
    out = ["# Scan report", "", "| | |", "|-|-|", *[f"| {k} | {v} |" for k, v in summary.items()], "", "## Findings by severity", ""]
    for k in range(4, -1, -1):
        out.append(f"- {T.SEVERITIES[k]}: {sum(r['rank'] == k for r in rows)}")
    out += ["", "## Findings", ""]
    for r in rows:
        out += [f"### {r['rule_id']}: {r['title']}", "", f"- severity: {T.SEVERITIES[r['rank']]}", f"- place: `{r['path']}:{r['start_line']}`", "", "```", r["snippet"] or "", "```", ""]
    return "\n".join(out)


def terminal(findings: DataFrame, verdict: str) -> str:
    """The report as plain text: by component where ``findings`` has the column component, files of none under Other files.

    Each component has its files, findings and risk on top; suppressed findings are only counted.
    """
    named = findings if "component" in findings.columns else findings.withColumn("component", F.lit(None).cast("string"))
    rows = _bounded(named.orderBy(F.asc_nulls_last("component"), "path", F.desc("rank"), "start_line"))
    out, component, path = [], 0, 0
    for r in (r for r in rows if r["suppressed_by"] is None):
        if r["component"] != component:
            component, path = r["component"], 0
            own = [x for x in rows if x["component"] == component and x["suppressed_by"] is None]
            risk = T.SEVERITIES[max(x["rank"] for x in own)].upper()
            out += [f"-- {component or 'Other files'} --", f"   Files: {len({x['path'] for x in own})} | Findings: {len(own)} | Risk: {risk}"]
        if r["path"] != path:
            path = r["path"]
            out.append(path or "(no file)")
        out.append(f"  {T.SEVERITIES[r['rank']].upper():8} {r['rule_id']} line {r['start_line']}: {r['title']}")
    hidden = sum(r["suppressed_by"] is not None for r in rows)
    return "\n".join([*out, f"{hidden} suppressed", f"Verdict: {verdict}"])


def render(findings: DataFrame, fmt: str, summary: dict, tool: str = "scanfold", version: str = "0") -> str:
    """The report in a format by name or alias."""
    kind = FORMATS.get(fmt.lower())
    if kind is None:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if kind == "json":
        return json.dumps({"summary": summary, "findings": [r.asDict(True) for r in _bounded(findings)]}, indent=2, default=str)
    if kind == "sarif":
        return sarif_document(findings, tool, version)
    return markdown(findings, summary) if kind == "markdown" else terminal(findings, summary.get("verdict", ""))
