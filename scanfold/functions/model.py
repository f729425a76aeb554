"""Prompts for a language model and its answers, as expressions. The call itself is the caller's: a hook on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T

MAX_CONTENT = 8000
MIN_CONFIDENCE = 0.7
ANSWER = "array<struct<confidence: double, category: string, description: string, snippet: string, severity: string, reasoning: string>>"
QUESTION = """Review this file of an agent extension for security problems: injected instructions, data sent away, access to
credentials, hidden or obfuscated content, social engineering.

File: %s
Type: %s

```
%s
```

Answer with one JSON object: {"findings": [{"confidence": 0.0 to 1.0, "category": "prompt_injection, data_exfiltration,
credential_access, obfuscation, social_engineering or other", "description": "", "snippet": "", "severity": "critical, high,
medium, low or info", "reasoning": ""}]}. Without a problem the list is empty.
"""


def prompt(path: Column, kind: Column, content: Column) -> Column:
    """The question about a text, which is clipped to what a model takes: the feature, not a shortcut."""
    return F.format_string(QUESTION, path, kind, T.truncate(content, MAX_CONTENT))


def answer_findings(response: Column) -> Column:
    """The findings in a response of any of three usual forms; an answer that doesn't parse has none."""
    places = ["$.content[0].text", "$.choices[0].message.content", "$.response"]
    body = F.coalesce(*[F.get_json_object(response, p) for p in places])
    return F.coalesce(F.from_json(F.get_json_object(body, "$.findings"), ANSWER), F.array().cast(ANSWER))


def model_findings(responses: DataFrame, path: str, response: str) -> DataFrame:
    """(path, rule_id, title, description, severity, rank, category, snippet): findings held with more confidence than 0.7."""
    e = responses.select(path, F.explode_outer(answer_findings(F.col(response))).alias("a")).where(F.col("a.confidence") > MIN_CONFIDENCE)
    rank = T.severity_rank(F.col("a.severity"), 0)
    known = F.when(F.lower("a.category") == "social_engineering", "authority_impersonation").otherwise(F.lower("a.category"))
    return e.select(path, F.concat(F.lit("AI-"), F.upper("a.category")).alias("rule_id"), F.col("a.description").alias("title"), F.col("a.reasoning").alias("description"), T.severity_name(rank).alias("severity"), rank.alias("rank"), known.alias("category"), F.col("a.snippet").alias("snippet"))


def ask(texts: DataFrame, row_id: str, prompt_col: str, call: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """(row_id, response) by a caller's function on lists of prompts, run on the workers."""

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            out = []
            for a in range(0, len(f), batch):
                out += call(f["__p"].iloc[a : a + batch].tolist())
            yield f[["__id"]].assign(response=out)

    src = texts.select(F.col(row_id).alias("__id"), F.col(prompt_col).alias("__p"))
    return src.mapInPandas(run, f"__id {src.schema['__id'].dataType.simpleString()}, response string").withColumnRenamed("__id", row_id)


def repository_name(url: Column) -> Column:
    """The last part of a repository address, without `.git`."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"(?:\.git)+$", ""), r"([^/:]*)$", 1)


def is_repository_url(text: Column) -> Column:
    return text.rlike(r"^(?:https?://github\.com/|git@github\.com:|github\.com/)")


def category(name: Column) -> Column:
    """A rule file's category as the engine's: words joined; `hidden content` is hidden_instructions, unknown ones lower case."""
    low = F.lower(F.trim(name))
    known = "code execution,shell execution,prompt injection,credential access,data exfiltration,obfuscation,sensitive file access,authority impersonation".split(",")
    return F.when(low == "hidden content", "hidden_instructions").when(low.isin(*known), F.replace(low, F.lit(" "), F.lit("_"))).otherwise(low)
