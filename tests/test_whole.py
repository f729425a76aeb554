"""The whole scan, its settings, and the model hook."""

import json

import pytest
from pyspark.sql import functions as F

from scanfold.config import TEMPLATE, Config, write_template
from scanfold.engine import Engine
from scanfold.functions import model

RULES = [("INJECT-1", "ignore", "critical", ["(?i)ignore all"], [], True), ("X-1", "eval", "high", [r"\beval\s*\("], [], True), ("X-2", "bad", "low", ["(?=x)"], [], True)]


@pytest.fixture(scope="module")
def rules(spark):
    r = spark.createDataFrame(RULES, "rule_id string, title string, severity string, patterns array<string>, exclude_patterns array<string>, enabled boolean")
    none = F.array().cast("array<string>")
    return r.withColumns({"file_extensions": none, "file_names": none, "contexts": none})


def test_scan(spark, rules):
    payload = "'" + "eval(payload_from_afar)".encode().hex() + "'"
    files = spark.createDataFrame(
        [("/r/SKILL.md", "# s\nread docs/a.md"), ("/r/docs/a.md", "ignore all"), ("/r/docs/b.md", "ignore all"), ("/r/tests/t.js", "eval(1)"), ("/r/src/m.js", f"eval(1); x = {payload}"), ("/r/node_modules/z.js", "eval(1)"), ("/r/pic.png", "eval(1)"), ("/r/src/n.js", None)],
        "path string, text string",
    )
    e = Engine(spark, rules)
    assert [r[0] for r in e.rejected] == ["X-2"]
    found = e.scan(files, "/r")
    got = sorted((r.path, r.rule_id, r["rank"], r.reason) for r in found.collect())
    assert got == [
        ("/r/docs/a.md", "INJECT-1", 4, ""),
        ("/r/docs/b.md", "INJECT-1", 1, "unreferenced_doc"),
        ("/r/src/m.js", "OBFUSC-PAYLOAD", 4, ""),
        ("/r/src/m.js", "X-1", 3, ""),
        ("/r/tests/t.js", "X-1", 1, "install_scope"),
    ]
    s = e.summary(found).first()
    assert (s.n_findings, s.verdict, s.exit_code, s.risk_score) == (5, "DANGEROUS", 1, 99)
    base = found.where("rule_id <> 'X-1'")
    assert sorted(r.path for r in e.compare(found, base, "/r").collect()) == ["/r/src/m.js", "/r/tests/t.js"]


def test_config(tmp_path):
    p = tmp_path / "scanfold.toml"
    assert write_template(p) and not write_template(p) and p.read_text() == TEMPLATE
    c = Config.find(folder=str(tmp_path))
    assert c.skip_globs == ("**/CHANGELOG*", "**/LICENSE*") and c.min_severity == "low" and Config.find(folder="/nowhere", home="/nowhere") == Config()
    (tmp_path / "bad.toml").write_text("skip_glob = []")
    with pytest.raises(ValueError):
        Config.load(tmp_path / "bad.toml")
    assert c.profile([1]) != c.profile([2])


def test_model(spark):
    answer = json.dumps({"findings": [{"confidence": 0.9, "category": "social_engineering", "description": "d", "snippet": "s", "severity": "odd", "reasoning": "r"}, {"confidence": 0.5, "category": "x"}]})
    rows = [("a", json.dumps({"content": [{"text": answer}]})), ("b", json.dumps({"choices": [{"message": {"content": answer}}]})), ("c", json.dumps({"response": answer})), ("d", "nonsense"), ("e", None)]
    got = model.model_findings(spark.createDataFrame(rows, "path string, response string"), "path", "response").collect()
    assert sorted((r.path, r.rule_id, r["rank"], r.category) for r in got) == [(p, "AI-SOCIAL_ENGINEERING", 0, "authority_impersonation") for p in "abc"]
    q = spark.createDataFrame([("p.js", "js", "x" * 9000)], "p string, k string, t string").select("p", model.prompt(F.col("p"), F.col("k"), F.col("t")).alias("q"))
    assert "p.js" in q.first().q and len(q.first().q) < 9000
    assert [r.response for r in model.ask(q, "p", "q", lambda ps: [f"{len(ps)}"] * len(ps)).collect()] == ["1"]
    u = spark.createDataFrame([("https://github.com/a/b.git/",), ("git@github.com:a/c.git",)], "u string").select(model.repository_name(F.col("u")).alias("n"), model.is_repository_url(F.col("u")).alias("y"))
    assert [tuple(r) for r in u.collect()] == [("b", True), ("c", True)]
