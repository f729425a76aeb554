"""Obfuscated calls in JavaScript and TypeScript, recognised from tokens.

A small tokenizer cuts the source; the detectors look at short runs of tokens, and at the
names that assignments, imports and destructuring bind to dangerous functions. It runs in
Python, as no built-in expression can follow names, on files of the right kinds only, and
only on those that mention one of the names that matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.session import spread

# What is dangerous, and which rule reports it.
GLOBALS = {"window", "globalThis", "global", "self", "this"}
FUNCTIONS = {"eval", "Function", "setTimeout", "setInterval", "setImmediate"}
SHELL_MODULES = {"child_process", "node:child_process"}
SHELL_EXPORTS = {"exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync", "fork"}
EXTENSIONS = "js mjs cjs jsx ts tsx mts cts".split()
STRATEGIES = {
    "computed_access": ("AST-EXEC-001", "critical", "Computed access to a dangerous function"),
    "variable_aliasing": ("AST-EXEC-002", "critical", "Call through an alias of a dangerous function"),
    "string_concat": ("AST-EXEC-003", "critical", "Function name put together from strings"),
    "escape_sequences": ("AST-EXEC-004", "critical", "Function name written in escapes"),
    "comma_operator": ("AST-EXEC-005", "critical", "Indirect call by the comma operator"),
    "destructured_alias": ("AST-SHELL-001", "high", "Shell function under another name"),
}
OPENS_NO_SCOPE = {"if", "for", "while", "switch", "catch", "with"}


@dataclass(frozen=True)
class ScriptRules:
    """What the detectors look for: names, modules with their exports, and strategy -> (rule id, severity, title) of those enabled."""

    globals: frozenset = frozenset(GLOBALS)
    functions: frozenset = frozenset(FUNCTIONS)
    modules: dict = field(default_factory=lambda: {m: frozenset(SHELL_EXPORTS) for m in SHELL_MODULES})
    strategies: dict = field(default_factory=lambda: dict(STRATEGIES))


def load_script_rules(path: str) -> ScriptRules:
    """Rules of a JSON file with ``dangerous_lists`` and ``detectors``; disabled detectors and unknown strategies are left out."""
    with open(path) as f:
        data = json.load(f)
    lists = data["dangerous_lists"]
    on = {d["strategy"]: (d["id"], d["severity"], d["title"]) for d in data["detectors"] if d.get("enabled", True) and d["strategy"] in STRATEGIES}
    return ScriptRules(frozenset(lists["globals"]), frozenset(lists["functions"]), {m: frozenset(x) for m, x in lists["modules"].items()}, on)


class Detector(Protocol):
    """Looks at a source of one of its extensions, and gives (rule id, severity, start, function) of what it finds, by place."""

    extensions: tuple[str, ...]

    def __call__(self, source: str) -> list[tuple[str, str, int, str]]: ...


@dataclass(frozen=True)
class ScriptDetector:
    """The built-in detector. A Python source has none of the forms it looks for: there is nothing to find in it."""

    rules: ScriptRules = field(default_factory=ScriptRules)
    extensions: tuple[str, ...] = tuple(EXTENSIONS)

    def __call__(self, source: str) -> list[tuple[str, str, int, str]]:
        return [(r, next(x[1] for x in self.rules.strategies.values() if x[0] == r), a, name) for r, a, _, name in detect(source, self.rules)]


MAX_BYTES, MAX_CONCAT, MAX_ALIAS = 1 << 20, 10, 10
_token = re.compile(
    r"""(?P<ws>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<tpl>`(?:\\.|[^`\\])*`)|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<re>(?<=[(,=:\[!&|?{};\n])\s*/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)|(?P<op>=>|\?\.|[^\w\s])""",
    re.S | re.X,
)
_escape = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|(.))", re.S)
_plain = {"n": "\n", "r": "\r", "t": "\t"}


def tokens(source: str, start: int = 0) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of everything but white space and comments; what a template string inserts follows it."""
    out = []
    for m in _token.finditer(source):
        if m.lastgroup == "ws":
            continue
        out.append((m.lastgroup, m.group(), start + m.start()))
        if m.lastgroup == "tpl" and "${" in m.group():
            for a, b in _inserted(m.group()):
                out += [("op", ";", start + m.start() + a), *tokens(m.group()[a:b], start + m.start() + a), ("op", ";", start + m.start() + b)]
    return out


def _inserted(template: str) -> Iterator[tuple[int, int]]:
    """Where the expressions between `${` and `}` lie."""
    at = 0
    while (at := template.find("${", at)) >= 0:
        depth, k = 1, at + 2
        while k < len(template) and depth:
            depth += {"{": 1, "}": -1}.get(template[k], 0)
            k += 1
        yield at + 2, k - 1
        at = k


def unescape(literal: str) -> tuple[str, bool]:
    """The value of a string literal without its quotes, and whether escapes stand in it."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else ""
        return _plain.get(m[4], m[4])

    return _escape.sub(one, literal), "\\" in literal


def _matching(t: list, k: int, opening: str, closing: str) -> int:
    depth = 0
    for j in range(k, len(t)):
        if t[j][1] == opening and t[j][0] == "op":
            depth += 1
        elif t[j][1] == closing and t[j][0] == "op":
            depth -= 1
            if not depth:
                return j
    return -1


def _opens_scope(t: list, k: int, pairs: dict[int, int]) -> bool:
    """Is the brace at ``k`` the body of a function, a method or a class?"""
    j = k - 1
    if j >= 0 and t[j][1] == "=>":
        return True
    while j >= 0 and k - j < 12 and t[j][1] not in (";", "{", "}", "(", ")", "="):
        if t[j][1] == "class" and t[j][0] == "id":
            return True
        j -= 1
    # a parameter list, and perhaps the type of what is returned, stand before it
    if j < 0 or t[j][1] != ")" or j not in pairs or j < k - 1 and t[j + 1][1] != ":":
        return False
    before = pairs[j] - 1
    return before >= 0 and (t[before][0] == "id" or t[before][1] in ("]", ">")) and t[before][1] not in OPENS_NO_SCOPE


def detect(source: str, rules: ScriptRules = ScriptRules()) -> list[tuple[str, int, int, str]]:
    """(rule, start, end, function) of each finding, by place.

    Names are bound by declarations, in the scope of the function, method or class they stand in; the innermost binding
    of a name counts, and one to anything but a name hides outer ones. A call sees the bindings before it.
    """
    t = tokens(source)
    out: list[tuple[str, int, int, str]] = []
    n = len(t)
    rule = {s: x[0] for s, x in rules.strategies.items()}
    text = lambda k: t[k][1] if 0 <= k < n else ""
    end = lambda k: t[k][2] + len(t[k][1])
    pairs: dict[int, int] = {}  # closing parenthesis -> its opening one
    opened: list[int] = []
    for k in range(n):
        if t[k][0] == "op" and t[k][1] == "(":
            opened.append(k)
        elif t[k][0] == "op" and t[k][1] == ")" and opened:
            pairs[k] = opened.pop()
    scopes: list[dict[str, str | None]] = [{}]
    braces: list[bool] = []
    declaring: int | None = None  # brackets open where a declaration began

    def found(strategy: str, a: int, b: int, name: str) -> None:
        if strategy in rule:
            out.append((rule[strategy], a, b, name))

    def resolve(name: str) -> str | None:
        for _ in range(MAX_ALIAS + 1):
            held = next((s for s in reversed(scopes) if name in s), None)
            if held is None:
                return name if name in rules.functions else None
            if held[name] is None or held[name] in rules.functions:
                return held[name]
            name = held[name]
        return None

    level = 0
    for k in range(n):
        kind, word, at = t[k]
        if kind == "op":
            if word == "{":
                braces.append(_opens_scope(t, k, pairs))
                if braces[-1]:
                    scopes.append({})
            elif word == "}" and braces and braces.pop() and len(scopes) > 1:
                scopes.pop()
            if word in "([{":
                level += 1
            elif word in ")]}":
                level -= 1
            if word == ";" or declaring is not None and level < declaring:
                declaring = None
        elif kind == "id" and word in ("const", "let", "var"):
            declaring = level
        elif declaring is not None and level <= declaring and kind == "id" and (text(k + 1) == "=" and text(k + 2) != "=" or text(k + 1) == ":") and text(k - 1) in ("const", "let", "var", ","):
            v = k + 2
            if text(k + 1) == ":":  # a type
                v = next((j + 1 for j in range(k + 2, min(n, k + 12)) if text(j) in ("=", ";")), n)
            ends = v + 1 >= n or text(v + 1) in (";", ",", "}", ")") or "\n" in source[end(v) : t[v + 1][2]]
            if v < n and t[v][0] == "id" and ends and text(v) not in ("this", "null", "true", "false", "undefined"):
                scopes[-1][word] = text(v)
            elif v < n and not (t[v][0] == "id" and text(v + 1) == "("):  # a call binds nothing that is followed
                scopes[-1][word] = None
        # { exec: run } = require('child_process')
        if word == "{" and (text(k - 1) in ("const", "let", "var", "import", ",") or text(k - 2) == "import"):
            close = _matching(t, k, "{", "}")
            module = None
            if close > 0 and text(close + 1) == "=" and text(close + 2) == "require" and text(close + 3) == "(":
                module = unescape(text(close + 4)[1:-1])[0]
            elif close > 0 and text(close + 1) == "from":
                module = unescape(text(close + 2)[1:-1])[0]
            for j in range(k + 1, close - 1) if module in rules.modules else ():
                if text(j) in rules.modules[module] and text(j + 1) in (":", "as") and t[j + 2][0] == "id" and text(j + 2) != text(j):
                    found("destructured_alias", t[j][2], end(j + 2), text(j))
        # window['eval'], window['ev' + 'al'], window['\x65val']
        if kind == "id" and word in rules.globals and text(k + 1) == "[" and text(k - 1) != ".":
            close = _matching(t, k + 1, "[", "]")
            inner = t[k + 2 : close] if close > 0 else []
            strings = inner[::2]
            if inner and len(inner) % 2 and len(strings) <= MAX_CONCAT + 1 and all(x[0] == "str" for x in strings) and all(x[1] == "+" for x in inner[1::2]):
                parts = [unescape(x[1][1:-1]) for x in strings]
                name = "".join(p[0] for p in parts)
                if name in rules.functions:
                    how = "string_concat" if len(parts) > 1 else "escape_sequences" if parts[0][1] else "computed_access"
                    found(how, at, end(close), name)
                    if text(close + 1) == "(":  # the call around it is reported too
                        call = _matching(t, close + 1, "(", ")")
                        found(how, at, end(call) if call > 0 else end(close + 1), name)
        # (0, eval)(...)
        if word == "(" and kind == "op":
            close = _matching(t, k, "(", ")")
            if close > k + 3 and text(close + 1) == "(" and text(close - 2) == "," and t[close - 1][0] == "id" and text(close - 1) in rules.functions and (k == 0 or t[k - 1][0] == "op" or text(k - 1) in ("return", "await")):
                found("comma_operator", at, end(close), text(close - 1))
        # run(...) where run is eval under another name
        if kind == "id" and text(k + 1) == "(" and text(k - 1) not in (".", "function", "?.", "new"):
            name = resolve(word)
            if name is not None and name != word and not (k + 1 in pairs.values() and text(_matching(t, k + 1, "(", ")") + 1) == "{"):
                found("variable_aliasing", at, end(k), name)
    return sorted(set(out)) if len(set(out)) == len(out) else sorted(out)


def ast_findings(files: DataFrame, row_id: str, text: str, path: str, detectors: tuple[Detector, ...] = (ScriptDetector(),), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(row_id, rule_id, severity, start, line, function) of the files that a detector takes.

    Null texts and other kinds of files give none. Those over ``max_bytes`` aren't looked at: ``scan.results`` with the
    same limit lists them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s, e in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(i, r, severity, a, s.count("\n", 0, a) + 1, f) for d in detectors if e in d.extensions for r, severity, a, f in d(s)]
            cols = list(zip(*rows)) or [()] * 6
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], ["__id", "rule_id", "severity", "start", "line", "function"])

    own = [d.rules for d in detectors if isinstance(d, ScriptDetector)]
    names = "|".join(sorted(re.escape(x) for r in own for x in {*r.functions, *r.modules, *r.globals})) if len(own) == len(detectors) else ""
    kinds = sorted({e for d in detectors for e in d.extensions})
    src = files.select(F.col(row_id).alias("__id"), F.col(text).alias("__t"), F.col(path).alias("__p")).where(T.extension(F.col("__p")).isin(*kinds) & (F.octet_length("__t") <= max_bytes) & F.col("__t").rlike(names))
    kind = src.schema["__id"].dataType.simpleString()
    out = spread(src.select("__id", "__t", T.extension(F.col("__p")).alias("__e"))).mapInArrow(run, f"__id {kind}, rule_id string, severity string, start int, line int, function string")
    return out.withColumnRenamed("__id", row_id)
