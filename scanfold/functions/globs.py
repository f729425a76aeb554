"""Globs as regular expressions. As in the usual default, `*` and `?` also match `/`."""

from __future__ import annotations

import re

from pyspark.sql import Column


def glob_regex(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob[k : k + 3] == "**/" and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out, k = out + "(?:" + "|".join(map(glob_regex_part, glob[k + 1 : end].split(","))) + ")", end
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_/" else c
        k += 1
    return out


def glob_regex_part(part: str) -> str:
    return glob_regex(part)


def any_glob(globs: list[str]) -> str:
    """One expression that matches what any of the globs does, as a whole."""
    return "^(?s:" + "|".join(map(glob_regex, globs)) + ")$" if globs else "(?!)"


def matches(path: Column, globs: list[str]) -> Column:
    return path.rlike(any_glob(globs))
