"""Deeply nested records to related flat tables, by Dewey labels.

A node's label is its parent's label with its own position appended: `7.3.0.2` is entry 2
of item 0 of item 3 of record 7. The parent is the label without its last part, every
ancestor a shorter prefix, and document order is label order, so no key has to be made up
and no table joined to link a child to its parent. Nodes are grouped by the path of the
schema they belong to; each group is one flat table. All of it is one projection after the
other on Spark's VARIANT, without a shuffle: a record's nodes stay where the record is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(label: Column) -> Column:
    """The label of the parent node; null for a record itself."""
    return F.when(F.instr(label, ".") > 0, F.regexp_replace(label, r"\.[^.]*$", ""))


def position(label: Column, depth: int) -> Column:
    """The ordinal that a label has at a depth, counted from 1 below the record."""
    return F.element_at(F.split(label, r"\."), depth + 1).cast("int")


def as_list(v: Column) -> Column:
    """The items of a JSON list; null for any other value. Only this level is unpacked."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    """The members of a JSON object; null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def inner_json(v: Column) -> Column:
    """The value that a JSON text stands for, if the value is a string that holds JSON."""
    return F.try_parse_json(F.try_variant_get(v, "$", "string"))


def unwrapped(v: Column, wrappers: list[str], depth: int = 2) -> Column:
    """The record inside objects that hold it under one of the names, up to ``depth`` of them; else the value itself."""
    paths = [[]]
    for _ in range(depth):
        paths += [[*p, w] for p in paths if len(p) == len(paths[-1]) for w in wrappers]
    inner = [member(v, ".".join(p)) for p in sorted(paths[1:], key=len, reverse=True)]
    return F.coalesce(*[F.when(as_map(i).isNotNull(), i) for i in inner], v)


def items(v: Column) -> Column:
    """The value as array<variant>: a list's items, a lone object as the only one, the same inside a string; else null."""
    p = inner_json(v)
    return F.coalesce(as_list(v), F.when(as_map(v).isNotNull(), F.array(v)), as_list(p), F.when(as_map(p).isNotNull(), F.array(p)))


def entries(v: Column) -> Column:
    """A map's entries in one form, from an object or a list of {key, value} objects, also inside a string.

    array<struct<key string, value variant>>, in the order of the list, or of the keys for an object.
    A list item without a key gives no entry.
    """

    def of(x: Column) -> list[Column]:
        pairs = F.array_sort(F.map_entries(as_map(x)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        listed = F.transform(as_list(x), lambda e: F.struct(F.try_variant_get(e, "$.key", "string").alias("key"), member(e, "value").alias("value")))
        return [pairs, F.filter(listed, lambda e: e["key"].isNotNull())]

    return F.coalesce(*of(v), *of(inner_json(v)))


def value_kind(v: Column) -> Column:
    """string, number, boolean, null, list or object; null for no value."""
    t = F.schema_of_variant(v)
    kind = F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object")
    return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").otherwise(F.coalesce(kind, F.lit("number")))


def below(v: Column, unpack: bool) -> Column:
    """The values below a member in order: a list's items, any other value as the only one; with ``unpack`` also those inside a string."""
    lone = F.when(v.isNotNull(), F.array(v))
    return F.coalesce(items(v), lone) if unpack else F.coalesce(as_list(v), lone)


def _children(of: Column, path: Column, label: Column, names: list[str] | None, unpack: bool) -> Column:
    """array<struct<label, path, v>> of the nodes below a value."""
    listed = F.when(as_list(of).isNotNull(), F.array(F.struct(F.lit("").alias("key"), of.alias("value"))))  # a list in a list
    pairs = F.coalesce(F.map_entries(as_map(of)), listed) if names is None else F.array(*[F.struct(F.lit(n).alias("key"), member(of, n).alias("value")) for n in names])
    at = lambda m: F.concat(path, F.when(m["key"] != "", F.concat(F.lit("."), m["key"])).otherwise(""))
    nodes = lambda m: F.transform(F.coalesce(below(m["value"], unpack), F.array().cast("array<variant>")), lambda x, i: F.struct(F.concat_ws(".", label, i).alias("label"), at(m).alias("path"), x.alias("v")))
    return F.flatten(F.transform(F.coalesce(pairs, F.array().cast("array<struct<key string, value variant>>")), nodes))


def children(nodes: DataFrame, names: list[str] | None = None, unpack: bool = True) -> DataFrame:
    """The child nodes (label, path, v) of nodes (label, path, v), below the members of these names, or below all.

    A list's items and a lone value are labelled by their position; null items take a position and give no node. With ``unpack``
    an object or a list inside a string counts as such.
    """
    # the plain form would add a filter on the list, and with it build the list twice
    deep = nodes.select(F.explode_outer(_children(F.col("v"), F.col("path"), F.col("label"), names, unpack)).alias("c")).select("c.*")
    return deep.where(F.col("v").isNotNull() & ~F.coalesce(F.is_variant_null("v"), F.lit(True)))


def objects(nodes: DataFrame) -> DataFrame:
    """The nodes that are objects; an object inside a string is taken out of it."""
    v = F.col("v")
    return nodes.withColumn("v", F.when(as_map(v).isNotNull(), v).otherwise(inner_json(v))).where(as_map(F.col("v")).isNotNull())


def max_depth(df: DataFrame, payload: str) -> int:
    """How deep brackets are nested in any payload, counting those inside strings: a bound of the depth of its tree."""
    marks = F.regexp_replace(payload, r"[^\[\]{}]+", "")
    step = lambda acc, c: F.when(c.isin("[", "{"), acc["now"] + 1).otherwise(acc["now"] - 1)
    deep = F.aggregate(
        F.split(marks, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, c: F.struct(step(acc, c).alias("now"), F.greatest(acc["top"], step(acc, c)).alias("top")),
        lambda acc: acc["top"],
    )
    return df.agg(F.max(deep)).first()[0] or 0


def tree(roots: DataFrame, depth: int, unpack: bool = False) -> DataFrame:
    """(path, label, parent, kind, value): every node of the trees under nodes (label, path, v), down to ``depth``.

    Nodes are objects, items and single values; a list is no node of its own. ``value`` is a single value's JSON, and JSON of what
    lies deeper than ``depth``. Grouped by ``path`` the nodes are the flat tables of the schema. One chain of projections: a step
    takes the newest nodes apart and passes the others on, so nothing is parsed or read twice.
    """
    kind, value = value_kind(F.col("v")), F.to_json("v")
    none = F.lit(None).cast("string")
    # a node waits with its value, or is done and keeps what its row needs
    done = lambda v, k, x: F.struct(F.col("label").alias("label"), F.col("path").alias("path"), v.alias("v"), k.alias("kind"), x.alias("value"))
    no_value = F.lit(None).cast("variant")
    no_nodes = F.array().cast("array<struct<label string, path string, v variant, kind string, value string>>")
    now = roots.select("label", "path", "v", none.alias("kind"), none.alias("value"))
    for _ in range(depth):
        # an explode of one value keeps the kind from being found anew in every expression
        now = now.select("*", F.explode(F.array(F.when(F.col("v").isNotNull(), kind))).alias("k"))
        k = F.col("k")
        new = F.transform(_children(F.col("v"), F.col("path"), F.col("label"), None, unpack), lambda c: F.struct(c["label"].alias("label"), c["path"].alias("path"), c["v"].alias("v"), none.alias("kind"), none.alias("value")))
        inner = F.when(k == "object", F.concat(F.array(done(no_value, k, none)), new)).when(k == "list", new).when(k == "null", no_nodes).otherwise(F.array(done(no_value, k, value)))
        now = now.select(F.explode(F.when(k.isNull(), F.array(done(no_value, F.col("kind"), F.col("value")))).otherwise(inner)).alias("n")).select("n.*")
    now = now.select("path", "label", F.coalesce("kind", kind).alias("kind"), F.coalesce("value", value).alias("value"))
    return now.where(F.col("kind") != "null").select("path", "label", parent(F.col("label")).alias("parent"), "kind", "value")


def records(df: DataFrame, record_id: str, payload: str, wrappers: list[str]) -> DataFrame:
    """The record nodes (label, path, v): label is the id. Null ids, and null, blank and cut off payloads give none.

    Of several payloads of one id that parse the longest counts, of equally long ones that of the largest hash.
    """
    one = df.select(F.col(record_id).cast("string").alias("label"), F.col(payload).alias("__p")).where(F.col("label").isNotNull() & F.col("__p").isNotNull())
    # an explode of one value keeps the planner from repeating the parse in every later expression
    parsed = one.select("label", F.struct(F.length("__p"), F.xxhash64("__p")).alias("__o"), F.explode(F.array(F.try_parse_json("__p"))).alias("v")).where(F.col("v").isNotNull())
    best = parsed.groupBy("label").agg(F.max_by("v", "__o").alias("v"))
    return best.select("label", F.lit("$").alias("path"), F.explode(F.array(unwrapped(F.col("v"), wrappers) if wrappers else F.col("v"))).alias("v"))


def location_line(v: Column) -> Column:
    """The start line of a location: its start_line, or the number at the end of `file:line`; 0 if there is none."""
    text = F.try_variant_get(v, "$", "string")
    number = lambda x: F.coalesce(F.try_variant_get(x, "$.start_line", "int"), F.try_variant_get(x, "$.start_line", "string").try_cast("int"))
    in_text = F.regexp_extract(text, r":(\d+)(?::\d+)?\s*$", 1).try_cast("int")
    return F.coalesce(number(v), in_text, number(F.try_parse_json(text)), F.lit(0))


def location_file(v: Column) -> Column:
    """The file of a location given as an object, as `file:line` or as an object inside a string."""
    text = F.try_variant_get(v, "$", "string")
    plain = F.when(~F.ltrim(text).startswith("{"), F.regexp_replace(text, r"(?::\d+){1,2}\s*$", ""))
    return F.coalesce(F.try_variant_get(v, "$.file", "string"), F.try_variant_get(F.try_parse_json(text), "$.file", "string"), plain)


def whole_number(v: Column, name: str) -> Column:
    """The member as a whole number, also given as a string; null if it isn't one."""
    return F.try_variant_get(v, f"$.{name}", "string").try_cast("bigint")


def all_nodes(v: Column) -> Column:
    """Does every item that isn't null become a child node?"""
    return F.coalesce(F.forall(items(v), lambda x: F.coalesce(as_map(x).isNotNull() | F.is_variant_null(x), F.lit(True))), F.lit(False))


def all_entries(v: Column) -> Column:
    """Does every item that isn't null become an entry, and nothing but its key and value exist?"""
    lists = F.coalesce(as_list(v), as_list(inner_json(v)))
    plain = lambda x: F.size(F.map_filter(as_map(x), lambda k, _: ~k.isin("key", "value"))) == 0
    whole = lambda x: F.coalesce(F.is_variant_null(x) | (F.try_variant_get(x, "$.key", "string").isNotNull() & plain(x)), F.lit(False))
    return F.coalesce(entries(v).isNotNull() & F.coalesce(F.forall(lists, whole), F.lit(True)), F.lit(False))


def rest(v: Column, columns: dict[str, Column], held: dict[str, Column]) -> Column:
    """JSON of the members of an object that neither a column nor a child table has; null if there are none.

    A member is left out if its column isn't null or if ``held``, the condition under which the child table has all
    of it, is true. Nulls of named members are left out too.
    """
    named = [*columns, *held]
    gone = F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in columns.items()], *[F.when(c, F.lit(n)) for n, c in held.items()]))
    left = F.map_filter(as_map(v), lambda k, x: ~F.array_contains(gone, k) & ~(k.isin(named) & F.coalesce(F.is_variant_null(x), F.lit(True))))
    return F.when(F.size(left) > 0, F.to_json(left))


def flat(nodes: DataFrame, texts: list[str], numbers: list[str], held: dict[str, Column] | None = None) -> DataFrame:
    """(label, parent, the named members, rest) of nodes: their flat table."""
    v = F.col("v")
    cols = {n: F.try_variant_get(v, f"$.{n}", "string") for n in texts} | {n: whole_number(v, n) for n in numbers}
    return nodes.select("label", parent(F.col("label")).alias("parent"), *[c.alias(n) for n, c in cols.items()], rest(v, cols, held or {}).alias("rest"))


def flat_locations(nodes: DataFrame) -> DataFrame:
    """The flat table of locations, given as objects, as `file:line:column` or as objects inside strings."""
    v, text = F.col("v"), F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    inner = F.try_parse_json(text)
    o = F.when(as_map(v).isNotNull(), v).when(as_map(inner).isNotNull(), inner)
    names = ["start_line", "end_line", "start_column", "end_column"]
    at = r"^(.*?)(?::(\d+))?(?::(\d+))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, at, i), F.lit(""))
    typed = {"file": F.try_variant_get(o, "$.file", "string")} | {n: whole_number(o, n) for n in names}
    in_text = {"file": part(1), "start_line": part(2).try_cast("bigint"), "start_column": part(3).try_cast("bigint")}
    cols = [F.when(o.isNotNull(), c).otherwise(in_text[n]).alias(n) if n in in_text else c.alias(n) for n, c in typed.items()]
    left = F.when(o.isNotNull(), rest(o, typed, {})).when(text.isNull(), F.to_json(v))
    return nodes.select("label", parent(F.col("label")).alias("parent"), *cols, left.alias("rest"))


def scan_report_tables(raw: DataFrame, record_id: str = "raw_id", payload: str = "payload") -> dict[str, DataFrame]:
    """The nodes of scan reports: reports, components, results, findings, locations, metadata.

    Each has ``label``, its key within the table; the label of the row it belongs to is ``parent`` of it. ``v`` is
    the node itself, from which ``flat`` and ``flat_locations`` take its columns.
    """
    top = objects(records(raw, record_id, payload, ["data", "report"]))
    components = objects(children(top, ["components"]))
    results = objects(children(top, ["results"]))
    findings = objects(children(results, ["findings"]))
    # a finding has one location, in whatever form it is given
    locations = findings.select(F.concat_ws(".", "label", F.lit("0")).alias("label"), F.concat("path", F.lit(".location")).alias("path"), member(F.col("v"), "location").alias("v"))
    locations = locations.where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    meta = findings.select("label", "path", F.posexplode_outer(entries(member(F.col("v"), "metadata"))).alias("__i", "e")).where(F.col("e").isNotNull())
    meta = meta.select(F.concat_ws(".", "label", "__i").alias("label"), F.concat("path", F.lit(".metadata")).alias("path"), F.col("e.key").alias("key"), F.col("e.value").alias("v"))
    return {"reports": top, "components": components, "results": results, "findings": findings, "locations": locations, "metadata": meta}


def report_rows(tables: dict[str, DataFrame], level: str) -> DataFrame:
    """The whole flat table of a level of ``scan_report_tables``."""
    m = lambda n: member(F.col("v"), n)
    if level == "reports":
        held = {n: all_nodes(m(n)) for n in ("results", "components")}
        return flat(tables[level], ["scan_root", "platform", "timestamp"], ["total_time_ms", "rule_count"], held).drop("parent")
    if level == "components":
        return flat(tables[level], ["kind", "name", "root", "manifest"], [])
    if level == "results":
        return flat(tables[level], ["path", "content_hash", "install_scope"], ["scan_time_ms"], {"findings": all_nodes(m("findings"))})
    if level == "findings":
        held = {"location": F.lit(True), "metadata": all_entries(m("metadata"))}
        return flat(tables[level], ["rule_id", "title", "severity", "category", "snippet", "remediation"], [], held)
    return flat_locations(tables["locations"])
