"""Schemas that drift between files: a column lifespan catalogue.

Every file is one release of one producer. Its footer is the list of top-level fields
with their JSON types, taken from all its records. Exploded, the footers of a producer's
releases are a table of (producer, release, field, type) presences. A lag over releases
finds where an island of presence starts and where it ended; a start and an ending of
two fields in one release are a rename if the records agree in value. A producer's renames
say which of its names are one field, unless a record holds two of them at once; the types
met in a column say how it is cast in the one consistent table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.session import small, written


def json_type(v: Column) -> Column:
    """string, number, boolean, list or object; null for a JSON null."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), None)
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "list")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def record_fields(records: DataFrame, record_no: str, producer: str, release: str, record: str, key: str) -> DataFrame:
    """One row per record and non-null top-level field: (producer, release, record_no, rec, rid, field, type, value).

    ``rec`` is a key made up for the record, with or without a number, ``rid`` is the record's own key, the value of its field ``key``. Values are JSON text; a list
    of one value has that value's text in ``same_as``, any other value its own. Redelivered records
    (same ``record_no``) count once, by the longest delivery that parses, records without a number each. Records that are null,
    blank, cut off or no object give no row.
    """
    r = records.select(F.col(record_no).alias("record_no"), F.col(producer).alias("producer"), F.col(release).alias("release"), F.col(record).alias("__r"))
    r = r.where(F.col("producer").isNotNull() & F.col("release").isNotNull())
    # an explode of one value keeps the planner from repeating the parse in every later expression
    r = r.select("record_no", "producer", "release", F.struct(F.length("__r"), F.xxhash64("__r")).alias("__o"), F.explode(F.array(F.try_parse_json("__r"))).alias("__v"))
    r = r.where(F.schema_of_variant("__v").startswith("OBJECT"))
    numbered = r.where(F.col("record_no").isNotNull()).groupBy("record_no", "producer", "release").agg(F.max_by("__v", "__o").alias("__v"))
    r = numbered.unionByName(r.where(F.col("record_no").isNull()).drop("__o"))
    r = r.select("record_no", "producer", "release", F.try_variant_get("__v", "$", "map<string,variant>").alias("__f"))
    r = r.withColumn("rec", F.monotonically_increasing_id())  # fixed by the write below
    r = r.select("record_no", "producer", "release", "rec", F.to_json(F.element_at("__f", F.lit(key))).alias("rid"), F.explode_outer("__f").alias("field", "__v"))
    r = r.withColumn("type", json_type(F.col("__v"))).where(F.col("type").isNotNull())
    items = F.when(F.col("type") == "list", F.try_variant_get(F.col("__v"), "$", "array<variant>"))
    out = r.select(
        "record_no",
        "producer",
        "release",
        "rec",
        "rid",
        "field",
        "type",
        F.to_json("__v").alias("value"),
        F.to_json(F.when(F.size(items) == 1, items[0]).otherwise(F.col("__v"))).alias("same_as"),
    )
    return written(out, "fields")  # read several times by what follows


def footers(fields: DataFrame) -> DataFrame:
    """(producer, release, field, type, n): the catalogue's input, one row per presence.

    A field with several types in one release has the type of most records, the first by name
    among equals. Small: a row per release and field, however many records there are.
    """
    counts = fields.groupBy("producer", "release", "field", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("producer", "release", "field").agg(F.max_by("type", F.struct("n", F.lit(0) - F.ascii("type"))).alias("type"), F.sum("n").alias("n"))


def lifespans(foot: DataFrame) -> DataFrame:
    """Islands of unbroken presence: (producer, field, type, first_release, last_release, releases).

    An island ends where the field is missing from the producer's next release or has another type.
    Releases are ranked per producer, so numbers that were never published are no gap.
    """
    order = foot.select("producer", "release").distinct().withColumn("pos", F.dense_rank().over(Window.partitionBy("producer").orderBy("release")))
    w = Window.partitionBy("producer", "field", "type").orderBy("pos")
    p = foot.join(order, ["producer", "release"]).withColumn("starts", F.coalesce((F.col("pos") - F.lag("pos").over(w) > 1).cast("int"), F.lit(1)))
    p = p.withColumn("island", F.sum("starts").over(w))
    return p.groupBy("producer", "field", "type", "island").agg(
        F.min("release").alias("first_release"), F.max("release").alias("last_release"), F.count("*").alias("releases"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


def changes(fields: DataFrame, foot: DataFrame | None = None) -> DataFrame:
    """(producer, release, field, change, new_field): every change of a release against the one before it.

    ``removed``, ``added``, ``renamed`` or ``retyped``, see TESTDATA.md. If one ending field agrees with
    several starting ones, or the other way round, the pair with the most agreeing records is the
    rename, ties going to the first names; the rest are removed and added. A producer's first
    release has no change.
    """
    foot = footers(fields) if foot is None else foot
    order = Window.partitionBy("producer").orderBy("pos")
    per_field = Window.partitionBy("producer", "field").orderBy("pos")
    ranked = foot.withColumn("pos", F.dense_rank().over(Window.partitionBy("producer").orderBy("release")))
    releases = ranked.groupBy("producer", "pos").agg(F.first("release").alias("release")).withColumn("next_release", F.lead("release").over(order))
    step = ranked.withColumns({"prev_pos": F.lag("pos").over(per_field), "prev_type": F.lag("type").over(per_field), "next_pos": F.lead("pos").over(per_field)})
    step = step.join(releases.select("producer", "pos", "next_release"), ["producer", "pos"])
    here = F.coalesce(F.col("prev_pos") == F.col("pos") - 1, F.lit(False))
    goes_on = F.coalesce(F.col("next_pos") == F.col("pos") + 1, F.lit(False))
    no_release = F.when(F.lit(False), F.col("release"))
    start = F.when((F.col("pos") > 1) & ~here, F.struct(F.lit("start").alias("what"), F.col("release").alias("at"), no_release.alias("was")))
    end = F.when(F.col("next_release").isNotNull() & ~goes_on, F.struct(F.lit("end").alias("what"), F.col("next_release").alias("at"), F.col("release").alias("was")))
    retyped = F.when(here & (F.col("type") != F.col("prev_type")), F.struct(F.lit("retyped").alias("what"), F.col("release").alias("at"), no_release.alias("was")))
    # the log: a row for each start, ending and change of type; as small as the footers
    log = written(step.select("producer", "field", "type", F.explode(F.array_compact(F.array(start, end, retyped))).alias("e")).select("producer", "field", "type", "e.*"), "lifespans")
    starts = log.where("what = 'start'").select("producer", F.col("at").alias("release"), F.col("field").alias("new_field"), F.col("type").alias("new_type"))
    ends = log.where("what = 'end'").select("producer", F.col("at").alias("release"), F.col("was").alias("old_release"), F.col("field").alias("old_field"), F.col("type").alias("old_type"))
    # the log is sent to the records; what is shuffled is spread by record key, and no field or release is one task's
    before = fields.where(F.col("rid").isNotNull()).select("producer", F.col("release").alias("old_release"), F.col("field").alias("old_field"), "rid", F.col("same_as").alias("old_value"))
    before = before.join(small(ends), ["producer", "old_release", "old_field"]).select("producer", "release", "rid", "old_field", "old_type", "old_value")
    after = fields.where(F.col("rid").isNotNull()).select("producer", "release", F.col("field").alias("new_field"), "rid", F.col("same_as").alias("new_value"))
    after = after.join(small(starts), ["producer", "release", "new_field"]).select("producer", "release", "rid", "new_field", "new_type", "new_value")
    agree = (
        before.join(after, ["producer", "release", "rid"])
        .groupBy("producer", "release", "old_field", "new_field", "old_type", "new_type")
        .agg(F.count("*").alias("both"), F.count_if(F.col("old_value") == F.col("new_value")).alias("same"))
        .where(F.col("same") * 2 > F.col("both"))
    )
    best = lambda col: F.row_number().over(Window.partitionBy("producer", "release", col).orderBy(F.desc("same"), "old_field", "new_field"))
    renamed = agree.withColumn("__a", best("old_field")).withColumn("__b", best("new_field")).where((F.col("__a") == 1) & (F.col("__b") == 1))
    renamed = written(renamed.select("producer", "release", "old_field", "new_field", "old_type", "new_type"), "renames")
    row = lambda field, change, new: F.struct(F.col(field).alias("field"), F.lit(change).alias("change"), new.alias("new_field"))
    none = F.lit("")
    pair = F.array_compact(F.array(row("old_field", "renamed", F.col("new_field")), F.when(F.col("old_type") != F.col("new_type"), row("new_field", "retyped", none))))
    out = renamed.select("producer", "release", F.explode(pair).alias("r")).select("producer", "release", "r.*")
    taken = renamed.select("producer", F.col("release").alias("at"), F.explode(F.array(F.struct(F.lit("end").alias("what"), F.col("old_field").alias("field")), F.struct(F.lit("start").alias("what"), F.col("new_field").alias("field")))).alias("t"))
    rest = log.join(taken.select("producer", "at", "t.what", "t.field"), ["producer", "at", "what", "field"], "left_anti")
    name = F.when(F.col("what") == "end", "removed").when(F.col("what") == "start", "added").otherwise("retyped")
    return out.unionByName(rest.select("producer", F.col("at").alias("release"), "field", name.alias("change"), none.alias("new_field")))


def _groups(names: Iterable[str], links: Iterable[tuple[str, str]], apart: set[tuple[str, str]]) -> list[list[str]]:
    """The names in groups, each link in turn joining two of them unless a pair of ``apart`` would meet."""
    group = {n: {n} for n in names}
    for a, b in links:
        x, y = group[a], group[b]
        if x is not y and not any((i, j) in apart or (j, i) in apart for i in x for j in y):
            x |= y
            group.update(dict.fromkeys(y, x))
    return [sorted(g) for g in {id(g): g for g in group.values()}.values()]


def _uses(foot: DataFrame, max_names: int) -> dict[str, int]:
    used = {r[0]: r[1] for r in foot.groupBy("field").agg(F.count("*")).limit(max_names + 1).collect()}
    if len(used) > max_names:
        raise ValueError(f"more than {max_names} distinct field names")
    return used


def alias_table(found: DataFrame, foot: DataFrame, max_names: int = 10_000) -> dict[str, str]:
    """Field name -> the name of its group, names linked by a rename in any producer being one group.

    A group is called by the one of its names that most releases have. Works on names only: there are
    as many as the schemas have distinct fields, and more than ``max_names`` are refused. A record may
    hold two names of a group; ``producer_aliases`` keeps these apart.
    """
    used = _uses(foot, max_names)
    links = found.where(F.col("change") == "renamed").select("field", "new_field").distinct().collect()
    return {n: max(m, key=lambda x: used[x]) for m in _groups(used, links, set()) for n in m}


def producer_aliases(fields: DataFrame, found: DataFrame, foot: DataFrame, max_names: int = 10_000) -> DataFrame:
    """(producer, field, column): the column of each producer's field in the consistent table.

    A group of ``alias_table`` of which no record anywhere holds two names is one column. Of any other group a
    producer's names are one column only if that producer's own renames link them and none of its
    records holds two of them. So a record never has two fields in one column.
    """
    used, common = _uses(foot, max_names), alias_table(found, foot, max_names)
    links = found.where(F.col("change") == "renamed").select("producer", "release", "field", "new_field")
    names = links.select(F.explode(F.array("field", "new_field")).alias("field")).distinct()
    held = fields.join(small(names), "field", "left_semi").groupBy("producer", "rec").agg(F.sort_array(F.collect_set("field")).alias("b")).where(F.size("b") > 1)
    held = held.select("producer", "b").distinct().select("producer", F.explode("b").alias("a"), "b").select("producer", "a", F.explode("b").alias("b"))
    apart = written(held.where(F.col("a") < F.col("b")).distinct(), "apart")
    mixed = {common[r.a] for r in apart.select("a", "b").distinct().collect() if common[r.a] == common[r.b]}

    @F.udf("array<struct<field string, column string>>")
    def columns(own, renames, pairs):
        out = [(n, common[n]) for n in own if common[n] not in mixed]
        rest = [n for n in own if common[n] in mixed]
        steps = [(r.field, r.new_field) for r in sorted(renames or []) if common[r.field] in mixed]
        for m in _groups(rest, steps, {(p.a, p.b) for p in pairs or []}):
            out += [(n, max(m, key=lambda x: used[x])) for n in m]
        return out

    each = foot.groupBy("producer").agg(F.collect_set("field").alias("own"))
    each = each.join(links.groupBy("producer").agg(F.collect_list(F.struct("release", "field", "new_field")).alias("renames")), "producer", "left")
    each = each.join(apart.groupBy("producer").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "producer", "left")
    return written(each.select("producer", F.explode(columns("own", "renames", "pairs")).alias("c")).select("producer", "c.*"), "aliases")


def column_casts(fields: DataFrame, aliases: DataFrame) -> dict[str, str]:
    """Column -> ``list`` if any of its values is one, else ``number`` or ``boolean`` if all are, else ``text``."""
    types = fields.groupBy("producer", "field", "type").count().join(aliases, ["producer", "field"]).groupBy("column").agg(F.collect_set("type").alias("types"))
    return {r.column: "list" if "list" in r.types else r.types[0] if len(r.types) == 1 and r.types[0] in ("number", "boolean") else "text" for r in types.collect()}


def consistent_table(fields: DataFrame, aliases: dict[str, str] | DataFrame, casts: dict[str, str]) -> DataFrame:
    """One row per record with one column per name in ``aliases``, a table of ``producer_aliases`` or one for all producers.

    ``casts`` gives the type of a column: ``list`` wraps a lone value into a list of texts,
    ``number`` and ``boolean`` cast, anything else is text: a string as it stands, a lone list item as that
    item, other values as JSON.
    """
    record = ["producer", "release", "record_no", "rec"]
    if isinstance(aliases, dict):
        names = sorted(set(aliases.values()))
        named = fields.withColumn("__c", F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.col("field"))) if names else fields
    else:
        names = sorted(r[0] for r in aliases.select("column").distinct().collect())
        named = fields.join(small(aliases.withColumnRenamed("column", "__c")), ["producer", "field"])
    if not names:
        return fields.select(record).distinct().drop("rec")
    wide = named.groupBy(record).agg(*[F.min(F.when(F.col("__c") == n, F.struct("type", "value", "same_as"))).alias(n) for n in names])
    plain = lambda c: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"), c)

    def cast(n: str) -> Column:
        v = F.col(n)
        if casts.get(n) == "list":
            return F.when(v["type"] == "list", F.from_json(v["value"], "array<string>")).when(v.isNotNull(), F.array(plain(v["value"])))
        if casts.get(n) == "number":
            return plain(v["same_as"]).try_cast("double")
        if casts.get(n) == "boolean":
            return plain(v["same_as"]).try_cast("boolean")
        return F.when(v.isNotNull(), plain(v["same_as"]))

    return wide.select("producer", "release", "record_no", *[cast(n).alias(n) for n in names])
