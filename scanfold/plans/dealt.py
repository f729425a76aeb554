"""The queries p1, p3, p4 and p5 over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions.keys import hash_key, rule_key
from scanfold.operators import drift, flatten, ranged, seen
from scanfold.session import small, written
from scanfold.sources.tables import table

HOT_SHARE = 0.04  # p1: a rule is hot from this share of the distinct findings
SEEN_BATCHES, SEEN_FANOUT = 4, 2  # p3: the arrivals come in so many batches; so many runs are merged into one


def _rule_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").where(F.col("finding_id").isNotNull()).select(rule_key(F.col("rule_id")).alias("rule"), "finding_id").where(F.col("rule").isNotNull())
    return ranged.ranged_aggregate(f, "rule", ["finding_id"], {"n": F.count("*")}, {"n_findings": F.sum("n")})


def _rules(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "rules").select(rule_key(F.col("rule_id")).alias("rule"), "rule_id")
    return small(rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.min("rule_id").alias("rule_id")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rules that hold at least 4 % of the distinct findings with a rule."""
    counts = written(_rule_counts(spark, d), "rule-counts")  # a row per rule
    total = counts.agg(F.sum("n_findings")).scalar()
    return counts.where(F.col("n_findings") >= total * HOT_SHARE).join(_rules(spark, d), "rule").select("rule_id")


def p1_rule_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Per rule: distinct findings, first and last detection, longest pause between detections."""
    f = table(spark, d, "findings").select(rule_key(F.col("rule_id")).alias("rule"), "finding_id", "detected_at").where(F.col("rule").isNotNull())
    return ranged.ranged_timeline(f, "rule", "detected_at", "finding_id")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_results").select(F.col("arrival_no").alias("no"), hash_key(F.col("content_hash")).alias("key"))


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict[str, int]]]:
    """The rows seen before, and the counts of each batch. The last batches are probed against merged runs."""
    store = seen.SeenStore(spark, SEEN_FANOUT)
    store.load(table(spark, d, "seen_hashes").select(hash_key(F.col("content_hash")).alias("key")))
    out, counts = None, []
    for batch in seen.split_by_arrival(_arrivals(spark, d), "no", SEEN_BATCHES):
        answers, n = store.observe(batch)
        out = answers if out is None else out.unionByName(answers)
        counts.append(n)
    store.close()
    return out, counts


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose content hash came before."""
    return _observed(spark, d)[0].select(F.col("no").alias("arrival_no"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, keys and repeats, the share of wrong answers against the first arrival of every key, and the wrong hits of hashes alone."""
    found, counts = _observed(spark, d)
    answers = found.withColumn("seen", F.lit(True))
    rows = _arrivals(spark, d)
    before = table(spark, d, "seen_hashes").select(hash_key(F.col("content_hash")).alias("key")).where(F.col("key").isNotNull()).select("key", F.lit(-1).cast("long").alias("no"))
    first = rows.where(F.col("key").isNotNull()).unionByName(before.select("no", "key")).groupBy("key").agg(F.min("no").alias("no")).select("no", F.lit(True).alias("is_first"))
    j = rows.join(answers, "no", "left").join(first, "no", "left")
    truth = F.col("key").isNotNull() & F.col("is_first").isNull()
    wrong = F.count_if(truth != F.coalesce("seen", F.lit(False)))
    return j.agg(
        F.count("*").alias("n_rows"),
        F.count("key").alias("n_with_key"),
        F.count("seen").alias("n_seen"),
        wrong.alias("n_wrong"),
        F.round(wrong / F.count("*"), 6).alias("wrong_share"),
        F.lit(sum(n["hash_only_hits"] for n in counts)).cast("long").alias("n_hash_only"),
    )


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return drift.record_fields(table(spark, d, "rule_records"), "record_no", "pack", "release_no", "record", "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a pack's release against the one before it."""
    return drift.changes(_fields(spark, d)).select(F.col("producer").alias("pack"), F.col("release").alias("release_no"), "field", "change", "new_field")


def p4_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: from which release to which a pack's field has a type."""
    spans = drift.lifespans(drift.footers(_fields(spark, d)))
    return spans.select(F.col("producer").alias("pack"), "field", "type", "first_release", "last_release", "releases")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """All records in one table, fields under one name and one type."""
    fields = _fields(spark, d)
    foot = drift.footers(fields)
    aliases = drift.producer_aliases(fields, drift.changes(fields, foot), foot)
    out = drift.consistent_table(fields, aliases, drift.column_casts(fields, aliases))
    return out.withColumnsRenamed({"producer": "pack", "release": "release_no"})


def p4_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many values each record has in the one table: none is lost."""
    t = p4_records(spark, d)
    names = [c for c in t.columns if c not in ("pack", "release_no", "record_no")]
    held = [F.col(f"`{c}`").isNotNull().cast("int") for c in names]
    n = held[0] if held else F.lit(0)
    for h in held[1:]:
        n = n + h
    return t.select("pack", "release_no", "record_no", n.cast("long").alias("n_values"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per metadata entry of each finding, and one for a finding without any."""
    findings = flatten.scan_report_tables(table(spark, d, "raw_reports"))["findings"]
    meta = F.transform(flatten.entries(flatten.member(F.col("v"), "metadata")), lambda e: e["key"])
    keys = F.when(F.size(meta) > 0, meta).otherwise(F.array(F.lit("")))
    rows = findings.select("label", F.explode_outer(keys).alias("meta_key"), flatten.location_line(flatten.member(F.col("v"), "location")).alias("line_no"))
    at = lambda i: flatten.position(F.col("label"), i)
    return rows.select(F.split("label", r"\.")[0].cast("long").alias("raw_id"), at(1).alias("result_pos"), at(2).alias("finding_pos"), "line_no", "meta_key")


def p5_results(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of results, with the link to its report."""
    r = flatten.scan_report_tables(table(spark, d, "raw_reports"))["results"]
    v = lambda k, t: F.try_variant_get("v", f"$.{k}", t)
    return r.select("label", flatten.parent(F.col("label")).alias("parent"), v("path", "string").alias("path"), v("content_hash", "string").alias("content_hash"), v("install_scope", "string").alias("install_scope"))


def p5_findings(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of findings with their location, and the link to the result."""
    f = flatten.scan_report_tables(table(spark, d, "raw_reports"))["findings"]
    loc = flatten.member(F.col("v"), "location")
    v = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    return f.select("label", flatten.parent(F.col("label")).alias("parent"), v("rule_id"), v("severity"), v("category"), flatten.location_file(loc).alias("file"), flatten.location_line(loc).alias("start_line"))


def p5_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of metadata entries, values as JSON text."""
    m = flatten.scan_report_tables(table(spark, d, "raw_reports"))["metadata"]
    return m.select("label", flatten.parent(F.col("label")).alias("parent"), "key", F.to_json("v").alias("value"))


def _report_rows(spark: SparkSession, d: str, level: str) -> DataFrame:
    return flatten.report_rows(flatten.scan_report_tables(table(spark, d, "raw_reports")), level)


def p5_reports(spark: SparkSession, d: str) -> DataFrame:
    """The whole flat table of reports."""
    return _report_rows(spark, d, "reports")


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """The whole flat table of a report's components, with the link to it."""
    return _report_rows(spark, d, "components")


def p5_results_whole(spark: SparkSession, d: str) -> DataFrame:
    """``p5_results`` with every other field."""
    return _report_rows(spark, d, "results")


def p5_findings_whole(spark: SparkSession, d: str) -> DataFrame:
    """``p5_findings`` with every other field; locations and metadata have tables of their own."""
    return _report_rows(spark, d, "findings")


def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    """The whole flat table of locations, with the link to the finding."""
    return _report_rows(spark, d, "locations")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every payload as it stands, whatever its schema: flat tables by path."""
    roots = flatten.records(table(spark, d, "raw_reports"), "raw_id", "payload", [])
    return flatten.tree(roots, flatten.max_depth(table(spark, d, "raw_reports"), "payload")).select("path", "label", "parent", "kind", F.when(F.col("kind") != "number", F.col("value")).alias("value"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of the payloads' schema: their paths, kinds of nodes and numbers of rows and parents."""
    return p5_nodes(spark, d).groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_distinct("parent").alias("n_parents"))


QUERIES = {f.__name__: f for f in (p5_nodes, p5_paths, p1_found, p1_rule_timeline, p3_found, p3_rates, p4_found, p4_lifespans, p4_records, p4_value_counts, p5_found, p5_reports, p5_components, p5_results, p5_results_whole, p5_findings, p5_findings_whole, p5_locations, p5_metadata)}

_RULE = r"""
  case when regexp_matches(upper(trim({c}, chr(9) || chr(10) || chr(13) || chr(32))), '^[A-Z]+[^A-Z0-9]*[0-9]+$')
       then regexp_extract(upper(trim({c}, chr(9) || chr(10) || chr(13) || chr(32))), '^([A-Z]+)[^A-Z0-9]*0*([0-9]+)$', 1) || '-' ||
            regexp_extract(upper(trim({c}, chr(9) || chr(10) || chr(13) || chr(32))), '^([A-Z]+)[^A-Z0-9]*0*([0-9]+)$', 2)
       else nullif(upper(trim({c}, chr(9) || chr(10) || chr(13) || chr(32))), '') end"""
_HASH = r"nullif(regexp_extract(lower(trim(content_hash, chr(9) || chr(10) || chr(13) || chr(32))), '^(?:sha-?256\s*[:=-]\s*)?(?:0x)?([0-9a-f]{64})$', 1), '')"
_P4_FIELDS = """
with r as (select record_no, pack, release_no, any_value(record) j from rule_records where json_valid(record) and json_type(record) = 'OBJECT' group by all),
f as (select record_no, pack, release_no, json_extract_string(j, '$.id') rid, k.unnest field, json_extract(j, '$."' || k.unnest || '"') v
      from r, unnest(json_keys(j)) k),
t as (select *, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' when 'OBJECT' then 'object' else 'number' end typ,
             case when json_type(v) = 'ARRAY' and json_array_length(v) = 1 then json_extract(v, '$[0]') else v end same_as
      from f where json_type(v) <> 'NULL'),
foot as (select pack, release_no, field, any_value(typ) typ from t group by all),
pos as (select pack, release_no, dense_rank() over (partition by pack order by release_no) pos from (select distinct pack, release_no from foot)),
p as (select * from foot join pos using (pack, release_no))
"""
_P5 = r"""
with one as (select raw_id, any_value(payload) j from raw_reports where json_valid(payload) group by raw_id),
u as (select raw_id, case when json_type(j, '$.data.report') = 'OBJECT' then json_extract(j, '$.data.report') when json_type(j, '$.report') = 'OBJECT' then json_extract(j, '$.report') else j end j from one),
rs as (select raw_id, case json_type(j, '$.results') when 'ARRAY' then json_extract(j, '$.results') when 'OBJECT' then json_array(json_extract(j, '$.results')) end r from u),
r as (select raw_id, i - 1 result_pos, json_extract(r, '$[' || (i - 1) || ']') v from rs, range(1, json_array_length(r)::bigint + 1) t(i)),
fs as (select raw_id, result_pos, case when json_type(v, '$.findings') = 'VARCHAR' then json(json_extract_string(v, '$.findings')) else json_extract(v, '$.findings') end f from r),
fl as (select raw_id, result_pos, case json_type(f) when 'ARRAY' then f when 'OBJECT' then json_array(f) end f from fs),
f as (select raw_id, result_pos, i - 1 finding_pos, json_extract(f, '$[' || (i - 1) || ']') v from fl, range(1, json_array_length(f)::bigint + 1) t(i))"""
# labels from the path: an item is its number, any other member 0
_TREE = r"""
with one as (select raw_id, arg_max(payload, length(payload)) j from raw_reports where json_valid(payload) and raw_id is not null group by raw_id),
t as (select raw_id, t.* from one, json_tree(one.j::json) t),
l as (select *, regexp_replace(regexp_replace(fullkey, '\[[0-9]+\]', '', 'g'), '"', '', 'g') p,
      replace(replace(replace(replace(regexp_replace(substr(fullkey, 2), '\.("[^"]*"|[^.\[]+)', '#', 'g'), '#[', '['), '#', '.0'), '[', '.'), ']', '') s from t where type not in ('ARRAY', 'NULL')),
n as (select p as path, raw_id || s as "label", case when s <> '' then regexp_replace(raw_id || s, '\.[^.]*$', '') end parent,
      case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' else 'number' end kind, case when type in ('VARCHAR', 'BOOLEAN') then atom::varchar end "value" from l)
"""
ORACLE = {
    "p1_found": f"""
with f as (select distinct finding_id, {_RULE.format(c="rule_id")} rule from findings where finding_id is not null),
c as (select rule, count(*) n from f where rule is not null group by rule),
k as (select {_RULE.format(c="rule_id")} rule, min(rule_id) rule_id from rules group by 1)
select k.rule_id from c join k using (rule) where n >= 0.04 * (select sum(n) from c)""",
    "p1_rule_timeline": f"""
with f as (select distinct finding_id, {_RULE.format(c="rule_id")} rule, epoch_us(detected_at) us from findings where finding_id is not null and detected_at is not null),
g as (select rule, us, us - lag(us) over (partition by rule order by us, finding_id) gap from f where rule is not null)
select rule, count(*) n_rows, min(us) first_us, max(us) last_us, coalesce(max(gap), 0) longest_pause_us from g group by rule""",
    "p3_found": f"""
with r as (select arrival_no, {_HASH} k from scan_results),
s as (select distinct {_HASH} k from seen_hashes),
m as (select k, min(arrival_no) first_no from r where k is not null group by k)
select arrival_no from r join m using (k) where arrival_no > first_no or k in (select k from s)""",
    "p3_rates": f"""
with r as (select arrival_no, {_HASH} k from scan_results),
s as (select distinct {_HASH} k from seen_hashes),
m as (select k, min(arrival_no) first_no from r where k is not null group by k),
seen as (select arrival_no from r join m using (k) where arrival_no > first_no or k in (select k from s))
select (select count(*) from r) n_rows, (select count(k) from r) n_with_key, (select count(*) from seen) n_seen, cast(0 as bigint) n_wrong, cast(0 as double) wrong_share, cast(0 as bigint) n_hash_only""",
    "p4_found": _P4_FIELDS
    + """,
w as (select *, lag(pos) over f prev_pos, lag(typ) over f prev_typ, lead(pos) over f next_pos from p window f as (partition by pack, field order by pos)),
starts as (select pack, release_no, pos, field nf, typ nt from w where pos > 1 and (prev_pos is null or prev_pos <> pos - 1)),
ends as (select w.pack, n.release_no, w.release_no old_release, field of, typ ot from w join pos n on n.pack = w.pack and n.pos = w.pos + 1 where next_pos is null or next_pos <> w.pos + 1),
agree as (select s.pack, s.release_no, of, nf, ot, nt, count(*) both_n, count(*) filter (a.same_as::varchar = b.same_as::varchar) same_n
          from ends e join starts s using (pack, release_no)
          join t a on a.pack = e.pack and a.release_no = e.old_release and a.field = of
          join t b on b.pack = s.pack and b.release_no = s.release_no and b.field = nf and a.rid = b.rid
          group by all having same_n * 2 > both_n),
ren as (select * from agree qualify row_number() over (partition by pack, release_no, of order by same_n desc, of, nf) = 1
        and row_number() over (partition by pack, release_no, nf order by same_n desc, of, nf) = 1)
select pack, release_no, of field, 'renamed' change, nf new_field from ren
union all select pack, release_no, nf, 'retyped', '' from ren where ot <> nt
union all select pack, release_no, field, 'retyped', '' from w where prev_pos = pos - 1 and typ <> prev_typ
union all select pack, release_no, of, 'removed', '' from ends e where not exists (select 1 from ren r where r.pack = e.pack and r.release_no = e.release_no and r.of = e.of)
union all select pack, release_no, nf, 'added', '' from starts s where not exists (select 1 from ren r where r.pack = s.pack and r.release_no = s.release_no and r.nf = s.nf)""",
    "p4_value_counts": _P4_FIELDS + "select pack, release_no, record_no, count(*) n_values from t group by all",
    "p4_lifespans": _P4_FIELDS
    + """,
i as (select *, pos - row_number() over (partition by pack, field, typ order by pos) island from p)
select pack, field, typ "type", min(release_no) first_release, max(release_no) last_release, count(*) releases from i group by pack, field, typ, island""",
    "p5_nodes": _TREE + "select path, label, parent, kind, value from n",
    "p5_paths": _TREE + "select path, kind, count(*) n, count(distinct parent) n_parents from n group by all",
    "p5_metadata": _P5
    + r""",
m as (select raw_id || '.' || result_pos || '.' || finding_pos parent, case when json_type(v, '$.metadata') = 'VARCHAR' then json(json_extract_string(v, '$.metadata')) else json_extract(v, '$.metadata') end m from f where json_type(v) = 'OBJECT'),
o as (select parent, m, list_sort(json_keys(m)) ks from m where json_type(m) = 'OBJECT'),
e as (select parent, i - 1 pos, ks[i] "key", json_extract(m, '$."' || ks[i] || '"') v from o, range(1, len(ks)::bigint + 1) t(i)),
a as (select parent, list_filter(json_extract(m, '$[*]'), lambda x: json_extract_string(x, '$.key') is not null) xs from m where json_type(m) = 'ARRAY'),
l as (select parent, i - 1 pos, json_extract_string(xs[i], '$.key') "key", json_extract(xs[i], '$.value') v from a, range(1, len(xs)::bigint + 1) t(i)),
b as (select * from e union all select * from l)
select parent || '.' || pos as "label", parent, "key", v::varchar "value" from b""",
    "p5_found": _P5
    + r""",
m as (select raw_id, result_pos, finding_pos,
             coalesce(try_cast(case json_type(v, '$.location') when 'OBJECT' then json_extract_string(v, '$.location.start_line') else regexp_extract(json_extract_string(v, '$.location'), ':(\d+)$', 1) end as int), 0) line_no,
             case when json_type(v, '$.metadata') = 'VARCHAR' then json(json_extract_string(v, '$.metadata')) else json_extract(v, '$.metadata') end m
      from f where json_type(v) = 'OBJECT'),
k as (select *, case json_type(m) when 'OBJECT' then json_keys(m) when 'ARRAY' then json_extract_string(m, '$[*].key') else [] end ks from m)
select raw_id, result_pos::int result_pos, finding_pos::int finding_pos, line_no, unnest(case when len(ks) = 0 then [''] else ks end) meta_key from k""",
    "p5_results": _P5
    + r"""
select raw_id || '.' || result_pos as "label", raw_id::varchar parent, json_extract_string(v, '$.path') path, json_extract_string(v, '$.content_hash') content_hash, json_extract_string(v, '$.install_scope') install_scope
from r where json_type(v) = 'OBJECT'""",
    "p5_findings": _P5
    + r"""
select raw_id || '.' || result_pos || '.' || finding_pos as "label", raw_id || '.' || result_pos parent, json_extract_string(v, '$.rule_id') rule_id, json_extract_string(v, '$.severity') severity, json_extract_string(v, '$.category') category,
  case json_type(v, '$.location') when 'OBJECT' then json_extract_string(v, '$.location.file') else regexp_replace(json_extract_string(v, '$.location'), '(?::\d+){1,2}\s*$', '') end file,
  coalesce(try_cast(case json_type(v, '$.location') when 'OBJECT' then json_extract_string(v, '$.location.start_line') else regexp_extract(json_extract_string(v, '$.location'), ':(\d+)$', 1) end as int), 0) start_line
from f where json_type(v) = 'OBJECT'""",
}
