"""p1, p3, p4 and p5 on hand-made rows: nulls, empty tables, ties, repeated rows, clashing columns."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scanfold.functions.keys import hash_key, rule_key
from scanfold.operators import drift, flatten, ranged, seen


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rule_key(spark):
    ids = ["GRANT-005", " grant_5", "Grant-005 ", "GRANT005", "GRANT-5", "odd id!", "", " ", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "r string").select(rule_key(F.col("r"))).collect()]
    assert got == ["GRANT-5"] * 5 + ["ODD ID!", None, None, None]


def test_hash_key(spark):
    h = "ab" * 32
    vals = [h, h.upper(), f" {h}\n", f"sha256:{h}", f"SHA256-{h.upper()}", h[:40], "n/a", "", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in vals], "r string").select(hash_key(F.col("r"))).collect()]
    assert got == [h] * 5 + [None] * 4


def test_ranged_counts_hot_key_and_repeats(spark):
    data = [("hot", i % 900) for i in range(3000)] + [("cold", 1), ("cold", 1), (None, 5), ("x", None)]
    df = spark.createDataFrame(data, "k string, id int").withColumn("__slice", F.lit("clash"))
    out = ranged.ranged_aggregate(df.select("k", "id"), "k", ["id"], {"n": F.count("*")}, {"n": F.sum("n")}, partitions=7)
    assert rows(out.where("k is not null")) == [("cold", 1), ("hot", 900), ("x", 1)]
    assert rows(out.where("k is null")) == [(None, 1)]
    assert ranged.ranged_aggregate(df.select("k", "id").limit(0), "k", ["id"], {"n": F.count("*")}, {"n": F.sum("n")}).count() == 0


def test_ranged_splits_a_heavy_key(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id"))
    sizes = [r[1] for r in ranged.sliced(df, "k", ["id"], 8).groupBy(ranged.SLICE).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 8000


def test_ranged_timeline_across_slices(spark):
    at = [0, 10, 20, 1000, 1005]
    df = spark.createDataFrame([("a", t, t) for t in at] + [("a", 20, 20), ("b", 3, 1), ("c", None, 2)], "k string, s long, id long").withColumn("t", F.timestamp_seconds("s"))
    for n in (1, 3, 6):
        got = rows(ranged.ranged_timeline(df, "k", "t", "id", n))
        assert got == [("a", 5, 0, 1005 * 10**6, 980 * 10**6), ("b", 1, 3 * 10**6, 3 * 10**6, 0)]
    null = spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), (None, 5, "y"), ("z", 2, "q")], "k string, s long, id string").withColumn("t", F.timestamp_seconds("s"))
    assert set(map(tuple, ranged.ranged_timeline(null, "k", "t", "id", 2).collect())) == {(None, 2, 10**6, 5 * 10**6, 4 * 10**6), ("z", 1, 2 * 10**6, 2 * 10**6, 0)}
    assert ranged.ranged_timeline(null.limit(0), "k", "t", "id").count() == 0


def test_ranged_timeline_shuffles_rows_once(spark):
    """One exchange of rows by range; what follows moves a state per slice and key, also over batches of Arrow."""
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', 'k' || id % 7) k", "timestamp_seconds(id * id) t", "id")
    out = ranged.ranged_timeline(df, "k", "t", "id", 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.index("MapInArrow") < plan.index("Exchange rangepartitioning")
    assert plan[plan.index("MapInArrow") :].count("Exchange") == 1
    hot = next(r for r in out.collect() if r.k == "hot")
    assert (hot.n_rows, hot.longest_pause_us) == (20_000, (59_997**2 - 59_994**2) * 10**6)


@pytest.mark.parametrize("bits", [64, 3])
def test_seen_store_matches_brute_force(spark, bits):
    known, data, before, want = {"k1", "k2"}, [], set(), []
    for no in range(1, 121):
        key = None if no % 11 == 0 else "hot" if no % 3 == 0 else f"k{no % 17}"
        data.append((no, key))
        if key is not None:
            if key in known or key in before:
                want.append(no)
            before.add(key)
    df = spark.createDataFrame(data, "no long, key string")
    store = seen.SeenStore(spark, fanout=2, hash_bits=bits)
    store.load(spark.createDataFrame([(k,) for k in known] + [(None,)], "key string"))
    got, counts = [], []
    for b in seen.split_by_arrival(df, "no", 5):
        answers, n = store.observe(b)
        got += [r[0] for r in answers.collect()]
        counts.append(n)
    assert sorted(got) == want
    assert len(store.runs) < 4 and max(r.level for r in store.runs) > 1
    assert (sum(n["hash_only_hits"] for n in counts) > 0) == (bits == 3)
    empty, n = store.observe(df.limit(0))
    assert empty.count() == 0 and n["keys"] == 0
    paths = [r.path.removeprefix("file:") for r in store.runs]
    assert all(os.path.isdir(p) for p in paths)
    store.close()
    assert not any(os.path.isdir(p) for p in paths) and sorted(got) == want


def test_seen_reads_only_what_fences_meet(spark):
    store = seen.SeenStore(spark, block_rows=2_000, group_bytes=20_000)
    store.load(spark.range(64_000).selectExpr("sha2(cast(id as string), 256) key"))
    blocks = 1 << store.runs[0].bits
    assert blocks == 32
    batch = spark.range(5).selectExpr("id no", "sha2(cast(if(id < 3, id * 1000, -id) as string), 256) key")
    answers, n = store.observe(batch)
    assert sorted(r[0] for r in answers.collect()) == [0, 1, 2] and n == {"keys": 5, "key_hits": 3, "hash_only_hits": 0}
    assert store.blocks_read.value <= 5 < blocks and store.groups_read.value <= 5 < store.groups_met.value
    assert [r.level for r in store.runs] == [3, 0]


def test_seen_probe_moves_no_run(spark):
    store = seen.SeenStore(spark)
    store.load(spark.range(500).selectExpr("cast(id as string) key"))
    firsts = spark.range(20).select(F.xxhash64(F.col("id").cast("string")).alias("h"), F.col("id").cast("string").alias("key"), F.col("id").alias("first_no"))
    plan = store.probe(firsts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def _records(spark, packs):
    out, no = [], 0
    for (pack, release), records in packs.items():
        for r in records:
            no += 1
            out.append((no, pack, release, r if isinstance(r, str) or r is None else json.dumps(r)))
    return spark.createDataFrame([*out, *out[:1]], "record_no long, pack string, release_no int, record string")


def test_drift_changes(spark):
    p = {
        ("a", 1): [{"id": "1", "pattern": "x", "author": "z", "old": 1}, {"id": "2", "pattern": "y", "author": None}, '{"id": "3", "broken', None, "", "[1]"],
        ("a", 2): [{"id": "1", "match": ["x"], "author": ["z"]}, {"id": "2", "match": ["y"], "new": True}],
        ("a", 4): [{"id": "1", "match": ["x"], "author": ["z"], "old": 1}],
        ("b", 7): [{"id": "1", "only": "once"}],
    }
    f = drift.record_fields(_records(spark, p), "record_no", "pack", "release_no", "record", "id")
    got = rows(drift.changes(f))
    assert got == sorted(
        [
            ("a", 2, "pattern", "renamed", "match"),
            ("a", 2, "match", "retyped", ""),
            ("a", 2, "author", "retyped", ""),
            ("a", 2, "old", "removed", ""),
            ("a", 2, "new", "added", ""),
            ("a", 4, "new", "removed", ""),
            ("a", 4, "old", "added", ""),
        ]
    )
    spans = {(r.field, r.first_release, r.last_release) for r in drift.lifespans(drift.footers(f)).where("producer = 'a'").collect()}
    assert ("old", 1, 1) in spans and ("old", 4, 4) in spans and ("match", 2, 4) in spans
    names = drift.alias_table(drift.changes(f), drift.footers(f))
    assert names["pattern"] == names["match"]
    table = drift.consistent_table(f, names, {names["pattern"]: "list"})
    assert sorted(map(tuple, table.select(names["pattern"]).where("producer = 'a'").collect())) == [(["x"],), (["x"],), (["x"],), (["y"],), (["y"],)]
    none = drift.record_fields(_records(spark, p).limit(0), "record_no", "pack", "release_no", "record", "id")
    assert drift.changes(none).count() == 0


def test_drift_table_keeps_every_value(spark):
    p = {
        ("a", 1): [{"id": "1", "pattern": "x", "patterns": ["u", "v"], "score": 1, "on": True}, {"id": "2", "pattern": "y", "score": 2}],
        ("a", 2): [{"id": "1", "match": "x", "patterns": ["u", "v"], "score": "high"}, {"id": "2", "match": "y"}],
        ("b", 1): [{"id": "1", "patterns": ["w"], "owner": "me"}, {"id": "2", "patterns": ["z"], "owner": "you"}],
        ("b", 2): [{"id": "1", "match": "w", "author": ["me"]}, {"id": "2", "match": "z", "author": ["you"]}],
        ("d", 1): [{"id": "1", "pattern": "q", "patterns": ["r"]}],
        ("d", 2): [{"id": "1", "pattern": "q", "patterns": ["r"]}],
    }
    raw = _records(spark, p)
    lone = raw.limit(0).unionByName(spark.createDataFrame([(None, "c", 1, '{"id": "7", "pattern": "k"}'), (None, "c", 1, '{"id": "8", "author": "l"}')], raw.schema))
    f = drift.record_fields(raw.unionByName(lone), "record_no", "pack", "release_no", "record", "id")
    foot = drift.footers(f)
    to = drift.producer_aliases(f, drift.changes(f, foot), foot)
    named = {(r.producer, r.field): r.column for r in to.collect()}
    assert named["a", "match"] == "pattern" and named["a", "patterns"] == "patterns" and named["b", "match"] == "patterns"
    assert named["b", "owner"] == named["b", "author"] == named["c", "author"]
    casts = drift.column_casts(f, to)
    assert casts["on"] == "boolean" and casts["score"] == "text" and casts["patterns"] == "list"
    t = drift.consistent_table(f, to, casts)
    assert t.count() == 12
    filled = sum(sum(v is not None for v in r[3:]) for r in t.collect())
    assert filled == f.count()
    one = t.where("producer = 'a' and release = 2 and id = '1'").first()
    assert (one.pattern, one.patterns, one.score) == ("x", ["u", "v"], "high")
    assert sorted(r.id for r in t.where("producer = 'c'").collect()) == ["7", "8"]


def test_drift_keeps_the_delivery_that_parses(spark):
    cut, whole = '{"id": "1", "pattern": "a', '{"id": "1", "pattern": "a"}'
    for order in ([cut, whole], [whole, cut], [None, whole, ""]):
        raw = spark.createDataFrame([(5, "p", 1, x) for x in order], "record_no long, pack string, release_no int, record string").coalesce(1)
        assert rows(drift.record_fields(raw, "record_no", "pack", "release_no", "record", "id").select("field", "value")) == [("id", '"1"'), ("pattern", '"a"')]


def test_flatten_forms(spark):
    m = {"a": 1, "b": None}
    finding = lambda meta, loc: {"rule_id": "R", "metadata": meta, "location": loc}
    report = {
        "results": [
            None,
            {"path": "p", "findings": [finding(m, {"file": "f", "start_line": 5}), None, finding(json.dumps(m), "f:7")]},
            {"path": "q", "findings": finding([{"key": "k", "value": 1}, {"value": 2}], {"start_line": "9"})},
            {"path": "r", "findings": json.dumps([finding({}, None)])},
            {"path": "s", "findings": None},
        ]
    }
    raw = [(1, json.dumps(report)), (1, json.dumps(report)), (2, json.dumps({"data": {"report": {"results": {"findings": [finding(None, None)]}}}})), (3, json.dumps(report)[:-9]), (4, None), (5, ""), (6, "null"), (7, "[]"), (None, "{}")]
    df = spark.createDataFrame(raw, "raw_id long, payload string")
    t = flatten.scan_report_tables(df)
    labels = {r.label for r in t["findings"].collect()}
    assert labels == {"1.1.0", "1.1.2", "1.2.0", "1.3.0", "2.0.0"}
    line = {r.label: r.n for r in t["findings"].select("label", flatten.location_line(flatten.member(F.col("v"), "location")).alias("n")).collect()}
    assert line == {"1.1.0": 5, "1.1.2": 7, "1.2.0": 9, "1.3.0": 0, "2.0.0": 0}
    meta = {(r.label, r.key) for r in t["metadata"].collect()}
    assert meta == {("1.1.0.0", "a"), ("1.1.0.1", "b"), ("1.1.2.0", "a"), ("1.1.2.1", "b"), ("1.2.0.0", "k")}
    up = {r[0]: r[1] for r in t["metadata"].select("label", flatten.parent(F.col("label"))).collect()}
    assert up["1.1.0.1"] == "1.1.0" and set(up.values()) <= labels
    assert flatten.scan_report_tables(df.limit(0))["metadata"].count() == 0


def test_flatten_keeps_the_delivery_that_parses(spark):
    whole = json.dumps({"results": [{"path": "p", "findings": [{"rule_id": "r"}]}]})
    for rows_ in ([(1, whole[:-7]), (1, whole)], [(1, whole), (1, whole[:-7])], [(1, None), (1, whole), (1, "")]):
        t = flatten.scan_report_tables(spark.createDataFrame(rows_, "raw_id long, payload string").coalesce(1))
        assert rows(t["findings"].select("label")) == [("1.0.0",)]
    two = [(2, '{"results": []}'), (2, whole)]
    for order in (two, two[::-1]):
        assert flatten.scan_report_tables(spark.createDataFrame(order, "raw_id long, payload string"))["results"].count() == 1


def test_tree_of_any_records(spark):
    x = {"a": {"b": [{"c": 1}, None, {"c": [True, "t"]}], "e": {}}, "f": [[1, 2], [{"g": "h"}]], "n": None, "s": '{"k": [7]}'}
    df = spark.createDataFrame([(9, json.dumps(x)), (8, "[5]"), (7, "{"), (6, None)], "id long, payload string").withColumn("label", F.lit("clash"))
    roots = flatten.records(df, "id", "payload", [])
    depth = flatten.max_depth(df, "payload")
    got = {(r.path, r.label): (r.parent, r.kind, r.value) for r in flatten.tree(roots, depth).collect()}
    want = {
        ("$", "9"): (None, "object", None), ("$.a", "9.0"): ("9", "object", None), ("$.a.b", "9.0.0"): ("9.0", "object", None), ("$.a.b", "9.0.2"): ("9.0", "object", None), ("$.a.b.c", "9.0.0.0"): ("9.0.0", "number", "1"),
        ("$.a.b.c", "9.0.2.0"): ("9.0.2", "boolean", "true"), ("$.a.b.c", "9.0.2.1"): ("9.0.2", "string", '"t"'), ("$.a.e", "9.0.0"): ("9.0", "object", None), ("$.f", "9.0.0"): ("9.0", "number", "1"), ("$.f", "9.0.1"): ("9.0", "number", "2"),
        ("$.f", "9.1.0"): ("9.1", "object", None), ("$.f.g", "9.1.0.0"): ("9.1.0", "string", '"h"'), ("$.s", "9.0"): ("9", "string", json.dumps(x["s"])), ("$", "8.0"): ("8", "number", "5"),
    }
    assert got == want and depth == 5
    assert ("$.s.k", "9.0.0", "7") in {(r.path, r.label, r.value) for r in flatten.tree(roots, depth, unpack=True).collect()}
    cut = {(r.path, r.value) for r in flatten.tree(roots, 1).collect()}
    assert ("$.a", json.dumps(x["a"], separators=(",", ":"))) in cut
    assert flatten.tree(flatten.records(df.limit(0), "id", "payload", []), flatten.max_depth(df.limit(0), "payload")).count() == 0


def test_flatten_keeps_every_field(spark):
    finding = {"rule_id": "R", "title": "t", "severity": "high", "category": "c", "snippet": "s", "remediation": "r", "extra": [1]}
    places = [{"file": "f", "start_line": "5", "end_line": 6, "start_column": 1, "end_column": 9, "odd": True}, "a:b.py:7:3", "c.py", json.dumps({"file": "g", "start_line": 8}), [1, 2], None]
    report = {
        "scan_root": "/r", "platform": "p", "timestamp": "now", "total_time_ms": 12, "rule_count": "many", "new": {"x": 1},
        "components": [{"kind": "k", "name": "n", "root": "/r", "manifest": "m", "more": 2}, None],
        "results": [{"path": "p", "scan_time_ms": 3, "findings": [finding | {"location": x} for x in places] + [finding | {"metadata": [{"key": "a", "value": 1}, {"value": 2}]}]}, {"path": "q", "findings": 5}],
    }
    t = flatten.scan_report_tables(spark.createDataFrame([(1, json.dumps(report))], "raw_id long, payload string"))
    got = {n: flatten.report_rows(t, n).orderBy("label").collect() for n in ("reports", "components", "results", "findings", "locations")}
    (r,) = got["reports"]
    assert (r.label, r.scan_root, r.platform, r.timestamp, r.total_time_ms, r.rule_count) == ("1", "/r", "p", "now", 12, None)
    assert json.loads(r.rest) == {"rule_count": "many", "new": {"x": 1}}
    assert [tuple(c) for c in got["components"]] == [("1.0", "1", "k", "n", "/r", "m", '{"more":2}')]
    assert [(r.label, r.scan_time_ms, r.rest) for r in got["results"]] == [("1.0", 3, None), ("1.1", None, '{"findings":5}')]
    f = got["findings"]
    assert len(f) == 7 and all((x.title, x.snippet, x.remediation, x.parent) == ("t", "s", "r", "1.0") for x in f)
    assert [json.loads(x.rest) for x in f[:6]] == [{"extra": [1]}] * 6 and "metadata" in json.loads(f[6].rest)
    assert [tuple(x)[1:] for x in got["locations"]] == [
        ("1.0.0", "f", 5, 6, 1, 9, '{"odd":true}'),
        ("1.0.1", "a:b.py", 7, None, 3, None, None),
        ("1.0.2", "c.py", None, None, None, None, None),
        ("1.0.3", "g", 8, None, None, None, None),
        ("1.0.4", None, None, None, None, None, "[1,2]"),
    ]
