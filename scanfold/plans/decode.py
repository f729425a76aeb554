"""Queries of the decoders; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold import rules as R
from scanfold.functions import text as T
from scanfold.operators import decode, scan
from scanfold.plans.scan import SCAN_SQL
from scanfold.sources.tables import table


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "decoded_content").where(F.col("original").isNotNull() & F.col("encoding").isNotNull())
    return t.select("decoded_id", "encoding", "original").dropDuplicates(["decoded_id"])


def decode_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every stored piece decoded by the encoding it is marked with."""
    return _pieces(spark, d).select("decoded_id", decode.by_name(F.col("encoding"), F.col("original")).alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): documents and snippets as they are, and every stored piece twice in code, as pieces are stored without it."""
    code = _pieces(spark, d).select(F.concat(F.lit("p"), "decoded_id").alias("id"), F.concat(F.lit("x = '"), "original", F.lit("';\ny = \""), "original", F.lit('"')).alias("text"))
    docs = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    snippets = table(spark, d, "findings").where(F.col("finding_id").isNotNull()).select("finding_id", "snippet").distinct().select(F.concat(F.lit("f"), "finding_id").alias("id"), F.col("snippet").alias("text"))
    return code.unionByName(docs).unionByName(snippets)


def decode_layer(spark: SparkSession, d: str) -> DataFrame:
    """Encoded pieces found in documents, snippets and code, with offsets."""
    return decode.layer(_texts(spark, d), "id", "text").select("id", "encoding", "byte_offset", F.md5("decoded").alias("decoded_md5"))


def decode_spliced(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with every piece replaced by what it stands for."""
    t = decode.spliced(_texts(spark, d).where(F.col("text").rlike(decode.ANY_PIECE)), "id", "text")
    return t.select("id", F.md5("text").alias("text_md5"))


def decode_three_layers(spark: SparkSession, d: str) -> DataFrame:
    """Pieces wrapped in two more encodings, taken apart again."""
    p = _pieces(spark, d).where(F.length("original") > 0)
    inner = F.concat(F.lit("run('"), "original", F.lit("')"))
    outer = F.concat(F.lit("eval(atob('"), F.regexp_replace(F.base64(F.encode(inner, "utf-8")), r"\s", ""), F.lit("'))"))
    found = decode.decode_layers(p.select("decoded_id", outer.alias("text")), "decoded_id", "text")
    return found.groupBy("depth", "encoding").agg(F.count("*").alias("n"), F.sum("byte_offset").alias("offsets"))


def decoded_findings(spark: SparkSession, d: str) -> DataFrame:
    """Hidden payloads that rules for their file match: one finding per decoded text, with the titles of the rules."""
    patterns, _ = R.compile_rules(table(spark, d, "rules"))
    pieces = table(spark, d, "decoded_content").where(F.col("original").isNotNull() & F.col("encoding").isNotNull())
    pieces = pieces.groupBy("decoded_id").agg(F.min(F.struct("encoding", "original", "path")).alias("x")).select("decoded_id", "x.*")
    # the explode of one value keeps the decoding from being repeated for every pattern
    texts = pieces.select("decoded_id", F.explode(F.array(decode.by_name(F.col("encoding"), F.col("original")))).alias("text"), "path")
    m = scan.matches(texts, patterns, "decoded_id", "text", "path")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "pattern_no", "match_no", "title"))), lambda x: x["title"])
    return m.groupBy("decoded_id").agg(F.lit("OBFUSC-PAYLOAD").alias("rule_id"), F.count("*").alias("n"), F.array_join(titles, ", ").alias("titles"))  # the matches of one piece


def entropy_strings(spark: SparkSession, d: str) -> DataFrame:
    """The entropy of each stored piece."""
    return _pieces(spark, d).select("decoded_id", F.round(T.entropy(F.col("original")), 6).alias("entropy"))


def printable_texts(spark: SparkSession, d: str) -> DataFrame:
    """How many decoded texts read as text, by encoding."""
    p = _pieces(spark, d).withColumn("t", decode.by_name(F.col("encoding"), F.col("original")))
    return p.groupBy("encoding").agg(F.count("*").alias("n"), F.count("t").alias("n_decoded"), F.count_if(T.is_printable(F.col("t"))).alias("n_printable"))


QUERIES = {f.__name__: f for f in (decode_pieces, decode_layer, decode_spliced, decode_three_layers, decoded_findings, entropy_strings, printable_texts)}

_P = "with p as (select decoded_id, any_value(encoding) encoding, any_value(original) original from decoded_content where original is not null and encoding is not null group by decoded_id)\n"
_D = r"""case encoding
  when 'base64' then case when length({o}) % 4 = 0 then try(decode(from_base64({o}))) end
  when 'hex' then case when length({o}) % 2 = 0 then try(decode(unhex({o}))) end
  when 'unicode' then nullif(array_to_string(list_transform(regexp_extract_all({o}, '\\u([0-9a-fA-F]{{4}})', 1), lambda x: case when upper(x) between 'D800' and 'DFFF' then '' else chr(case when upper(x) between 'D800' and 'DFFF' then 32 else ('0x' || x)::int end) end), ''), '')
  when 'charcode' then nullif(array_to_string(list_transform(list_filter(string_split(regexp_extract({o}, '\(([^)]*)\)', 1), ','), lambda x: try_cast(trim(x) as int) is not null), lambda x: case when trim(x)::int between 55296 and 57343 or trim(x)::int > 1114111 then '' else chr(case when trim(x)::int between 55296 and 57343 or trim(x)::int > 1114111 then 32 else trim(x)::int end) end), ''), '')
  when 'url-encoded' then try(url_decode({o})) end"""
_OK = r"(length({t}) > 0 and (length({t}) - length(regexp_replace({t}, '[\p{{L}}\p{{N}}\s!-/:-@\[-`{{-~]', '', 'g'))) / length({t}) > 0.7)"


def _sql_text(x: str) -> str:
    return x.replace("'", "''")


_ENCODINGS = "(values " + ", ".join(f"({k}, '{n}', '{_sql_text(p)}', {int(n in decode.QUOTED)})" for k, (n, p) in enumerate(decode.ENCODINGS.items())) + ") e(k, encoding, pat, q)"


def _layer(src: str, name: str) -> str:
    """The pieces of the texts of ``src`` (id, text), as CTEs whose last one is ``name``."""
    return f"""
{name}_m as (select id, k, encoding, q, regexp_extract_all(text, pat) ms, regexp_split_to_array(text, pat) gs from {src}, {_ENCODINGS} where regexp_matches(text, pat)),
{name}_i as (select *, unnest(range(len(ms))) i from {name}_m),
{name}_p as (select id, k, encoding, strlen(array_to_string(list_concat(gs[1:i + 1], ms[1:i]), '')) + q byte_offset, case q when 1 then substr(ms[i + 1], 2, length(ms[i + 1]) - 2) else ms[i + 1] end original from {name}_i),
{name}_d as (select *, {_D.format(o="original")} decoded from {name}_p),
{name} as (select id, encoding, byte_offset, original, decoded from {name}_d where decoded is not null and (encoding not in ('base64', 'hex', 'url-encoded') or {_OK.format(t="decoded")})
  qualify row_number() over (partition by id, byte_offset order by k) = 1)"""


def _splice(src: str, name: str) -> str:
    """The texts of ``src`` with their pieces replaced, as CTEs whose last one is ``name`` (id, text)."""
    return f"""
{name}_c as (select id, regexp_extract_all(text, '{_sql_text(decode.ANY_PIECE)}') ms, regexp_split_to_array(text, '{_sql_text(decode.ANY_PIECE)}') gs from {src} where regexp_matches(text, '{_sql_text(decode.ANY_PIECE)}')),
{name}_i as (select id, unnest(range(len(ms))) i, unnest(ms) m from {name}_c),
{name}_e as (select id, i, k, m, q, encoding, case q when 1 then substr(m, 2, length(m) - 2) else m end original from {name}_i, {_ENCODINGS} where regexp_full_match(m, pat)),
{name}_d as (select *, {_D.format(o="original")} d from {name}_e),
{name}_s as (select id, i, case q when 1 then m[1] || d || m[-1] else d end shown from {name}_d where d is not null and (encoding not in ('base64', 'hex', 'url-encoded') or {_OK.format(t="d")}) qualify row_number() over (partition by id, i order by k) = 1),
{name} as (select c.id, coalesce(string_agg(c.gs[i.i + 1] || coalesce(s.shown, i.m), '' order by i.i), '') || any_value(c.gs[-1]) as text from {name}_c c join {name}_i i using (id) left join {name}_s s using (id, i) group by c.id)"""


_TEXTS = _P + """, t as (select 'p' || decoded_id id, 'x = ' || chr(39) || original || chr(39) || ';' || chr(10) || 'y = "' || original || '"' as text from p union all select 'd' || doc_id, text from documents where doc_id is not null
union all select distinct 'f' || finding_id, snippet from findings where finding_id is not null),"""
_WRAPPED = _P + ", t as (select decoded_id id, 'eval(atob(' || chr(39) || to_base64(encode('run(' || chr(39) || original || chr(39) || ')')) || chr(39) || '))' as text from p where length(original) > 0),"
_HIDDEN = (
    "with dp as (select decoded_id, min({'encoding': encoding, 'original': original, 'path': path}) x from decoded_content where original is not null and encoding is not null group by decoded_id),\n"
    "dt as (select decoded_id, x.path path, x.encoding encoding, x.original original from dp),\ndx as (select decoded_id doc_id, path, " + _D.format(o="original") + " as text from dt),\np as"
)
ORACLE = {
    "decode_layer": _TEXTS + _layer("t", "l") + " select id, encoding, byte_offset, md5(decoded) decoded_md5 from l",
    "decode_spliced": _TEXTS + _splice("t", "s") + " select id, md5(text) text_md5 from s",
    "decode_three_layers": ",".join([_WRAPPED + _layer("t", "l0"), _splice("t", "t1"), _layer("t1", "l1"), _splice("t1", "t2"), _layer("t2", "l2")])
    + """ select depth::int "depth", encoding, count(*) n, sum(byte_offset)::bigint offsets from (select 0 depth, * from l0 union all select 1, * from l1 union all select 2, * from l2) group by all""",
    "decoded_findings": SCAN_SQL.format(where="").replace("with p as", _HIDDEN).replace("from documents d, p", "from dx d, p")
    + """ select doc_id decoded_id, 'OBFUSC-PAYLOAD' rule_id, count(*) n, string_agg(title, ', ' order by rule_id, pattern_no, match_no) titles from found join (select rule_id, any_value(title) title from rules group by rule_id) using (rule_id) group by doc_id""",
    "decode_pieces": _P + "select decoded_id, " + _D.format(o="original") + " text from p",
    "entropy_strings": "with recursive " + _P[5:] + ", c as (select decoded_id, unnest(regexp_extract_all(hex(encode(original)), '..')) b from p), n as (select decoded_id, b, count(*) k from c group by all), "
    "s as (select decoded_id, sum(k) t from n group by 1) select p.decoded_id, round(coalesce((select -sum(k / t * log2(k / t)) from n join s using (decoded_id) where n.decoded_id = p.decoded_id), 0), 6) entropy from p",
    "printable_texts": _P
    + ", t as (select encoding, "
    + _D.format(o="original")
    + r""" t from p)
      select encoding, count(*) n, count(t) n_decoded, count(*) filter (length(t) > 0 and (length(t) - length(regexp_replace(t, '[\p{L}\p{N}\s!-/:-@\[-`{-~]', '', 'g'))) / length(t) > 0.7) n_printable from t group by encoding""",
}
