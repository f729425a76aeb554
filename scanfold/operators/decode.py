"""Payloads hidden by encodings: base64, hex, \\u escapes, character codes, percent escapes.

One layer is a projection: the text is cut at the encoded pieces, each piece is decoded by
built-in functions, and the texts between and the decoded pieces are put together again.
Layers repeat on the new text up to a depth. Only byte offsets are counted outside the JVM, and
only pieces at one offset meet in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions.text import is_printable
from scanfold.operators import places
from scanfold.session import spread, written

# What an encoded piece looks like, in the order in which an offset is claimed.
ENCODINGS = {
    "base64": r"""['"`][A-Za-z0-9+/]{20,}={0,2}['"`]""",
    "hex": r"""['"`][0-9a-fA-F]{20,}['"`]""",
    "unicode": r"(?:\\u[0-9a-fA-F]{4}){4,}",
    "charcode": r"String\s*\.\s*fromCharCode\s*\(\s*(?:\d+\s*,?\s*){3,}\)",
    "url-encoded": r"(?:%[0-9a-fA-F]{2}){5,}",
}
QUOTED = {"base64", "hex"}
MAX_DEPTH = 3


def _utf8(code: Column) -> Column:
    """The character of a code point; null outside Unicode and for surrogates."""
    h = lambda v: F.lpad(F.hex(v), 2, "0")
    low = lambda k: (F.floor(code / (64**k)) % 64 + 128).cast("int")
    top = lambda k, mark: (F.floor(code / (64**k)) + mark).cast("int")
    data = (
        F.when(code < 0x80, h(code))
        .when(code < 0x800, F.concat(h(top(1, 0xC0)), h(low(0))))
        .when((code >= 0xD800) & (code <= 0xDFFF), None)
        .when(code < 0x10000, F.concat(h(top(2, 0xE0)), h(low(1)), h(low(0))))
        .when(code < 0x110000, F.concat(h(top(3, 0xF0)), h(low(2)), h(low(1)), h(low(0))))
    )
    return F.decode(F.unhex(data), "utf-8")


def _chars(codes: Column) -> Column:
    return F.array_join(F.filter(F.transform(codes, _utf8), lambda c: c.isNotNull()), "")


def _text(data: Column) -> Column:
    """The bytes as text; null if they aren't valid UTF-8."""
    s = data.cast("string")
    return F.when(F.is_valid_utf8(s), s)


def decode(encoding: str, piece: Column) -> Column:
    """What a piece without its quotes stands for; null if it can't be decoded."""
    if encoding == "base64":
        return F.when(F.length(piece) % 4 == 0, _text(F.try_to_binary(piece, F.lit("base64"))))
    if encoding == "hex":
        return F.when(F.length(piece) % 2 == 0, _text(F.try_to_binary(piece, F.lit("hex"))))
    if encoding == "unicode":
        codes = F.transform(F.regexp_extract_all(piece, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))
        return F.nullif(_chars(codes), F.lit(""))
    if encoding == "charcode":
        codes = F.filter(F.transform(F.split(F.regexp_extract(piece, r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x).try_cast("int")), lambda c: c.isNotNull())
        return F.nullif(_chars(codes), F.lit(""))
    if encoding == "url-encoded":
        return F.try_url_decode(piece)
    raise ValueError(f"unknown encoding {encoding!r}")


def by_name(encoding: Column, piece: Column) -> Column:
    """``decode`` for an encoding that differs from row to row; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name in ENCODINGS:
        out = F.when(encoding == name, decode(name, piece)).otherwise(out)
    return out


def layer(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, encoding, byte_offset, original, decoded): the encoded pieces of one layer.

    At each offset the first encoding in order counts. Decoded base64, hex and percent escapes must be mostly
    printable. Null texts have none. Repeated rows give repeated pieces.
    """
    src = df.select(F.col(row_id).alias("__id"), F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    kinds = [F.when(F.col("__t").rlike(p), F.struct(F.lit(k).alias("k"), F.lit(n).alias("encoding"), F.lit(p).alias("p"))) for k, (n, p) in enumerate(ENCODINGS.items())]
    # the texts are read once, and a row made for each encoding that one holds
    some = src.select("__id", "__t", F.explode_outer(F.array_compact(F.array(*kinds))).alias("e")).where(F.col("e").isNotNull())
    cut = some.select("__id", "e.k", "e.encoding", F.regexp_extract_all("__t", F.col("e.p"), F.lit(0)).alias("__m"), F.split("__t", F.col("e.p"), -1).alias("__g"))
    quoted = F.col("encoding").isin(*QUOTED)
    piece = places.placed(cut, "__m", "__g", None).select(
        "__id",
        "k",
        "encoding",
        (F.col("byte_offset") + quoted.cast("int")).alias("byte_offset"),
        F.when(quoted, F.substr("matched", F.lit(2), F.length("matched") - 2)).otherwise(F.col("matched")).alias("original"),
    )
    # the explode of one value keeps the decoding from being repeated
    piece = piece.select("*", F.explode(F.array(by_name(F.col("encoding"), F.col("original")))).alias("decoded")).where(F.col("decoded").isNotNull())
    piece = piece.where(~F.col("encoding").isin("base64", "hex", "url-encoded") | is_printable(F.col("decoded")))
    first = piece.groupBy("__id", "byte_offset").agg(F.min_by(F.struct("encoding", "original", "decoded"), "k").alias("x"))
    return first.select(F.col("__id").alias(row_id), "x.encoding", "byte_offset", "x.original", "x.decoded")


ANY_PIECE = "|".join(f"(?:{p})" for p in ENCODINGS.values())


def spliced(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text) with every decodable piece replaced by what it stands for.

    All pieces of the text are replaced at once: what comes out of one is left for the next layer. The explodes of
    one value keep the planner from repeating the steps inside each other.
    """
    cut = F.struct(F.split(text, ANY_PIECE, -1).alias("g"), F.regexp_extract_all(text, F.lit(ANY_PIECE), F.lit(0)).alias("m"))
    df = df.select(row_id, F.explode(F.array(cut)).alias("c"))
    joined = F.zip_with("c.g", F.transform("c.m", _shown), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return df.select(row_id, F.explode(F.array(F.array_join(joined, ""))).alias(text))


def _shown(m: Column) -> Column:
    """A piece decoded by the first encoding that can; as it is, if none can."""
    out = []
    for name, pattern in ENCODINGS.items():
        quoted = name in QUOTED
        d = decode(name, F.substr(m, F.lit(2), F.length(m) - 2) if quoted else m)
        ok = is_printable(d) if name in ("base64", "hex", "url-encoded") else d.isNotNull()
        plain = F.concat(F.left(m, F.lit(1)), d, F.right(m, F.lit(1))) if quoted else d
        out.append(F.when(m.rlike(f"^(?:{pattern})$") & F.coalesce(ok, F.lit(False)), plain))
    return F.coalesce(*out, m)


def decode_layers(df: DataFrame, row_id: str, text: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(row_id, depth, encoding, byte_offset, original, decoded) of all layers; offsets are in the layer's own text."""
    now = spread(df.select(F.col(row_id), F.col(text).alias("__text")))
    out = None
    for k in range(depth):
        now = now.where(F.col("__text").rlike(ANY_PIECE))
        part = layer(now, row_id, "__text").withColumn("depth", F.lit(k))
        out = part if out is None else out.unionByName(part)
        if k + 1 < depth:
            now = written(spliced(now, row_id, "__text"), "decoded")  # else every layer decodes the ones before it again
    return out.select(row_id, "depth", "encoding", "byte_offset", "original", "decoded")


def high_entropy(df: DataFrame, row_id: str, text: str, least: float = 5.5, min_bytes: int = 50) -> DataFrame:
    """(row_id, string, entropy): quoted strings of many bytes and high entropy."""
    from scanfold.functions.text import entropy

    s = df.select(row_id, F.explode(F.regexp_extract_all(text, F.lit(r"""["'`]([^"'`\n]{%d,})["'`]""" % min_bytes), F.lit(1))).alias("string"))
    e = s.where(F.octet_length("string") >= min_bytes).withColumn("entropy", F.round(entropy(F.col("string")), 6))
    return e.where(F.col("entropy") > least)
