"""Finding and masking credentials in a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.llm import bpe, secrets
from scanfold.llm.encoding import broadcast_vocabulary
from scanfold.session import spread


def suspect(text: Column, file: Column) -> Column:
    """Can the row hold a credential at all? Decided in the JVM; most rows never reach Python."""
    return text.isNotNull() & F.coalesce(text.rlike(secrets.SUSPECT) | F.coalesce(file, F.lit("")).rlike(secrets.SUSPECT_FILE), F.lit(False))


def _scan(df: DataFrame, row_id: str, text: str, file: str | None, vocabulary: str | None, schema: str, emit: Callable) -> DataFrame:
    data = broadcast_vocabulary(df.sparkSession, vocabulary or bpe.vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.shared_encoder(data.value)
        for b in batches:
            yield emit(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), enc.count, b.schema.field(0).type)

    where = F.col(file) if file else F.lit(None).cast("string")
    src = df.select(F.col(row_id).alias("__id"), F.col(text).alias("__t"), where.alias("__f"))
    kind = src.schema["__id"].dataType.simpleString()
    return spread(src.where(suspect(F.col("__t"), F.col("__f")))).mapInArrow(run, schema.format(kind=kind))


def find_credentials(df: DataFrame, row_id: str, text: str, file: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(row_id, start, end, rule, secret): one row per credential; offsets count characters.

    Null, empty and blank texts give none. Repeated input rows give repeated results. Texts are read
    whole. Other columns aren't read, so their names don't matter.
    """

    def emit(ids, texts, files, count, kind):
        rows = [(i, a, b, r, t[a:b]) for i, t, f in zip(ids, texts, files) for a, b, r in secrets.find(t, count, f)]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
            ["__id", "start", "end", "rule", "secret"],
        )

    out = _scan(df, row_id, text, file, vocabulary, "__id {kind}, start int, end int, rule string, secret string", emit)
    return out.withColumnRenamed("__id", row_id)


def redact(df: DataFrame, row_id: str, text: str, file: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(row_id, redacted): every row's text, credentials masked character by character.

    One row for each input row; null stays null. A text without credentials is unchanged.
    """

    def emit(ids, texts, files, count, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array([secrets.masked(t, secrets.find(t, count, f)) for t, f in zip(texts, files)], pa.string())], ["__id", "redacted"]
        )

    seen = _scan(df, row_id, text, file, vocabulary, "__id {kind}, redacted string", emit).withColumnRenamed("__id", row_id)
    where = F.col(file) if file else F.lit(None).cast("string")
    clean = df.where(~suspect(F.col(text), where)).select(row_id, F.col(text).alias("redacted"))
    return clean.unionByName(seen)
