"""Per-key results when a few keys hold most rows.

Rows are range partitioned on the composite (key, secondary order). Spark takes the
bounds from sampled quantiles of that composite, so a heavy key covers as many
partitions as its share of the rows asks for, and a light key shares one with its
neighbours. Every partition makes one small partial state per key it holds; only
those states are shuffled again, and stitching them in partition order gives the
result. No task ever holds more than one range, whatever a key's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"


def sliced(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range partitioned on (key, order), with the range's number as ``__slice``.

    Equal (key, order) tuples meet in one slice. Slices follow the order, so those of
    one key are consecutive numbers.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key, *order).withColumn(SLICE, F.spark_partition_id())


def ranged_aggregate(
    df: DataFrame, key: str, order: list[str], partial: dict[str, Column], stitch: dict[str, Column], partitions: int | None = None, distinct: bool = True
) -> DataFrame:
    """Per-key aggregate: ``partial`` inside every slice, ``stitch`` over the partial states.

    ``stitch`` refers to the columns named in ``partial``. With ``distinct``, rows that
    agree in key and order count once; they are in one slice, so this needs no further
    shuffle. Rows with a null key are one group of their own. An empty input gives no
    row. Columns not named in key, order or ``partial`` are never read.
    """
    split = sliced(df, key, order, partitions)
    if distinct:
        split = split.dropDuplicates([key, *order])
    states = split.groupBy(SLICE, key).agg(*[c.alias(n) for n, c in partial.items()])
    return states.groupBy(key).agg(*[c.alias(n) for n, c in stitch.items()])


def _pauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's sorted rows (key, time, id, slice) to a state for each key: slice, key, rows, first, last, longest pause.

    Rows that agree in all count once. The state of the last key goes on into the next batch.
    """
    names = [SLICE, "__k", "__n", "__first", "__last", "__gap"]
    last: list | None = None  # slice, key, rows, first, last, pause
    last_id = None
    kind = None
    for b in batches:
        if not len(b):
            continue
        kind = b.schema.field(0).type
        runs = pc.run_end_encode(b.column(0))
        ends, keys = runs.run_ends.to_numpy(), runs.values.to_pylist()
        at, ids, no = b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3)[0].as_py()
        out = []
        for a, e, k in zip([0, *ends[:-1]], ends, keys):
            goes_on = last is not None and last[1] == k
            times = at[a:e]
            fresh = np.ones(e - a, bool)
            fresh[0] = not (goes_on and last[4] == times[0] and last_id == ids[a])
            same = np.flatnonzero(times[1:] == times[:-1]) + 1
            fresh[same] = [ids[a + j] != ids[a + j - 1] for j in same]
            pause = int(np.diff(times).max(initial=0))
            if goes_on:
                last = [no, k, last[2] + int(fresh.sum()), last[3], int(times[-1]), max(last[5], pause, int(times[0]) - last[4])]
            else:
                if last is not None:
                    out.append(last)
                last = [no, k, int(fresh.sum()), int(times[0]), int(times[-1]), pause]
            last_id = ids[e - 1]
        if out:
            yield _states(out, kind, names)
    if last is not None:
        yield _states([last], kind, names)


def _states(rows: list[list], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int32(), kind, *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def ranged_timeline(df: DataFrame, key: str, at: str, row_id: str, partitions: int | None = None) -> DataFrame:
    """Per key: rows, first and last time, and the longest pause between successive times.

    The pause needs neighbours in order, also across a slice's edge: every slice keeps
    its first and last time, and the stitch compares each slice with the one before it.
    Distinct by ``row_id``; nulls in ``at`` or ``row_id`` are left out, null keys are one
    group. Ties in time make pauses of 0; a key of one row has a pause of 0. Times are
    microseconds since 1970.
    """
    narrow = df.where(F.col(at).isNotNull() & F.col(row_id).isNotNull()).select(F.col(key).alias("__k"), F.unix_micros(at).alias("__at"), F.col(row_id).alias("__id"))
    kind = narrow.schema["__k"].dataType.simpleString()
    split = sliced(narrow, "__k", ["__at", "__id"], partitions).sortWithinPartitions("__k", "__at", "__id")
    states = split.mapInArrow(_pauses, f"{SLICE} int, __k {kind}, __n bigint, __first bigint, __last bigint, __gap bigint").withColumnRenamed("__k", key)
    edge = Window.partitionBy(key).orderBy(SLICE)  # a few states per key, not its rows
    return (
        states.withColumn("__edge", F.col("__first") - F.lag("__last").over(edge))
        .groupBy(key)
        .agg(
            F.sum("__n").alias("n_rows"),
            F.min("__first").alias("first_us"),
            F.max("__last").alias("last_us"),
            F.greatest(F.coalesce(F.max("__gap"), F.lit(0)), F.coalesce(F.max("__edge"), F.lit(0))).alias("longest_pause_us"),
        )
    )
