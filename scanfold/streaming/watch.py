"""Streams: watched folders, message alerts that expire, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanfold.rules import Pattern
from scanfold.session import work_dir

FILES = "path string, modificationTime timestamp, length bigint, content binary"
ALERT_TTL_S = 60
MIN_MESSAGE = 20


def watch_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of the files of a folder: (path, ts, text). Files that aren't valid UTF-8 are left out."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return text_files(raw)


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The files of a folder as a table: (path, ts, text)."""
    return text_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder))


def text_files(raw: DataFrame) -> DataFrame:
    t = F.col("content").cast("string")
    return raw.where(F.is_valid_utf8(t)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("ts"), t.alias("text"))


def once_per_content(files: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (path, content) once: an edited file comes again, a touched one doesn't. State is kept as long as the watermark."""
    return files.withColumn("content_hash", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "content_hash"])


def scan_stream(files: DataFrame, patterns: list[Pattern], sink: Callable[[DataFrame, int], None], every: str | None = "2 seconds", name: str = "watch"):
    """Scan each batch of files and hand its findings to ``sink``. Without ``every``, what is there is scanned and the stream ends."""
    from scanfold.operators import scan

    def batch(df: DataFrame, no: int) -> None:
        sink(scan.findings(df.withColumn("file", F.col("path")), patterns, "path", "text", "file"), no)

    w = files.writeStream.option("checkpointLocation", work_dir(files.sparkSession, name)).foreachBatch(batch)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def long_messages(messages: DataFrame, text: str) -> DataFrame:
    """Messages worth scanning: at least 20 characters."""
    return messages.where(F.length(text) >= MIN_MESSAGE)


def latest_alerts(alerts: DataFrame, channel: str, ts: str, now: F.Column, ttl_s: int = ALERT_TTL_S) -> DataFrame:
    """The batch form: each channel's latest alert, if it isn't older than the TTL. Ties go to the larger alert."""
    last = alerts.groupBy(channel).agg(F.max_by("alert", F.struct(ts, "alert")).alias("alert"), F.max(ts).alias(ts))
    return last.where(F.col(ts) >= now - F.make_dt_interval(secs=F.lit(ttl_s)))


def alert_state(alerts: DataFrame, channel: str, ts: str, ttl_s: int = ALERT_TTL_S) -> DataFrame:
    """The stream form: (channel, alert, ts, state), ``new`` when a channel's alert changes and ``expired`` when its time is over.

    One small state per channel; it expires by processing time.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            alert, at = state.get
            state.remove()
            yield pd.DataFrame({"channel": [key[0]], "alert": [alert], "ts": [pd.Timestamp(at, unit="us")], "state": ["expired"]})
            return
        best = state.get if state.exists else None
        for f in frames:
            for a, at in zip(f["alert"], f["ts"]):
                us = int(pd.Timestamp(at).value // 1000)
                if best is None or (us, a) >= (best[1], best[0]):
                    best = (a, us)
        if best is not None:
            state.update(best)
            state.setTimeoutDuration(ttl_s * 1000)
            yield pd.DataFrame({"channel": [key[0]], "alert": [best[0]], "ts": [pd.Timestamp(best[1], unit="us")], "state": ["new"]})

    src = alerts.select(F.col(channel).cast("string").alias("channel"), F.col("alert"), F.col(ts).cast("timestamp_ntz").alias("ts"))
    return src.groupBy("channel").applyInPandasWithState(step, "channel string, alert string, ts timestamp_ntz, state string", "alert string, us long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(start, kind, n): counts by event time; an addition to what a watch does."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    return e.groupBy(F.window(ts, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there, and read its last result.

    In update mode one batch is run: state that expires by processing time would ask for another batch for ever.
    """
    spark = stream.sparkSession
    path = work_dir(spark, name)

    def batch(df: DataFrame, no: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", work_dir(spark, f"{name}-state")).foreachBatch(batch)
    (w.trigger(once=True) if mode == "update" else w.trigger(availableNow=True)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
