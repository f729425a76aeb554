"""Has a key been seen before? A log-structured store of sorted runs.

A run is an immutable set of Parquet files of (h, key, first_no), h being a 64-bit hash of the key. It is
cut by the top bits of h into blocks, one folder each, and every block is sorted by h; the fences of a block
(lowest and highest h of each row group) stand in its files' footers. A batch is cut and sorted alike. One task
takes a block of the batch and merges it with the blocks of all runs that lie in its range: a block whose range the
batch doesn't touch is never opened, and of an opened one only the row groups whose fences a hash of the batch
meets are read. So no run is ever moved by a probe, and a small batch reads a small part of a large store. A batch's
new keys become a run of level 0; when a level has ``fanout`` runs they are merged into one of the next level, so
a key is rewritten once per level and the number of runs to probe grows with the logarithm of the keys. A
hash that matches is no answer yet: the full key decides. Nothing is held in memory but the list of runs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.session import remove, work_dir

BLOCK_ROWS = 1 << 20  # keys of one block
GROUP_BYTES = 4 << 20  # of one row group
ROW = "h bigint, key string, first_no bigint"


@dataclass(frozen=True)
class Run:
    level: int
    path: str  # of the folder that holds a folder for each block
    bits: int
    rows: int


def block_of(h: Column, bits: int) -> Column:
    """The number of the block of a hash: its top bits."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


class SeenStore:
    """Keys seen so far, as levelled sorted runs in the shared folder.

    ``hash_bits`` shortens the hash, to measure how often hashes alone would be wrong;
    answers stay right for every value, as hits are verified by full key. ``blocks_read`` and ``groups_read``
    count what probes opened, ``groups_met`` how many row groups the opened blocks have.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, hash_bits: int = 64, block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES):
        self.spark, self.fanout, self.hash_bits, self.block_rows, self.group_bytes = spark, fanout, hash_bits, block_rows, group_bytes
        self.batch_bits = math.ceil(math.log2(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        self.root = work_dir(spark, "seen")
        self.runs: list[Run] = []
        self.blocks_read, self.groups_read, self.groups_met = (spark.sparkContext.accumulator(0) for _ in range(3))

    def _hash(self, key: Column) -> Column:
        """The hash, of which ``hash_bits`` differ from key to key: the top ones."""
        h = F.xxhash64(key)
        return F.shiftleft(F.shiftrightunsigned(h, 64 - self.hash_bits), 64 - self.hash_bits) if self.hash_bits < 64 else h

    def _blocks(self, keys: DataFrame, bits: int) -> DataFrame:
        """``keys`` with ``blk``, a block in a partition."""
        return keys.withColumn("blk", block_of(F.col("h"), bits)).repartitionById(1 << bits, "blk")

    def _write(self, rows: DataFrame, path: str, folders: list[str]) -> None:
        """One file in each folder, sorted by hash. The folders are part of the order, else the writer would sort anew."""
        rows.sortWithinPartitions(*folders, "h").write.option("parquet.block.size", self.group_bytes).partitionBy(*folders).parquet(path)

    def _bits(self, rows: int) -> int:
        return max(self.batch_bits, math.ceil(math.log2(max(1, rows / self.block_rows))))

    def _run(self, keys: DataFrame, level: int, bits: int, rows: int) -> Run:
        path = f"{self.root}/l{level}-{uuid.uuid4().hex}"
        self._write(self._blocks(keys, bits), path, ["blk"])
        return Run(level, path, bits, rows)

    def load(self, keys: DataFrame) -> None:
        """Add known keys (column ``key``) as one run below all batches. Null keys are left out."""
        known = keys.where(F.col("key").isNotNull()).select("key").distinct()
        n = known.count()
        if n:
            level = max(1, math.ceil(math.log(max(1, n / self.block_rows), self.fanout)))
            self.runs.append(self._run(known.select(self._hash(F.col("key")).alias("h"), "key", F.lit(None).cast("long").alias("first_no")), level, self._bits(n), n))

    def probe(self, batch: DataFrame) -> DataFrame:
        """The batch's rows (h, key, first_no), keys unique, with ``hash_hit``, ``full_hit`` and ``blk``."""
        runs, read, groups, met = list(self.runs), self.blocks_read, self.groups_read, self.groups_met

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers = [_Reader(r) for r in runs]
            for b in batches:
                h, keys = b.column(0).to_numpy(), b.column(1)
                hash_hit, full_hit = np.zeros(len(h), bool), np.zeros(len(h), bool)
                for r in readers:
                    for theirs, names in r.near(h):
                        _merge(h, keys, theirs, names, hash_hit, full_hit)
                yield pa.RecordBatch.from_arrays([b.column(0), keys, b.column(2), pa.array(hash_hit), pa.array(full_hit), b.column(3)], ["h", "key", "first_no", "hash_hit", "full_hit", "blk"])
            for r in readers:
                read.add(r.blocks)
                groups.add(r.groups)
                met.add(r.all_groups)

        return self._blocks(batch, self.batch_bits).sortWithinPartitions("h").select("h", "key", "first_no", "blk").mapInArrow(run, f"{ROW}, hash_hit boolean, full_hit boolean, blk int")

    def observe(self, batch: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """Answer a batch (``no`` unique and rising, ``key`` a string) and remember its keys.

        Returns the rows seen before, by ``no``, and counts. A key's first row of the batch
        is found by a partial aggregate, then only one row per key is probed, so one very
        frequent key is no hot spot. What is probed is written once: the keys not met are the new run as they
        lie. Rows with a null key are never seen; a repeated ``no`` counts once.
        """
        valid = batch.where(F.col("key").isNotNull() & F.col("no").isNotNull()).select("no", "key")
        firsts = valid.groupBy("key").agg(F.min("no").alias("first_no")).select(self._hash(F.col("key")).alias("h"), "key", "first_no")
        path = f"{self.root}/l0-{uuid.uuid4().hex}"
        self._write(self.probe(firsts), path, ["full_hit", "blk"])
        probed = self.spark.read.schema(f"{ROW}, hash_hit boolean, full_hit boolean, blk int").parquet(path)
        n = probed.agg(F.count("*"), F.count_if("full_hit"), F.count_if(F.col("hash_hit") & ~F.col("full_hit"))).first()
        new = probed.where(~F.col("full_hit")).select(F.col("first_no").alias("no"), F.lit(1).alias("new"))
        # every row but the first one of a new key was seen
        seen = valid.select("no", F.lit(0).alias("new")).unionByName(new).groupBy("no").agg(F.max("new").alias("new")).where("new = 0").select("no")
        answers = f"{self.root}/answers-{uuid.uuid4().hex}"
        seen.write.parquet(answers)
        if n[0] > n[1]:
            self.runs.append(Run(0, f"{path}/full_hit=false", self.batch_bits, n[0] - n[1]))
            self._compact(0)
        else:
            remove(self.spark, path)
        return self.spark.read.schema("no long").parquet(answers), {"keys": n[0], "key_hits": n[1], "hash_only_hits": n[2]}

    def _compact(self, level: int) -> None:
        full = [r for r in self.runs if r.level == level]
        if len(full) < self.fanout:
            return
        rows = sum(r.rows for r in full)
        merged = self.spark.read.schema(ROW).parquet(*[f"{r.path}/blk=*" for r in full])
        run = self._run(merged, level + 1, self._bits(rows), rows)
        self.runs = [*(r for r in self.runs if r.level != level), run]
        for r in full:
            remove(self.spark, r.path)
        self._compact(level + 1)

    def close(self) -> None:
        """Delete the runs. Answers given stay."""
        for r in self.runs:
            remove(self.spark, r.path)
        self.runs = []


def _merge(h: np.ndarray, keys: pa.Array, theirs: np.ndarray, names: pa.Array, hash_hit: np.ndarray, full_hit: np.ndarray) -> None:
    """Mark where sorted hashes meet, and where the keys agree too; several keys may share a hash on either side."""
    lo, hi = np.searchsorted(theirs, h, "left"), np.searchsorted(theirs, h, "right")
    hash_hit |= hi > lo
    step = 0
    while len(at := np.flatnonzero(hi - lo > step)):
        same = pc.equal(keys.take(pa.array(at)), names.take(pa.array(lo[at] + step))).to_numpy(zero_copy_only=False)
        full_hit[at[same]] = True
        step += 1


class _Reader:
    """The blocks of a run that a task meets. Hashes come in order, so few row groups are held at a time."""

    def __init__(self, run: Run) -> None:
        self.run = run
        self.fs, self.root = fs.FileSystem.from_uri(run.path) if ":" in run.path.split("/")[0] else (fs.LocalFileSystem(), run.path)
        self.files: dict[int, list[tuple[pq.ParquetFile, np.ndarray, np.ndarray]]] = {}
        self.held: dict[tuple, tuple[np.ndarray, pa.Array]] = {}
        self.blocks = self.groups = self.all_groups = 0

    def _open(self, block: int) -> list[tuple[pq.ParquetFile, np.ndarray, np.ndarray]]:
        """The files of a block with their fences: lowest and highest hash of each row group."""
        if block not in self.files:
            self.files = {k: v for k, v in self.files.items() if k == block - 1}
            found = [i.path for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/blk={block}", allow_not_found=True)) if i.path.endswith(".parquet")]
            out = []
            for path in sorted(found):
                f = pq.ParquetFile(self.fs.open_input_file(path))
                marks = [f.metadata.row_group(k).column(0).statistics for k in range(f.metadata.num_row_groups)]
                out.append((f, np.array([m.min for m in marks], np.int64), np.array([m.max for m in marks], np.int64)))
                self.all_groups += len(marks)
            self.blocks += bool(found)
            self.files[block] = out
        return self.files[block]

    def near(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(hashes, keys) of each row group that a hash of the batch lies in; both are sorted by hash."""
        bits = self.run.bits
        blocks = np.unique(h.view(np.uint64) >> np.uint64(64 - bits)) if bits else [0]
        before, self.held = self.held, {}
        for block in map(int, blocks):
            for n, (f, lo, hi) in enumerate(self._open(block)):
                for k in np.flatnonzero(np.searchsorted(h, hi, "right") > np.searchsorted(h, lo, "left")):
                    got = before.get((block, n, k))
                    if got is None:
                        t = f.read_row_group(int(k), columns=["h", "key"])
                        got = t.column(0).combine_chunks().to_numpy(), t.column(1).combine_chunks()
                        self.groups += 1
                    self.held[block, n, k] = got
                    yield got


def split_by_arrival(df: DataFrame, no: str, batches: int) -> list[DataFrame]:
    """``df`` cut into ranges of ``no`` of about equal size; together they hold every row.

    Rows with a null ``no`` have no place in the order and are in no batch.
    """
    cuts = df.approxQuantile(no, [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    lows, highs = [None, *cuts], [*cuts, None]
    out = []
    for lo, hi in zip(lows, highs):
        cond = F.col(no).isNotNull()
        if lo is not None:
            cond &= F.col(no) > lo
        if hi is not None:
            cond &= F.col(no) <= hi
        out.append(df.where(cond))
    return out
