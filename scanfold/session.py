"""Session settings, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_exchange = re.compile(r"(?m)^[ :+-]*(?:\*\(\d+\) )?\w*Exchange\b")  # a node of a plan, not a word in it


_made: list[str] = []  # folders of this process


def get_session(app: str = "scanfold", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SCANFOLD_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", os.environ.get("SCANFOLD_CHECKPOINT_DIR") or own_folder())
        .getOrCreate()
    )


def own_folder() -> str:
    """A temporary folder of this process, for sessions on one machine."""
    root = "file://" + tempfile.mkdtemp(prefix="scanfold-")
    _made.append(root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path for one run's files, under the folder all executors share, deleted when the process ends.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a temporary folder is made, set and used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_scanfold_root", None)
    if not root:
        root = spark._scanfold_root = own_folder()
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def clean() -> None:
    """Delete the folders of this process. Call it when no result of theirs is still to be read."""
    spark = SparkSession.getActiveSession()
    while _made:
        path = _made.pop()
        try:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            elif spark is not None:
                remove(spark, path)
        except Exception:  # the session may be gone; the folder then stays for the cluster to clear
            continue


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else plain.

    The count stops at the bound, so checking a large table costs little. A table
    beyond the bound is joined by whatever shuffle join the planner picks.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """``df`` in enough partitions for all cores, where costly work per row follows.

    Only a plain scan in fewer partitions than there are cores is dealt out anew: such an input is small for the
    cluster, so the shuffle is too. Anything larger, and any plan with a shuffle of its own, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if _exchange.search(plan.toString()):
        return df
    return df.repartition(cores * factor) if plan.execute().getNumPartitions() < cores else df
