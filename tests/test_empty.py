"""Every query over empty tables, and over tables of nulls alone: none fails, and its columns are the usual ones."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

D = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not D.exists(), reason="no test tables here")
FIXED = {"rules", "watch_phrases", "seen_hashes", "eval_items"}  # configuration; null rules are tested elsewhere


def tables(spark, to: Path, nulls: bool) -> str:
    for p in D.glob("*.parquet"):
        t = spark.read.parquet(str(p))
        if p.stem in FIXED and nulls:
            t.write.parquet(str(to / p.name))
        elif nulls:
            t.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema.fields]).write.parquet(str(to / p.name))
        else:
            t.limit(0).write.parquet(str(to / p.name))
    return str(to)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), False)


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("nulls"), True)


NAMES = sorted(n for n in entry.queries() if n[0] == "p" and n[1].isdigit())


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    got = entry.queries()[name](spark, empty)
    assert got.columns and got.count() == (1 if name == "p3_rates" else 0)


@pytest.mark.parametrize("name", NAMES)
def test_nulls(spark, nulls, name):
    got = entry.queries()[name](spark, nulls)
    assert got.columns and got.count() <= 4
