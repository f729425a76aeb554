"""The whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanfold.llm import bpe
from scanfold.session import spread

MAX_VOCABULARY = 64 << 20  # bytes of a vocabulary file; a larger one isn't broadcast


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's bytes, read once by the driver. Refused beyond ``MAX_VOCABULARY``."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(data)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens. One row for each input row.

    Null and empty texts give the empty list. Strings that look like special tokens are
    ordinary text. Lone surrogates can't occur in Spark's strings. A null id stays null, equal
    rows give equal rows, other columns are not read. A text is never cut, however long.
    """
    data = broadcast_vocabulary(df.sparkSession, vocabulary or bpe.vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.shared_encoder(data.value)
        get, split = enc.words.__getitem__, enc.split
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [[] if not t else list(chain.from_iterable(map(get, split(t)))) for t in texts]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["__id", "ids"])

    src = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"__id {kind}, ids array<int>").withColumnRenamed("__id", id_col)
