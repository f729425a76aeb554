"""Reading level by a familiar-word formula.

Two figures describe a document's prose: the share of its words outside a list of familiar
words, and the length of its sentences. The list is the corpus' own: the words that occur
in the most documents. The level is the one whose weighted sum of the two figures is
highest; the weights are fitted on gradings. The text is read once; what the second pass
needs, each document's distinct words with their counts, is written to the shared folder.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.llm import prose
from scanfold.session import small, spread, written

MIN_SENTENCES = 3
FAMILIAR_WORDS = 200
MAX_LABELLED = 20_000  # documents that the weights are fitted on, chosen by a hash of the id
LEVELS = (1, 2, 3, 4)


def profile(df: DataFrame, doc_id: str, text: str, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(doc_id, sentences, words, mean_log_length, vocabulary, counts) of each document with enough English prose.

    Null, empty and blank texts, and texts of other languages, have no row. Whole texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0), []
            for k, t in enumerate(b.column(1).to_pylist()):
                found = prose.sentences(t)
                if len(found) >= min_sentences:
                    bag = Counter(chain.from_iterable(found))
                    rows.append((k, len(found), sum(map(len, found)), sum(math.log(len(s)) for s in found) / len(found), list(bag), list(bag.values())))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], ["__id", "sentences", "words", "mean_log_length", "vocabulary", "counts"])

    src = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where(F.col("__t").rlike(r"[A-Za-z]"))
    kind = src.schema["__id"].dataType.simpleString()
    out = spread(src).mapInArrow(run, f"__id {kind}, sentences int, words int, mean_log_length double, vocabulary array<string>, counts array<int>")
    return out.withColumnRenamed("__id", doc_id)


def familiar_words(profiles: DataFrame, size: int = FAMILIAR_WORDS) -> list[str]:
    """The ``size`` words found in the most documents, ties in order of the alphabet."""
    df = profiles.select(F.explode("vocabulary").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r[0] for r in df.orderBy(F.desc("n"), "w").limit(size).collect()]


def features(profiles: DataFrame, doc_id: str, familiar: list[str]) -> DataFrame:
    """(doc_id, sentences, unfamiliar, mean_log_length)."""
    strange = F.zip_with("vocabulary", "counts", lambda w, c: F.when(w.isin(familiar) if familiar else F.lit(False), 0).otherwise(c))
    return profiles.select(doc_id, "sentences", (F.aggregate(strange, F.lit(0), lambda a, x: a + x) / F.col("words")).alias("unfamiliar"), "mean_log_length")


def labelled(feats: DataFrame, labels: DataFrame, doc_id: str, level: str, most: int = MAX_LABELLED) -> np.ndarray:
    """Rows (unfamiliar, mean_log_length, level) to fit on: a graded document's median level.

    Repeated gradings count once. At most ``most`` documents, in the order of a hash of their id.
    """
    one = labels.where(F.col(level).isin(*LEVELS) & F.col(doc_id).isNotNull()).dropDuplicates().groupBy(doc_id).agg(F.percentile(level, 0.5).alias("__level"))
    rows = feats.join(small(one), doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(most).select("unfamiliar", "mean_log_length", "__level").collect()
    return np.array([tuple(r) for r in rows], dtype=float).reshape(-1, 3)


def fit(rows: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray | None:
    """Weights (level, [constant, unfamiliar, mean_log_length]) of a softmax; None without rows.

    A median between two levels counts half for each. Levels nobody graded get no document.
    """
    if not len(rows):
        return None
    x = rows[:, :2]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    y = np.zeros((len(x), len(LEVELS)))
    for k, level in enumerate(LEVELS):
        y[:, k] = np.clip(1 - np.abs(rows[:, 2] - level), 0, 1)
    y /= y.sum(1, keepdims=True)
    w = np.zeros((len(LEVELS), 3))
    # Newton steps on the block diagonal: few classes, three weights each
    for _ in range(steps):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(len(LEVELS)):
            g = z.T @ (p[:, k] - y[:, k]) + ridge * len(x) * w[k]
            h = (z * (p[:, k] * (1 - p[:, k]))[:, None]).T @ z + (ridge * len(x) + 1e-6) * np.eye(3)
            w[k] -= rate * np.linalg.solve(h, g)
    w[~(y.sum(0) > 0), 0] = -1e9
    out = w.copy()
    out[:, 1:] /= scale
    out[:, 0] -= (w[:, 1:] * mean / scale).sum(1)
    return out


def assign(feats: DataFrame, doc_id: str, weights: np.ndarray) -> DataFrame:
    """(doc_id, level): the level of the highest sum, the lower one among equals."""
    sums = F.array(*[F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("unfamiliar") + F.lit(float(w[2])) * F.col("mean_log_length") for w in weights])
    return feats.select(doc_id, F.element_at(F.array(*map(F.lit, LEVELS)), F.array_position(sums, F.array_max(sums)).cast("int")).alias("level"))


def reading_levels(df: DataFrame, labels: DataFrame, doc_id: str, text: str, level: str) -> DataFrame:
    """(doc_id, level) of each document with at least ``MIN_SENTENCES`` sentences of English prose.

    Without a usable grading nothing can be told and the result is empty.
    """
    profiles = written(profile(df, doc_id, text), "profiles")
    feats = features(profiles, doc_id, familiar_words(profiles))
    weights = fit(labelled(feats, labels.select(doc_id, level, *[c for c in labels.columns if c not in (doc_id, level)]), doc_id, level))
    if weights is None:
        return feats.where(F.lit(False)).select(doc_id, F.lit(0).alias("level"))
    return assign(feats, doc_id, weights)
