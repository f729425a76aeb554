"""Bringing a table's texts to one form, and finding phrases in disguise."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scanfold.llm import canon

BLOCK = 100_000  # phrases sent to the workers at once
MAX_TESTS = 200  # phrases looked for in the JVM


def unplain(text: Column) -> Column:
    """Does the text hold anything but printable ASCII? Only such texts can change."""
    return F.coalesce(text.rlike(r"[^\x20-\x7E]"), F.lit(False))


def one_form(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text): every row's text in its one form. Null stays null, empty stays empty.

    Texts of printable ASCII are their own form and stay in the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = canon.transducer().apply
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([apply(t) for t in b.column(1).to_pylist()], pa.string())], ["__id", "__text"])

    src = df.select(F.col(row_id).alias("__id"), F.col(text).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    changed = src.where(unplain(F.col("__text"))).mapInArrow(run, f"__id {kind}, __text string")
    return src.where(~unplain(F.col("__text"))).unionByName(changed).withColumnsRenamed({"__id": row_id, "__text": text})


def disguised_phrases(df: DataFrame, row_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, block: int = BLOCK) -> DataFrame:
    """(row_id, phrase_id): texts that show a phrase, but don't hold it character for character.

    A phrase counts as shown if its one form is part of the text's one form: case, visible accents and
    word order must agree. Null and blank phrases are never shown. A row that occurs several times gives
    one result. Phrases are sent to the workers in blocks of ``block``, each block against all texts.
    """
    src = df.select(F.col(row_id).alias("__id"), F.col(text).alias("__text"))
    kind, pkind = src.schema["__id"].dataType.simpleString(), phrases.schema[phrase_id].dataType.simpleString()
    pid_type = to_arrow_type(phrases.schema[phrase_id].dataType)
    out = df.sparkSession.createDataFrame([], f"__id {kind}, __pid {pkind}")
    known: list[tuple] = []
    for i, p in phrases.select(phrase_id, phrase).where(F.trim(F.coalesce(phrase, F.lit(""))) != "").toLocalIterator():
        known.append((i, p))
        if len(known) == block:
            out, known = out.unionByName(_shown(src, known, pid_type, pkind)), []
    if known:
        out = out.unionByName(_shown(src, known, pid_type, pkind))
    return out.distinct().withColumnsRenamed({"__id": row_id, "__pid": phrase_id})


def _shown(src: DataFrame, known: list[tuple], pid_type: pa.DataType, pkind: str) -> DataFrame:
    """(__id, __pid) for one block of phrases."""
    apply = canon.transducer().apply
    forms: dict[str, list] = {}
    for i, p in known:
        forms.setdefault(apply(p), []).append((i, p))
    sent = src.sparkSession.sparkContext.broadcast(forms)
    # a text of printable ASCII is its own form: it shows what it doesn't hold only if a phrase has another form
    other = [f for f, of in forms.items() if f.isascii() and any(p != f for _, p in of)]
    wanted = unplain(F.col("__text"))
    if len(other) > MAX_TESTS:
        wanted = F.col("__text").isNotNull()
    for f in other if len(other) <= MAX_TESTS else []:
        wanted = wanted | F.coalesce(F.col("__text").contains(f), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        apply = canon.transducer().apply
        search = ahocorasick.Automaton()
        for form, of in sent.value.items():
            search.add_word(form, of)
        search.make_automaton()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shown = {pid: p for _, of in search.iter(apply(t)) for pid, p in of}
                rows += [(i, pid) for pid, p in shown.items() if p not in t]
            ids, pids = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(pids, pid_type)], ["__id", "__pid"])

    return src.where(wanted).mapInArrow(run, f"__id {src.schema['__id'].dataType.simpleString()}, __pid {pkind}")
