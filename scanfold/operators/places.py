"""Where matches lie: byte offsets, lines, columns and what is around them, from the parts a text falls into.

A text cut by a pattern is gap, match, gap, match, ..., gap. Running sums over the parts' lengths give every place
in one pass, whatever the number of matches, and a text is dropped before its matches become rows. Only texts that
have a match get here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CONTEXT_BYTES = 50
ROWS = 20_000  # matches handed on at once
PLACES = "match_no int, matched string, byte_offset bigint, end_offset bigint, line int, col int, end_line int, snippet string"


def place(matches: list[str], gaps: list[str], around: int | None = CONTEXT_BYTES) -> Iterator[tuple]:
    """(match_no, matched, byte_offset, end_offset, line, col, end_line, snippet) of each match; lines and columns count from 1, columns in bytes.

    Without ``around`` there are the first four only. The snippet reaches ``around`` bytes to either side, widened to whole characters; `...` stands where it is
    clipped, a line feed is shown as the two characters ``\\n``.
    """
    if around is None:
        at = 0
        for k, (g, m) in enumerate(zip(gaps, matches)):
            at += _size(g)
            yield k, m, at, at + _size(m)
            at += _size(m)
        return
    parts = [x.encode() for pair in zip(gaps, matches) for x in pair]
    parts.append(gaps[len(matches)].encode() if len(gaps) > len(matches) else b"")
    text = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    start, end = ends[:-1:2], ends[1::2]
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    line, end_line = np.searchsorted(breaks, start), np.searchsorted(breaks, end)
    col = start - np.where(line > 0, breaks[line - 1] + 1 if len(breaks) else 0, 0) + 1
    for k, m in enumerate(matches):
        a, b = max(0, int(start[k]) - around), min(len(text), int(end[k]) + around)
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        shown = text[a:b].decode().replace("\n", "\\n")
        yield k, m, int(start[k]), int(end[k]), int(line[k]) + 1, int(col[k]), int(end_line[k]) + 1, ("..." if a else "") + shown + ("..." if b < len(text) else "")


def _size(x: str) -> int:
    return len(x) if x.isascii() else len(x.encode())


def placed(found: DataFrame, matches: str, gaps: str, around: int | None = CONTEXT_BYTES) -> DataFrame:
    """The other columns of ``found``, repeated for each of a row's matches, and the columns of ``PLACES``, the first four without ``around``."""
    keep = [c for c in found.columns if c not in (matches, gaps)]
    n = len(keep)
    fields = StructType.fromDDL(PLACES).fields[: 4 if around is None else None]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()][: len(fields)]
    names = [*keep, *[f.name for f in fields]]

    def made(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        of = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in range(n)], *map(pa.array, zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k in range(len(b)):  # a row may have any number of matches
                new = list(place(b.column(n)[k].as_py(), b.column(n + 1)[k].as_py(), around))
                at += [k] * len(new)
                rows += new
                if len(rows) >= ROWS:
                    yield made(b, at, rows)
                    at, rows = [], []
            if rows:
                yield made(b, at, rows)

    return found.select(*keep, matches, gaps).mapInArrow(run, StructType([*(found.schema[c] for c in keep), *fields]))
