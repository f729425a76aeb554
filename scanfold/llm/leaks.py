"""Evaluation passages inside a training corpus.

A leak may be a part of an item with words exchanged, put in or left out here and there, so
what is compared are windows of a passage's size: twelve successive words get a 64-bit
SimHash, in which every word votes with its rarity among the items and a word of no item
doesn't vote. Exchanging every fourth word moves such a fingerprint by about ten bits. The
items' fingerprints are indexed by four blocks of 16 bits, each under every value within
two bits of its own: two fingerprints that differ in at most eleven bits differ by at most
two in one block at least, so four look-ups find every pair within that radius. For each
document and item that such windows propose, the share of the item's three-word shingles
in the document is computed exactly, weighted by rarity; it must reach the least share
that a leak of this item can have. The passages are then read off an alignment of words.

Each document is handled where it lies, in one pass: nothing is shuffled or broadcast. The
items are written to the shared folder in blocks of bounded size, and a worker takes one
block after the other to the documents it holds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scanfold.session import spread, work_dir

WINDOW = 12
STRIDE = 2  # of the items' windows; the corpus' windows start at every word
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
SHINGLE = 3
MIN_PASSAGE = 15
MIN_SHARE = 0.5
GAP_ITEM, GAP_DOC = 1, 2
ITEM_WORDS = 100_000  # words of the items in one block
CHUNK = 200_000  # words of documents searched at once
SLICE = 16_384  # windows looked up at once
CELLS = 1 << 26  # of the table of documents and shingles, at once
MASKS = np.array([sum(1 << k for k in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), n)], np.int64)

_word = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words in lower case; punctuation, line marks and spacing don't count."""
    return _word.findall(text.lower())


def _bits(word: str) -> np.ndarray:
    h = np.frombuffer(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), np.uint8)
    return np.unpackbits(h).astype(np.int16) * 2 - 1


def fingerprints(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The SimHash of every ``WINDOW`` successive word ids; ``table`` has the votes of each id for the 64 bits."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = table[ids]
    two = one[:-1] + one[1:]
    four = two[:-2] + two[2:]
    total = four[:n] + four[4 : n + 4] + four[8 : n + 8]
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count, one list after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Items:
    """A block of items, ready to be searched for."""

    ids: list
    texts: list[str]

    @cached_property
    def words(self) -> list[list[str]]:
        return [words(t) for t in self.texts]

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        known: dict[str, int] = {}
        for ws in self.words:
            for w in ws:
                known.setdefault(w, len(known) + 1)
        return known  # 0 is any word that no item has

    @cached_property
    def coded(self) -> list[np.ndarray]:
        return [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in self.words]

    @cached_property
    def table(self) -> np.ndarray:
        n = Counter(w for ws in self.words for w in set(ws))
        rarity = lambda w: round(16 * math.log(1 + len(self.words) / n[w]))
        return np.stack([np.zeros(64, np.int16), *[_bits(w) * np.int16(rarity(w)) for w in self.vocabulary]])

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct fingerprints, and the items of each: those of number k stand from first[k] to first[k + 1]."""
        fps = [fingerprints(c, self.table)[::STRIDE] for c in self.coded]
        item = np.repeat(np.arange(len(fps)), [len(f) for f in fps])
        fp, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *fps]), return_inverse=True)
        pair = np.unique(which * len(fps) + item)
        return fp, np.searchsorted(pair // max(1, len(fps)), np.arange(len(fp) + 1)), pair % max(1, len(fps))

    @cached_property
    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: where a value's fingerprints start, and the fingerprints' numbers ordered by value."""
        out = []
        for b in range(BLOCKS):
            near = (_block(self.windows[0], b)[:, None] ^ MASKS[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            out.append((np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)), (order // len(MASKS)).astype(np.int32)))
        return out

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles as sorted keys; the shingle at each place of each item; where an item's places start."""
        keys = [self.keys(c) for c in self.coded]
        known, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        return known, at, np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        v = len(self.vocabulary) + 1
        n = max(0, len(ids) - SHINGLE + 1)
        return (ids[:n] * v + ids[1 : n + 1]) * v + ids[2 : n + 2]

    @cached_property
    def places(self) -> list[dict[int, list[int]]]:
        """For each item the places of each of its shingles."""
        _, at, first = self.grams
        out = [defaultdict(list) for _ in self.words]
        for found, a, b in zip(out, first, first[1:]):
            for k, g in enumerate(at[a:b].tolist()):
                found[g].append(k)
        return out

    @cached_property
    def filter(self) -> np.ndarray:
        """A bit for each hash of a shingle, so that most other shingles need no look-up."""
        bits = np.zeros(1 << 22, bool)
        bits[_hash(self.grams[0])] = True
        return bits

    @cached_property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The weight of the shingle at each place, and the least sum that a leak of each item has.

        A leak holds half of the item's words. In its passages no more than one word lies between runs of at
        least three, so a fourth of these words begin a shingle that the document has, but for one where passages overlap.
        """
        known, at, first = self.grams
        item = np.repeat(np.arange(len(self.words)), np.diff(first))
        seen = np.unique(at * max(1, len(self.words)) + item)
        n = np.bincount(seen // max(1, len(self.words)), minlength=len(known))
        weight = np.log1p(len(self.words) / np.maximum(n, 1))[at]
        least = []
        for k, ws in enumerate(self.words):
            need = max(1, int(MIN_SHARE * len(ws)) // (SHINGLE + GAP_ITEM) - 1)
            least.append(np.sort(weight[first[k] : first[k + 1]])[:need].sum() if len(ws) >= MIN_PASSAGE else np.inf)
        return weight, np.array(least)

    def gram_of(self, ids: np.ndarray) -> np.ndarray:
        """For each place the number of its shingle, -1 if no item has it."""
        keys = self.keys(ids)
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.filter[_hash(keys)])
        at = np.minimum(np.searchsorted(self.grams[0], keys[some]), len(self.grams[0]) - 1)
        out[some] = np.where(self.grams[0][at] == keys[some], at, -1)
        return out

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``fp``, number of an item fingerprint) within ``RADIUS`` bits; some come several times."""
        mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, (start, order) in enumerate(self.index):
            key = _block(fp, b)
            n = start[key + 1] - start[key]
            cuts = np.searchsorted(np.cumsum(n), np.arange(CELLS // 16, n.sum(), CELLS // 16))
            for part in np.split(np.arange(len(fp)), cuts):
                right = order[_expand(start[key[part]], n[part])]
                left = np.repeat(part, n[part])
                close = np.flatnonzero(np.bitwise_count(fp[left] ^ self.windows[0][right]) <= RADIUS)
                mine.append(left[close])
                theirs.append(right[close])
        return np.concatenate(mine), np.concatenate(theirs)


def _block(fp: np.ndarray, b: int) -> np.ndarray:
    return ((fp >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def _hash(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def equal_shingles(item: list[str], doc: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(place in the document, places in the item) of equal shingles."""
    starts = defaultdict(list)
    for k in range(len(item) - SHINGLE + 1):
        starts[tuple(item[k : k + SHINGLE])].append(k)
    for j in range(len(doc) - SHINGLE + 1):
        if at := starts.get(tuple(doc[j : j + SHINGLE])):
            yield j, at


def passages(item: list[str], doc: list[str], equal: Iterable[tuple[int, list[int]]] | None = None) -> list[tuple[int, int, int]]:
    """Passages of ``doc`` in the item's order: (first word of the item, end, words that agree).

    Runs of at least three equal words are joined while no more than one word of the item and two of
    the document lie between them. Longest first; no run is in two passages. ``equal`` has the equal
    shingles, if they are known.
    """
    runs: list[tuple[int, int, int]] = []
    open_runs: dict[int, int] = {}  # item position - document position -> end in the document
    for j, at in equal_shingles(item, doc) if equal is None else equal:
        for i in at:
            if open_runs.get(i - j, -1) > j:
                continue
            n = SHINGLE
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            open_runs[i - j] = j + n - SHINGLE + 1
            runs.append((i, j, n))
    ends = defaultdict(list)
    best: list[tuple[int, int]] = []
    for k, (i, j, n) in enumerate(runs):
        total, before = n, -1
        for gap in range(GAP_DOC + 1):
            for q in ends.get(j - gap, ()):
                if 0 <= i - (runs[q][0] + runs[q][2]) <= GAP_ITEM and best[q][0] + n > total:
                    total, before = best[q][0] + n, q
        best.append((total, before))
        ends[j + n].append(k)
    out, used = [], set()
    for k in sorted(range(len(runs)), key=lambda k: -best[k][0]):
        chain, q = [], k
        while q != -1 and q not in used:
            chain.append(q)
            q = best[q][1]
        if q != -1 or not chain:
            continue
        used.update(chain)
        out.append((runs[chain[-1]][0], runs[k][0] + runs[k][2], best[k][0]))
    return out


def is_leak(item: list[str], doc: list[str], equal: Iterable[tuple[int, list[int]]] | None = None) -> bool:
    """Do passages of at least ``MIN_PASSAGE`` words hold at least half of the item's words?"""
    held: set[int] = set()
    for a, b, n in passages(item, doc, equal):
        if n >= MIN_PASSAGE:
            held.update(range(a, b))
    return len(held) >= MIN_SHARE * len(item)


def search(items: Items, docs: list[list[str]]) -> list[tuple[int, int]]:
    """Pairs (document, item), by their places in the lists, of all leaks."""
    get = items.vocabulary.get
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, int(lengths.sum()))
    n = len(ids) - WINDOW + 1
    if n <= 0 or not len(items.windows[0]):
        return []
    doc_of = np.repeat(np.arange(len(docs)), lengths)
    gram = items.gram_of(ids)
    gram[doc_of[: len(gram)] != doc_of[SHINGLE - 1 :]] = -1
    # a window inside a passage lies in one document and holds at least two runs of three words
    held = np.concatenate([[0], np.cumsum(gram >= 0)])
    span = WINDOW - SHINGLE + 1
    keep = np.flatnonzero((doc_of[:n] == doc_of[WINDOW - 1 :]) & (held[span : span + n] - held[:n] >= 2))
    pairs = [np.zeros(0, np.int64)]
    fp, first, of = items.windows
    for a in range(0, len(keep), SLICE):
        at = keep[a : a + SLICE]
        lo, hi = at[0], at[-1] + WINDOW
        if hi - lo <= 4 * len(at) + WINDOW:
            mine = fingerprints(ids[lo:hi], items.table)[at - lo]
        else:  # few windows far apart
            mine = fingerprints(ids[at[:, None] + np.arange(WINDOW)].ravel(), items.table)[::WINDOW]
        once, back = np.unique(mine, return_inverse=True)  # equal windows are looked up once
        left, right = items.near(once)
        order = np.argsort(back, kind="stable")
        begin = np.searchsorted(back[order], np.arange(len(once) + 1))
        many = begin[left + 1] - begin[left]
        met = np.unique(doc_of[at[order[_expand(begin[left], many)]]] * len(fp) + np.repeat(right, many))
        d, f = met // len(fp), met % len(fp)
        pairs.append(np.unique(np.repeat(d, first[f + 1] - first[f]) * len(items.words) + of[_expand(first[f], first[f + 1] - first[f])]))
    pair = np.unique(np.concatenate(pairs))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    out, last, known = [], -1, []
    for d, i in _similar(items, pair // len(items.words), pair % len(items.words), doc_of, gram):
        if d != last:
            last, known = d, [(j, g) for j, g in enumerate(gram[begin[d] : begin[d + 1]].tolist()) if g >= 0]
        at = items.places[i]
        if is_leak(items.words[i], docs[d], [(j, at[g]) for j, g in known if g in at]):
            out.append((d, i))
    return out


def _similar(items: Items, doc: np.ndarray, item: np.ndarray, doc_of: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs whose weighted share of the item's shingles reaches the least that a leak has."""
    known, at, first = items.grams
    weight, least = items.weights
    docs = np.unique(doc)
    step = max(1, CELLS // max(1, len(known)))
    places = np.flatnonzero(gram >= 0)
    for a in range(0, len(docs), step):
        some = docs[a : a + step]
        row = np.searchsorted(some, doc_of[places])
        here = np.flatnonzero(some[np.minimum(row, len(some) - 1)] == doc_of[places])
        has = np.zeros((len(some), len(known)), bool)
        has[row[here], gram[places[here]]] = True
        lo, hi = np.searchsorted(doc, [some[0], some[-1] + 1])
        for b in range(lo, hi, SLICE):
            i, d = item[b : min(hi, b + SLICE)], doc[b : min(hi, b + SLICE)]
            n = first[i + 1] - first[i]
            place = _expand(first[i], n)
            share = np.bincount(np.repeat(np.arange(len(i)), n), weight[place] * has[np.repeat(np.searchsorted(some, d), n), at[place]], len(i))
            for k in np.flatnonzero(share >= least[i] - 1e-9):
                yield int(d[k]), int(i[k])


@lru_cache(maxsize=2)
def _load(path: str, block: int) -> Items:
    """A block of items from the shared folder."""
    filesystem, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    t = pq.read_table(f"{root}/__b={block}", filesystem=filesystem, columns=["__i", "__t"])
    return Items(t.column(0).to_pylist(), t.column(1).to_pylist())


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, block_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id): every document that leaks an item, see ``is_leak``.

    Null and empty texts leak nothing; an item of fewer than ``MIN_PASSAGE`` words can't be leaked. Repeated
    documents or items give one result. Whole texts are searched. Items are dealt by hash into blocks of
    about ``block_words`` words in the shared folder; documents are read and taken apart into words once.
    """
    kind, ikind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    itype = to_arrow_type(items.schema[item_id].dataType)
    src = spread(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where(F.length("__t") >= MIN_PASSAGE))
    wanted = items.select(F.col(item_id).alias("__i"), F.col(item_text).alias("__t")).where(F.col("__t").isNotNull()).dropDuplicates(["__i", "__t"])
    size = wanted.agg(F.sum(F.length("__t"))).first()[0] or 0
    blocks = size // (6 * block_words) + 1
    path = work_dir(docs.sparkSession, "items")
    wanted.repartition(blocks, "__t").withColumn("__b", F.pmod(F.xxhash64("__t"), F.lit(blocks))).write.partitionBy("__b").parquet(path)
    used = [r[0] for r in docs.sparkSession.read.parquet(path).select("__b").distinct().collect()] if size else []  # numbers of blocks
    at_once = CHUNK * min(5, max(1, len(used)))

    def found(ids: list, taken: list[list[str]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for b in used:
            block = _load(path, b)
            pairs = search(block, taken)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in pairs], id_type), pa.array([block.ids[i] for _, i in pairs], itype)], ["__id", "__item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, taken, n, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                taken.append(words(t))
                n += len(taken[-1])
                if n >= at_once:
                    yield from found(ids, taken, id_type)
                    ids, taken, n = [], [], 0
        if ids:
            yield from found(ids, taken, id_type)

    out = src.mapInArrow(run, f"__id {kind}, __item {ikind}")
    return out.distinct().withColumnsRenamed({"__id": doc_id, "__item": item_id})
