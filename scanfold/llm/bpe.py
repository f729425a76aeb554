"""Byte-level BPE with a public vocabulary, by a contiguous rank array.

A word's parts are a list of boundaries into its bytes; beside it stands, for every part,
the rank that joining it with the next one would have. The least rank is found by scanning
that list, its boundary is deleted, and the two neighbouring ranks are looked up again.
Words are short, so the scan over a few adjacent numbers beats any tree. A word of more
than ``SHORT`` bytes goes through a heap instead, so that a megabyte without a space takes
n log n steps; both give the same parts.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from itertools import chain

import regex

SHORT = 256
CACHED_WORDS, CACHED_CHARS = 400_000, 128  # words that are kept, and how long they may be
NO_RANK = 1 << 60
DEFAULT_DIR = "/opt/tokenizers"

# How the public vocabulary cuts text into words, for all of Unicode and for ASCII alone.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"""


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("SCANFOLD_TOKENIZERS", DEFAULT_DIR), f"{name}.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class _Words(dict):
    """word -> ids; a word not met yet is encoded when asked for, and kept if it is of common length."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = tuple(encode_word(word.encode("utf-8", "replace"), self.ranks))
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _encode_long(word, ranks)
    get = ranks.get
    bound = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == NO_RANK:
            break
        i = rank.index(least)
        del bound[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[bound[i] : bound[i + 2]], NO_RANK)
        if i:
            rank[i - 1] = get(word[bound[i - 1] : bound[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n, get = len(word), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; where the part before starts
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == k):
            continue
        alive[j], end[i] = False, k
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if (p := before[i]) >= 0 and (r := get(word[p:k])) is not None:
            heapq.heappush(heap, (r, p, i, k))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; keeps the ids of words it has met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = _Words(ranks)
        self._any = regex.compile(WORDS).findall
        self._ascii = re.compile(ASCII_WORDS).findall

    def split(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def count(self, text: str) -> int:
        words = self.words
        return sum(len(words[w]) for w in self.split(text))


_made: dict[int, Encoder] = {}


def shared_encoder(data: bytes) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    key = hash(data)
    if key not in _made:
        _made[key] = Encoder(read_ranks(data))
    return _made[key]
