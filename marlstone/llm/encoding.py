"""Encoding with a public byte-level BPE vocabulary (problem 7).

Every pre-token is merged by a *hierarchical-bitmap rank queue*: one bucket per merge rank holds the
linked-list positions whose pair has that rank; three levels of 64-bit words say which buckets are in use,
so the next rank is found by three find-first-set steps, whatever the length of the pre-token.  Positions
whose pair has changed meanwhile are stale and skipped when popped.  A merge touches two neighbours only, so
a pre-token of n bytes costs O(n log n) at worst, not O(n^2).

Text is first cut where a space is followed by a non-space, which is always a pre-token boundary of the
vocabulary's pattern; ids of the resulting words are memoised per worker in a dictionary of bounded size.

Defined cases: null text gives null ids, empty text an empty list, blank text is encoded like any other,
repeated rows of one doc_id with the same text give one row of ids (counts keep them), an empty table gives no
rows.  Strings that look like special tokens are ordinary text.  Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Place of the vocabulary; a parameter of every operator here.  Read on the driver and broadcast (0.8 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The pre-token pattern that belongs to the vocabulary (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of a worker's memo before it is emptied; words longer than MEMO_CHARS are never kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64


class RankQueue:
    """Priority queue over ranks below 2**18: bucket per rank, three levels of 64-bit words."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.top, self.mid, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank in use and its leftmost position; None when empty."""
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        mid = self.mid[block]
        word = (block << 6) + (mid & -mid).bit_length() - 1
        low = self.low[word]
        bit = low & -low
        rank = (word << 6) + bit.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] = low ^ bit
            if low == bit:
                self.mid[block] = mid = mid ^ 1 << (word & 63)
                if not mid:
                    self.top = top ^ 1 << block
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next symbol; n ends the list
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the pair that starts here; -1: none, or swallowed
    queue = RankQueue()
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2], -1)
        if r >= 0:
            pair[i] = r
            queue.push(r, i)
    while (head := queue.pop()) is not None:
        rank, i = head
        if pair[i] != rank:
            continue  # stale
        j = after[i]  # swallowed by i
        k = after[j]
        after[i], pair[j] = k, -1
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]], -1)
        else:
            r = -1
        pair[i] = r
        if r >= 0:
            queue.push(r, i)
        h = before[i]
        if h >= 0:
            r = get(piece[h:k], -1)
            if r != pair[h]:
                pair[h] = r
                if r >= 0:
                    queue.push(r, h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encoder of one worker: the vocabulary and its memo."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.find = regex.compile(PRE_TOKEN).findall
        self.pretokens: dict[str, list[int]] = {}
        self.first: dict[str, list[int]] = {}  # word at the start of a text
        self.later: dict[str, list[int]] = {}  # word after one space

    def words(self, text: str) -> list[int]:
        """Ids of a stretch of text, pre-token by pre-token."""
        out: list[int] = []
        known = self.pretokens
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) <= MEMO_CHARS:
                    if len(known) >= MEMO_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def _memo(self, memo: dict[str, list[int]], key: str, text: str) -> list[int]:
        ids = self.words(text)
        if len(key) <= MEMO_CHARS:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[key] = ids
        return ids

    def pieces(self, text: str) -> list[list[int]]:
        """Ids of a text, in runs."""
        if UNEVEN(text):
            return self._spaced(text)
        head, *parts = text.split(" ")
        out = list(map(self.later.get, parts))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._memo(self.later, parts[i], " " + parts[i])
        if head:
            out.insert(0, self._piece(head, None, None))
        return out

    def _spaced(self, text: str) -> list[list[int]]:
        """As ``pieces`` for texts with runs of white space: a cut only before a single space and a non-space."""
        out, start, get, later = [], 0, self.later.get, self.later
        for m in CUT.finditer(text):
            at = m.start()
            if at > start:
                out.append(self._piece(text[start:at], get, later))
            start = at
        out.append(self._piece(text[start:], get, later))
        return out

    def _piece(self, s: str, get, later) -> list[int]:
        if s[0] == " " and len(s) > 1:
            ids = get(s[1:])
            return ids if ids is not None else self._memo(later, s[1:], s)
        return self.first.get(s) or self._memo(self.first, s, s)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text))) if text else []


CUT = regex.compile(r" (?=\S)")
#: A space that no word follows at once.
UNEVEN = re.compile(r" (?:\s|\Z)").search

_ENCODERS: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def share_vocabulary(df: DataFrame, vocabulary: str = VOCABULARY):
    """Broadcast the vocabulary file; its size does not depend on the data."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of every distinct row; see the module for the defined cases."""
    shared = share_vocabulary(df, vocabulary)
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "k").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values, offsets, valid = [], np.zeros(len(texts) + 1, np.int32), np.ones(len(texts), bool)
            at = 0
            for i, t in enumerate(texts):
                if t is None:
                    valid[i] = False
                elif t:
                    ids = list(chain.from_iterable(enc.pieces(t)))
                    at += len(ids)
                    values.append(np.array(ids, np.int32))
                offsets[i + 1] = at
            flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(~valid))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens BIGINT) of every row with a non-null text, by the same encoder without making the ids."""
    shared = share_vocabulary(df, vocabulary)
    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for batch in batches:
            sizes = [sum(map(len, enc.pieces(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["k", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)
