"""Splitting oversized texts at natural boundaries (problem 5).

Small tokens are code points divided by four, rounded down.  The places where a text may be cut are its
paragraph, line, sentence and word boundaries, plus hard cuts only where a stretch without any boundary is
longer than a piece may be.  By *pointer doubling* every place is joined to its farthest legal successor, the
overlap included: a piece that follows place e starts ``overlap`` tokens before e and may reach
``max_tokens`` from there.  The successor table is then squared again and again; the set of reached places
doubles its path length each time, so all cuts of a text with n places come out after log2(n) vector steps.

The same doubling without overlap names the weakest boundary a text needs: over the places of one kind and the
stronger ones, the farthest successor of a place is the last one that leaves a legal trimmed part, and the first
kind whose doubling comes to the end of the text is enough.

Which successor is farthest legal: of the strongest kind of boundary in the later half of the reach, the
farthest one; else of the strongest kind anywhere in reach; else the hard cut.

Defined cases: texts of at most ``max_tokens`` and null texts are no cases and give no rows; blank oversized
texts are split like others; repeated rows of one id count once; ties do not occur (places are distinct); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, LINE, SENTENCE, WORD = re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+")
KINDS = (("paragraph", PARAGRAPH), ("line", LINE), ("sentence", SENTENCE), ("word", WORD))


def tokens(n: int) -> int:
    return n // 4


def places(text: str, first: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut places and their kinds (0 strongest, 4 hard); the text's end is of kind 0."""
    kind: dict[int, int] = {}
    for k in range(3, -1, -1):
        for m in KINDS[k][1].finditer(text):
            kind[m.end()] = k
    n = len(text)
    kind.pop(0, None)
    kind[n] = 0
    at = np.array(sorted(kind), np.int64)
    hard = []
    before = np.concatenate(([0], at[:-1]))
    for a, b in zip(before[at - before > step].tolist(), at[at - before > step].tolist()):
        hard.append(np.arange(a + (first if a == 0 else step), b, step, dtype=np.int64))
    if hard:
        extra = np.concatenate(hard)
        kinds = np.concatenate((np.array([kind[x] for x in at.tolist()], np.int8), np.full(len(extra), 4, np.int8)))
        at = np.concatenate((at, extra))
        order = np.argsort(at, kind="stable")
        return at[order], kinds[order]
    return at, np.array([kind[x] for x in at.tolist()], np.int8)


def doubled(table: np.ndarray) -> np.ndarray:
    """Which nodes are reached from node 0 over the successors in ``table``: squared until no path is longer."""
    reached = np.zeros(len(table), bool)
    reached[0] = True
    for _ in range(max(1, int(len(table) - 1).bit_length())):
        reached[table[reached]] = True
        table = table[table]
    return reached


#: Code points that trimming takes away; none above these.
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def weakest_kind(text: str, at: np.ndarray, kinds: np.ndarray, max_tokens: int) -> str:
    """First kind of boundary such that its places and those of the kinds before leave only legal trimmed parts."""
    n = len(text)
    solid = np.flatnonzero(~np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), SPACES))
    if not len(solid):
        return KINDS[0][0]
    for k, (name, _) in enumerate(KINDS):
        node = np.concatenate(([0], at[kinds <= k]))  # the end of the text is of kind 0
        i = np.searchsorted(solid, node)
        begin = np.append(solid, n)[i]  # first solid character from the place on
        end = np.where(i > 0, solid[np.maximum(i, 1) - 1] + 1, 0)  # behind the last one before it
        far = np.searchsorted(end, begin + 4 * max_tokens + 3, side="right") - 1
        if doubled(np.maximum(far, np.arange(len(node))))[-1]:
            return name
    return "none"


def cuts(text: str, max_tokens: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """(weakest boundary needed, (start, end, kind of the end) of every piece), by pointer doubling."""
    reach, back = 4 * max_tokens + 3, 4 * overlap
    step = reach - back
    if step < 1:
        raise ValueError("overlap must be smaller than the limit")
    at, kinds = places(text, reach, step)
    n = len(at)
    node = np.concatenate(([0], at))  # node 0 is the start, node i the place at[i - 1]
    start = np.maximum(node - back, 0)
    limit = start + reach
    far = np.searchsorted(at, limit, side="right")  # node number of the last place in reach
    middle = start + back + (limit - start - back) // 2
    nxt = np.zeros(n + 1, np.int64)
    floor = np.maximum(node, back)  # a piece no longer than the overlap would lie wholly inside the next one
    for half, low in ((True, np.maximum(middle, floor)), (False, floor)):  # the later half of the reach first, then all of it
        for k in range(5):
            own = np.flatnonzero(kinds <= k) if k < 4 else np.arange(n)
            if not len(own):
                continue
            i = np.searchsorted(own, far, side="left") - 1  # last place of the kind whose node number is at most far
            hit = own[np.maximum(i, 0)]
            ok = (i >= 0) & (nxt == 0) & (at[hit] > low) & ((k < 4) | (not half))
            nxt[ok] = hit[ok] + 1
    nxt[n] = n
    if (nxt[:n] <= np.arange(n)).any():  # every place has a later successor, else a cut would be lost
        bad = nxt <= np.arange(n + 1)
        nxt[bad] = np.minimum(np.arange(n + 1)[bad] + 1, n)
    reached = doubled(nxt)
    ends = np.flatnonzero(reached)[1:]
    begins = np.concatenate(([0], np.maximum(at[ends[:-1] - 1] - back, 0)))
    return weakest_kind(text, at, kinds, max_tokens), list(zip(begins.tolist(), at[ends - 1].tolist(), kinds[ends - 1].tolist()))


def split_oversized(df: DataFrame, key: str, text: str, max_tokens: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every oversized text.

    (key, *keep, boundary STRING, piece_no INT, start BIGINT, end BIGINT, cut STRING, piece STRING,
    token_count INT).  ``boundary`` is the weakest kind of boundary the whole text needs, ``cut`` the kind at
    which the piece ends.
    """
    names = [key, *keep]
    big = df.where(F.col(key).isNotNull() & (F.length(text) >= 4 * (max_tokens + 1)))
    big = big.groupBy(F.col(key).alias("k0")).agg(F.min(F.struct(F.col(text), *[F.col(c) for c in keep])).alias("r"))
    big = big.select("k0", F.col("r").getField(text).alias("t"), *[F.col("r").getField(c).alias(f"k{i + 1}") for i, c in enumerate(keep)])
    labels = [*(k for k, _ in KINDS), "hard"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            others = [c for c in pdf.columns if c != "t"]
            for r in pdf.itertuples(index=False):
                t = r.t
                kind, pieces = cuts(t, max_tokens, overlap)
                own = tuple(getattr(r, c) for c in others)
                for i, (a, b, k) in enumerate(pieces):
                    rows.append((*own, kind, i, a, b, labels[k], t[a:b], tokens(b - a)))
            yield pd.DataFrame(rows, columns=[*others, "boundary", "piece_no", "start", "end", "cut", "piece", "token_count"])

    fields = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = big.mapInPandas(run, f"{fields}, boundary string, piece_no int, start bigint, end bigint, cut string, piece string, token_count int")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(names)})
