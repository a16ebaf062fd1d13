"""Near-duplicate records with small edits (problem 4), by covering locality-sensitive hashing.

A record is the set of its runs of SHINGLE words; two records are near-duplicates if the Jaccard similarity of
their sets is at least the threshold.  Each set gets a sketch of GROUPS x POINTS minhash symbols, in which two sets
agree at each place with probability equal to their similarity, so similarity becomes Hamming distance.

*Covering masks.*  The places are the points of a transversal design: mask (x, y) picks from group g the point
x + g*y mod POINTS (POINTS prime, y below CLASSES).  Two masks share at most one place, and the masks of one y
are disjoint and cover every place.  A differing place spoils exactly one mask of each y, so whatever places
differ, as long as they are fewer than POINTS, some mask is untouched: every pair of sketches within the radius
POINTS - 1 collides in some table, guaranteed.  Pairs farther apart collide with a probability that falls with
their distance (figures of a simulation of this design are in the README).

Candidates are then compared sketch by sketch (all places): those that agree at DEVIATIONS standard deviations fewer
places than pairs at the threshold do (one such pair in a thousand million) are dropped, and what is left is compared
by the exact sets, so no wrong pair comes out.  Records with equal sets form one class, whose representative alone is hashed and joined; a hot
group of copies costs one row.  The join on (table, key) is an equi-join that Spark splits when a key is hot;
nothing is capped.

Defined cases: null keys and texts and texts with fewer than ``least_words`` words take no part; repeated rows of
one key count once (the one with the least set, should they differ); equal sets under different keys are near-duplicates of similarity 1; very long texts are read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import spread

GROUPS, POINTS, CLASSES = 5, 13, 8
SHINGLE, LEAST_WORDS = 3, 50
DEVIATIONS = 6
WORDS = re.compile(r"[^\W_]+")

_MULTIPLIERS = np.random.default_rng(20240501).integers(1 << 62, size=GROUPS * POINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = np.random.default_rng(20240502).integers(1 << 62, size=GROUPS * POINTS, dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_WORDS: dict[str, int] = {}


def masks() -> list[list[int]]:
    """Places of every table's mask."""
    return [[g * POINTS + (x + g * y) % POINTS for g in range(GROUPS)] for y in range(CLASSES) for x in range(POINTS)]


def shingles(text: str, n: int = SHINGLE, least_words: int = LEAST_WORDS) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; None for short texts."""
    words = WORDS.findall(text.lower())
    if len(words) < max(least_words, n):
        return None
    memo = _WORDS
    if len(memo) > 500_000:
        memo.clear()
    ids = list(map(memo.get, words))
    if None in ids:
        for i, w in enumerate(ids):
            if w is None:
                ids[i] = memo[words[i]] = xxhash.xxh64_intdigest(words[i])
    h = np.array(ids, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (h[k : len(h) - n + 1 + k] * _MIX[k % 3])) * _MIX[(k + 1) % 3]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    d = xxhash.xxh128_intdigest(hashes.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """32-bit minhash symbols of a set."""
    out = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _MULTIPLIERS + _ADDENDS
        out = np.minimum(out, (part ^ (part >> np.uint64(31))).min(axis=0))
    return (out >> np.uint64(20)).astype(np.uint32).view(np.int32)


def _features(df: DataFrame, key: str, text: str, n: int, least_words: int) -> DataFrame:
    """(k, size, set1, set2, sketch) of every key that takes part."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if (s := shingles(t, n, least_words)) is not None:
                    out.append((k, len(s), *digest(s), sketch(s)))
            yield pd.DataFrame(out, columns=["k", "size", "set1", "set2", "sketch"])

    kind = df.schema[key].dataType.simpleString()
    found = spread(rows, "k").mapInPandas(run, f"k {kind}, size int, set1 bigint, set2 bigint, sketch array<int>")
    return found.groupBy("k").agg(F.min(F.struct("size", "set1", "set2", "sketch")).alias("f")).select("k", "f.*")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.7, *, n: int = SHINGLE, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(links, members).

    members (k, rep): every key that takes part and the representative of its class of equal sets (the least key).
    links (a, b, similarity): pairs of representatives, a < b, whose exact similarity is at least ``threshold``.
    """
    # numbers of the written rows stand for the keys until the end: short whatever the keys are, and unique
    features = cut_lineage(_features(df, key, text, n, least_words).withColumn("id", F.monotonically_increasing_id()))
    classes = features.groupBy("set1", "set2", "size").agg(F.min("k").alias("rep"))
    members = features.select("k", "set1", "set2", "size").join(classes, ["set1", "set2", "size"]).select("k", "rep")
    reps = cut_lineage(features.join(classes.select(F.col("rep").alias("k")), "k", "left_semi").select("k", "id", "size", "sketch"))

    picks = F.array(*[F.array(*map(F.lit, m)) for m in masks()])
    tables = F.transform(picks, lambda m, i: F.xxhash64(i, F.transform(m, lambda p: F.get("sketch", p))))
    hashed = reps.select("id", "size", F.explode(tables).alias("key"))
    a, b = hashed.alias("a"), hashed.alias("b")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    near = near.where(F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size"))  # no pair of other sizes can reach it
    near = near.select(F.col("a.id").alias("ia"), F.col("b.id").alias("ib")).distinct()

    places = GROUPS * POINTS
    least = int(threshold * places - DEVIATIONS * (places * threshold * (1 - threshold)) ** 0.5)
    marks = reps.select("id", "sketch")
    near = near.join(marks.toDF("ia", "sa"), "ia").join(marks.toDF("ib", "sb"), "ib")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    near = cut_lineage(near.where(agree >= least).select("ia", "ib"))

    involved = near.select(F.col("ia").alias("id")).union(near.select(F.col("ib").alias("id"))).distinct().join(reps.select("id", "k"), "id")
    kind = df.schema[key].dataType.simpleString()
    texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(involved, "k")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, len(s), *digest(s), s.view(np.int64)) for k, i, t in zip(pdf["k"], pdf["id"], pdf["t"]) if (s := shingles(t, n, least_words)) is not None]
            yield pd.DataFrame(out, columns=["k", "id", "size", "set1", "set2", "s"])

    exact = texts.select("k", "id", "t").mapInPandas(sets, f"k {kind}, id bigint, size int, set1 bigint, set2 bigint, s array<bigint>")
    exact = exact.groupBy("k", "id").agg(F.min(F.struct("size", "set1", "set2", "s")).alias("f")).select("k", "id", "f.s")
    pairs = near.join(exact.toDF("ka", "ia", "xa"), "ia").join(exact.toDF("kb", "ib", "xb"), "ib")
    common = F.size(F.array_intersect("xa", "xb"))
    pairs = pairs.withColumn("similarity", common / (F.size("xa") + F.size("xb") - common)).where(F.col("similarity") >= threshold)
    links = pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity").where("a <> b").distinct()
    return cut_lineage(links), members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of keys, those between the members of linked classes and those inside a class."""
    m1, m2 = members.toDF("ka", "a"), members.toDF("kb", "b")
    between = links.select("a", "b").join(m1, "a").join(m2, "b").select("ka", "kb")
    inside = members.toDF("ka", "r").join(members.toDF("kb", "r"), "r").where("ka < kb").select("ka", "kb")
    return between.unionByName(inside).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def group_ids(links: DataFrame, members: DataFrame) -> DataFrame:
    """(k, group_id, n_links): every key with the least key of its connected group and its number of links.

    Groups are found by alternating hooking to the least neighbour and pointer jumping until nothing changes;
    the labels stay in Spark and each round is cut, so rounds grow with the logarithm of a group's diameter.
    ``n_links`` counts links of the class to other classes plus the other members of the class.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = both.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v"))
    while True:
        near = both.join(label, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("l").alias("n"))
        hooked = label.join(near, "v", "left").select("v", "l", F.least("l", F.coalesce("n", "l")).alias("m"))
        # the root of the old label learns of the smaller label as well
        roots = hooked.groupBy(F.col("l").alias("v")).agg(F.min("m").alias("r"))
        joined = hooked.join(roots, "v", "left").select("v", "l", F.least("m", F.coalesce("r", "m")).alias("m"))
        jump = joined.select(F.col("v").alias("m"), F.col("m").alias("j"))
        joined = cut_lineage(joined.join(jump, "m", "left").select("v", "l", F.least("m", F.coalesce("j", "m")).alias("m")))
        changed = joined.where("m <> l").limit(1).count()
        label = joined.select("v", F.col("m").alias("l"))
        if not changed:
            break
    degree = both.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("d"))
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("s"))
    out = members.join(label.toDF("rep", "l"), "rep", "left").join(degree, "rep", "left").join(size, "rep")
    return out.select("k", F.coalesce("l", "rep").alias("group_id"), (F.coalesce("d", F.lit(0)) + F.col("s") - 1).alias("n_links"))
