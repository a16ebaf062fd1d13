"""Hashed term vectors and their dot products.

A text's words are cut in the JVM and counted inside its row, so no word is shuffled; only distinct words are hashed.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import words
from .topk import RunningTop

#: Numbers of a block of products.
BLOCK = 1 << 23


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): how often each text holds each word; rows are texts, each key once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [Counter(ws) for ws in pdf["ws"]]
            size = np.array([len(c) for c in seen], np.int64)
            yield pd.DataFrame({"k": np.repeat(pdf["k"].to_numpy(), size), "word": [w for c in seen for w in c], "n": [n for c in seen for n in c.values()]})

    rows = df.select(F.col(key).alias("k"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    return rows.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, word string, n bigint").withColumnRenamed("k", key)


def packed_vectors(df: DataFrame, key: str, text: str, buckets: int = 100_000) -> DataFrame:
    """(key, total, idx ARRAY<BIGINT>, n ARRAY<BIGINT>): ascending buckets and their counts; null texts give no rows, each key once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for pdf in batches:
            if len(memo) > 500_000:
                memo.clear()
            total, idx, counts = [], [], []
            for ws in pdf["ws"]:
                held: dict[int, int] = {}
                for w, n in Counter(ws).items():
                    b = memo.get(w)
                    if b is None:
                        b = memo[w] = int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % buckets
                    held[b] = held.get(b, 0) + n
                order = sorted(held)
                total.append(len(ws))
                idx.append(order)
                counts.append([held[b] for b in order])
            yield pd.DataFrame({"k": pdf["k"], "total": total, "idx": idx, "n": counts})

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), words(F.col(text)).alias("ws"))
    return rows.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, total bigint, idx array<bigint>, n array<bigint>").withColumnRenamed("k", key)


def sparse_vectors(df: DataFrame, key: str, text: str, buckets: int = 100_000) -> DataFrame:
    """(key, idx, n, total): bucket counts and the number of words.  A text without words has the one row (0, 0, 0).

    Counts stay whole numbers, so sums do not depend on their order; a weight is n / total.
    """
    one = F.when(F.size("idx") > 0, F.arrays_zip("idx", "n")).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("n"))))
    return packed_vectors(df, key, text, buckets).select(key, "total", F.inline(one)).select(key, "idx", "n", "total")


def sparse_topk(queries: DataFrame, points: DataFrame, qid: str, pid: str, k: int, *, skip_self: bool = False, block_bytes: int = DEFAULTS.broadcast_bytes) -> DataFrame:
    """(qid, pid, score in millionths, rank) of the k best points of every query that share a bucket with it; ties go to the lesser point.

    Both sides are :func:`packed_vectors`.  The queries are sent out in blocks of at most ``block_bytes``; every task scores its
    points against a block and gives at most ``k`` candidates per query.  Texts without words take no part.
    """
    spark = queries.sparkSession
    q = queries.where("total > 0").select(F.col(qid).alias("q"), "total", "idx", "n")
    numbers = q.agg(F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(numbers * 16 / block_bytes))
    p = points.where("total > 0").select(F.col(pid).alias("p"), "total", "idx", "n")
    kinds = f"q {queries.schema[qid].dataType.simpleString()}, p {points.schema[pid].dataType.simpleString()}, score bigint"
    out = None
    for b in range(blocks):
        own = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).orderBy("q").toPandas()
        shared = spark.sparkContext.broadcast(_columns(own))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, totals, terms, first, row, count = shared.value
            top = RunningTop(len(ids), k)
            step = max(1, BLOCK // max(1, len(ids)))
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                size = pdf["idx"].map(len).to_numpy()
                who = np.repeat(np.arange(len(pdf)), size)
                term, n = np.concatenate(pdf["idx"].to_list()), np.concatenate(pdf["n"].to_list())
                at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
                hit = np.flatnonzero(terms[at] == term)
                who, at, n = who[hit], at[hit], n[hit]
                for lo in range(0, len(pdf), step):
                    a, z = np.searchsorted(who, (lo, lo + step))
                    m = min(step, len(pdf) - lo)
                    times = first[at[a:z] + 1] - first[at[a:z]]  # queries that hold the term
                    own = np.repeat(np.arange(a, z), times)
                    spot = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + first[at[own]]
                    dot = np.bincount(row[spot] * m + who[own] - lo, weights=count[spot] * n[own], minlength=len(ids) * m).reshape(len(ids), m)
                    points = pdf["p"].to_numpy()[lo : lo + m]
                    s = np.floor(dot / (totals[:, None] * pdf["total"].to_numpy()[None, lo : lo + m]) * 1e6 + 0.5).astype(np.int64)
                    ok = dot > 0
                    top.add(s, points, ok & (ids[:, None] != points[None, :]) if skip_self else ok)
            r, point, score = top.rows()
            yield pd.DataFrame({"q": ids[r], "p": point, "score": score})

        found = p.mapInPandas(search, kinds)
        out = found if out is None else out.unionByName(found)
    best = top_k(out, "q", k, F.desc("score"), "p")
    return best.select(F.col("q").alias(qid), F.col("p").alias(pid), "score", "rank")


def _columns(own: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Query ids, their totals, distinct terms, and by term the queries that hold it with their counts."""
    if not len(own):
        return np.array([]), np.array([]), np.array([], np.int64), np.zeros(1, np.int64), np.array([], np.int64), np.array([], np.int64)
    row = np.repeat(np.arange(len(own)), own["idx"].map(len).to_numpy())
    term, count = np.concatenate(own["idx"].to_list()).astype(np.int64), np.concatenate(own["n"].to_list()).astype(np.int64)
    order = np.argsort(term, kind="stable")
    terms, first = np.unique(term[order], return_index=True)
    return own["q"].to_numpy(), own["total"].to_numpy().astype(np.float64), terms, np.append(first, len(term)), row[order], count[order]


def top_k(scores: DataFrame, qid: str, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of every query; Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(qid).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
