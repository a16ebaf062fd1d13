"""Exact cosine top-k of a stated query set against all points, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .sparse import top_k
from .topk import RunningTop


def dense_topk(queries: DataFrame, points: DataFrame, qid: str, pid: str, vector: str, k: int, *, skip_self: bool = False, block_bytes: int = DEFAULTS.broadcast_bytes) -> DataFrame:
    """(qid, pid, score in millionths, rank); ties go to the lesser point.

    The queries are sent out in blocks of at most ``block_bytes``; every block is compared with all points by matrix
    products, and each task gives at most ``k`` candidates per query, so what is shuffled follows the number of queries and
    tasks, not of pairs.  Null vectors and vectors of length zero take no part.
    """
    spark = queries.sparkSession
    usable = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    q = usable(queries).select(F.col(qid).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, math.ceil(size[1] * 8 / block_bytes))
    p = usable(points).select(F.col(pid).alias("p"), F.col(vector).cast("array<double>").alias("v"))
    kinds = f"q {queries.schema[qid].dataType.simpleString()}, p {points.schema[pid].dataType.simpleString()}, score bigint"
    out = None
    for b in range(blocks):
        own = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).orderBy("q").toPandas()
        if len(own):
            m = np.array(own["v"].tolist(), np.float64)
            norm = np.linalg.norm(m, axis=1)
            own, m = own["q"].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0, None]
        shared = spark.sparkContext.broadcast((own, m) if len(own) else (np.array([]), np.zeros((0, 1))))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            top = RunningTop(len(ids), k)
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                x = np.array(pdf["v"].tolist(), np.float64)
                norm = np.linalg.norm(x, axis=1)
                x, own = x[norm > 0] / norm[norm > 0, None], pdf["p"].to_numpy()[norm > 0]
                s = np.floor((m @ x.T) * 1e6 + 0.5).astype(np.int64)
                top.add(s, own, ids[:, None] != own[None, :] if skip_self else None)
            row, point, score = top.rows()
            yield pd.DataFrame({"q": ids[row], "p": point, "score": score})

        found = p.mapInPandas(search, kinds)
        out = found if out is None else out.unionByName(found)
    best = top_k(out, "q", k, F.desc("score"), "p")
    return best.select(F.col("q").alias(qid), F.col("p").alias(pid), "score", "rank")
