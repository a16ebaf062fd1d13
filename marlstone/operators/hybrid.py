"""Weighted fusion of dense and sparse candidates, the confidence fallback and cross-reference expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .sparse import top_k


def fuse(dense: DataFrame, sparse: DataFrame, qid: str, pid: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """(qid, pid, fused, raw, dense_rank, sparse_rank, rank): full outer join on the point.

    ``fused`` is in ten-millionths, a missing side counts 0; ``raw`` is the dense score if there is one, else the
    sparse one.  Ties keep dense order first, then sparse order.
    """
    d = dense.select(qid, pid, F.col("score").alias("ds"), F.col("rank").alias("dense_rank"))
    s = sparse.select(qid, pid, F.col("score").alias("ss"), F.col("rank").alias("sparse_rank"))
    both = d.join(s, [qid, pid], "full")
    fused = F.coalesce("ds", F.lit(0)) * cfg.dense_weight + F.coalesce("ss", F.lit(0)) * cfg.sparse_weight
    both = both.select(qid, pid, fused.alias("fused"), F.coalesce("ds", "ss").alias("raw"), "dense_rank", "sparse_rank")
    return top_k(both, qid, cfg.broad_candidates * 2, F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))


def with_fallback(first: DataFrame, broad: DataFrame, qid: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Rows of ``first``, but of ``broad`` for queries whose best score is low and strictly better there; adds ``branch``."""
    best = lambda df, name: df.groupBy(qid).agg(F.max("fused").alias(name))
    tops = best(first, "t1").join(best(broad, "t2"), qid, "left")
    low = (F.col("t1") < int(cfg.confidence * 10_000_000)) & (F.coalesce("t2", F.lit(-1)) > F.col("t1"))
    choice = tops.select(qid, low.alias("use_broad"))
    a = first.join(choice, qid).where("NOT use_broad").withColumn("branch", F.lit("first"))
    b = broad.join(choice, qid).where("use_broad").withColumn("branch", F.lit("broad"))
    return a.unionByName(b).drop("use_broad")


def expand_references(top: DataFrame, chunks: DataFrame, qid: str, pid: str, per_point: int = 3, limit: int = 5) -> DataFrame:
    """(qid, pid): points whose section is referred to by a top point and that are not there yet, a few per query.

    ``chunks`` has pid, section and references.  Only the first references of every point count.
    """
    refs = top.select(qid, pid).join(chunks.select(pid, F.explode(F.slice("references", 1, per_point)).alias("section")), pid).select(qid, "section").distinct()
    found = refs.join(chunks.select(F.col(pid).alias("new"), "section"), "section").select(qid, F.col("new").alias(pid)).distinct()
    fresh = found.join(top.select(qid, pid), [qid, pid], "left_anti")
    return top_k(fresh, qid, limit, pid).drop("rank")
