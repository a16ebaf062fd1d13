"""Counts that tell whether a stage's output is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNK_TYPES


def missing(c: str) -> Column:
    return F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(f"no_{c}")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row: rows, keys, removed duplicates, missing required fields, mean tokens, rows with references and questions."""
    n = F.count(F.lit(1))
    return chunks.agg(
        n.alias("n_rows"), F.count_distinct("chunk_id").alias("n_ids"), (n - F.count_distinct("chunk_id")).alias("n_duplicates"), *[missing(c) for c in ("content", "embed_text", "doc_title", "section", "source_url")],
        F.floor(F.coalesce(F.sum("token_count"), F.lit(0)) / F.greatest(n, F.lit(1))).cast("bigint").alias("mean_tokens"), F.count_if(F.size("references") > 0).alias("n_with_references"),
        F.count_if(F.size("hyde_questions") > 0).alias("n_with_questions"), F.coalesce(F.sum(F.when(F.col("hyde_questions").isNotNull(), F.size("hyde_questions"))), F.lit(0)).alias("n_questions"),
    )


def counts_by_type(chunks: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(chunk_type, n): all types, those without rows with 0."""
    spark = chunks.sparkSession
    every = spark.createDataFrame([(t,) for t in (types or CHUNK_TYPES)], "chunk_type STRING")
    return every.join(chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n")), "chunk_type", "left").fillna(0, ["n"])


def embedding_report(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: rows, missing vectors, vectors of another length, vectors with null or not finite values, all-zero vectors."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    right = F.size(v) == dim
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"), F.count_if(v.isNotNull() & (F.size(v) != dim)).alias("n_wrong_length"),
        F.count_if(right & bad).alias("n_not_finite"), F.count_if(right & F.forall(v, lambda x: x == 0.0)).alias("n_zero"),
    )


def collisions(df: DataFrame, value: str, key: str) -> DataFrame:
    """(value, n): values that several keys share."""
    return df.groupBy(value).agg(F.count_distinct(key).alias("n")).where("n > 1")


def collection_stats(points: DataFrame) -> DataFrame:
    """One row of health: points, types, documents, and whether the collection is filled."""
    n = F.count(F.lit(1))
    return points.agg(n.alias("points"), F.count_distinct("chunk_type").alias("types"), F.count_distinct("doc_title").alias("documents"), F.when(n > 0, "ok").otherwise("empty").alias("status"))


def question_run_stats(rows: DataFrame, questions: str) -> DataFrame:
    """One row: records with and without questions, and all questions."""
    has = F.coalesce(F.size(questions) > 0, F.lit(False))
    return rows.agg(F.count_if(has).alias("generated"), F.count_if(~has).alias("failed"), F.coalesce(F.sum(F.when(has, F.size(questions))), F.lit(0)).alias("total_questions"))
