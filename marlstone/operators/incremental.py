"""Work that is done once: what to reuse, what is left to do, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import first_wins


def split_done(todo: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a result, rows without): a left semi and a left anti join on the key."""
    keys = done.select(key).distinct()
    return todo.join(keys, key, "left_semi"), todo.join(keys, key, "left_anti")


def reuse(new: DataFrame, old: DataFrame, key: str, result: str) -> DataFrame:
    """Every new row with the result it had; ``status`` says done or todo.  A null result is no result."""
    kept = old.where(F.col(result).isNotNull()).groupBy(key).agg(F.min(result).alias(result))
    return new.join(kept, key, "left").withColumn("status", F.when(F.col(result).isNotNull(), "done").otherwise("todo"))


def upsert(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The table after the batch: of rows with one key the last by ``order`` stays, the batch before the table in a tie."""
    both = target.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, key, F.desc_nulls_last(order), F.desc("_b")).drop("_b")


#: Types that get no questions.
NO_QUESTIONS = ("section_index", "restricted_doc")


def questions_todo(chunks: DataFrame, questions: str = "hyde_questions", *, force: bool = False, skipped: tuple[str, ...] = NO_QUESTIONS) -> DataFrame:
    """The chunks that questions are still to be made for: no skipped type and, unless forced, none there yet."""
    kept = chunks.where(~F.col("chunk_type").isin(*skipped) | F.col("chunk_type").isNull())
    return kept if force else kept.where(F.coalesce(F.size(questions), F.lit(0)) <= 0)


def scans_todo(images: DataFrame, flag: str = "needs_ocr") -> DataFrame:
    """The pictures still to be read; a missing flag means yes."""
    return images.where(F.coalesce(flag, F.lit(True)))


def scans_done(images: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The pictures with the results of a reading run (key, content, chunk_type, is_decorative, scan_method); those read need no reading again.

    Pictures without a result keep what they had, so a run that was broken off goes on with :func:`scans_todo`.
    """
    new = results.toDF(*[key if c == key else f"_{c}" for c in results.columns]).withColumn("_read", F.lit(True))
    both = images.join(new, key, "left")
    names = {"content": "image_content", "chunk_type": "chunk_type", "is_decorative": "is_decorative", "scan_method": "scan_method"}
    fields = {target: F.when(F.col("_read"), F.col(f"_{c}")).otherwise(F.col(target)) for c, target in names.items()}
    return both.withColumns(fields | {"needs_ocr": F.when(F.col("_read"), False).otherwise(F.coalesce("needs_ocr", F.lit(True)))}).drop("_read", *[f"_{c}" for c in names])


def due_for_refresh(pages: DataFrame, scraped_at: str, today: Column, weeks: int = 13) -> DataFrame:
    """Pages fetched ``weeks`` weeks ago or earlier, or never."""
    return pages.where(F.col(scraped_at).isNull() | (F.col(scraped_at).cast("date") <= F.date_sub(today, 7 * weeks)))
