"""Answers against expectations, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def found_keywords(answer: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))


def missing_keywords(answer: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda k: ~F.contains(F.lower(answer), F.lower(k)))


def answer_passes(answer: Column, keywords: Column) -> Column:
    """At least half of the keywords, rounded down, but one at least."""
    return F.size(found_keywords(answer, keywords)) >= F.greatest(F.lit(1), F.floor(F.size(keywords) / 2))


def source_passes(cited: Column, expected: Column) -> Column:
    """Nothing expected, or the expectation stands somewhere in the cited sources."""
    return expected.isNull() | F.contains(F.lower(F.coalesce(cited, F.lit(""))), F.lower(expected))


def checks(rows: DataFrame) -> DataFrame:
    """Adds answer_pass, source_pass, n_found, n_missing to (answer, expected_keywords, sources, expected_source)."""
    answer, words = F.coalesce("answer", F.lit("")), F.col("expected_keywords")
    return rows.withColumns({
        "answer_pass": answer_passes(answer, words), "source_pass": source_passes(F.col("sources"), F.col("expected_source")),
        "n_found": F.size(found_keywords(answer, words)), "n_missing": F.size(missing_keywords(answer, words)),
    })


def percentage(part: Column, total: Column) -> Column:
    """Per cent with one decimal, halves away from zero; null for an empty whole."""
    return F.when(total > 0, F.round(100.0 * part / total, 1))


def scores(checked: DataFrame) -> DataFrame:
    """(grouping, chunk_type, topic, total, passed, sourced, passed_percent, sourced_percent): by chunk type, by topic and over all, in one pass."""
    by = F.when(F.grouping("chunk_type") == 0, "chunk_type").when(F.grouping("topic") == 0, "topic").otherwise("all")
    counts = checked.groupingSets([["chunk_type"], ["topic"], []], "chunk_type", "topic").agg(by.alias("grouping"), F.count(F.lit(1)).alias("total"), F.count_if("answer_pass").alias("passed"), F.count_if("source_pass").alias("sourced"))
    return counts.select("grouping", "chunk_type", "topic", "total", "passed", "sourced", percentage(F.col("passed"), F.col("total")).alias("passed_percent"), percentage(F.col("sourced"), F.col("total")).alias("sourced_percent"))


def failures(checked: DataFrame, most: int = 5, words: int = 3) -> DataFrame:
    """(id, question, missing): the first failed questions by id with the first of their missing keywords; the report's preview."""
    gone = F.slice(missing_keywords(F.coalesce("answer", F.lit("")), F.col("expected_keywords")), 1, words)
    return checked.where(~F.coalesce("answer_pass", F.lit(False))).select("id", "question", gone.alias("missing")).orderBy("id").limit(most)


def report(scored: DataFrame) -> DataFrame:
    """The scores in the order they are shown in: over all, then types and topics by name."""
    return scored.orderBy(F.when(F.col("grouping") == "all", 0).when(F.col("grouping") == "chunk_type", 1).otherwise(2), F.coalesce("chunk_type", "topic", F.lit("")))
