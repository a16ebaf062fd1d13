"""Content addresses and hashed buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(content: Column) -> Column:
    """First 12 hex digits of the MD5 of the text."""
    return F.substring(F.md5(content), 1, 12)


def point_id(chunk: Column) -> Column:
    """First 32 bits of the MD5 of a chunk id, as a whole number."""
    return F.conv(F.substring(F.md5(chunk), 1, 8), 16, 10).cast("bigint")


def word_bucket(word: Column, buckets: int = 100_000) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("bigint") % F.lit(buckets)


def quantise(score: Column) -> Column:
    """A score as millionths, rounded half up: ordering and comparing is exact on it."""
    return F.floor(score * 1e6 + 0.5).cast("bigint")
