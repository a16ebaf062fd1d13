"""Pictures of pages: bytes, kinds, sizes, names and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import size_kb
from ..lineage import cut_lineage
from ..sources.files import image_extension, image_names, inline_image

ImageFetcher = Callable[[str], tuple[str, bytes]]


def dimensions_of(raw: bytes) -> tuple[int, int] | None:
    """(width, height) from the head of a PNG, GIF, JPEG, BMP or WebP file; None for others and broken ones."""
    n = int.from_bytes
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return n(raw[16:20], "big"), n(raw[20:24], "big")
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return n(raw[6:8], "little"), n(raw[8:10], "little")
    if raw[:2] == b"BM" and len(raw) >= 26:
        return n(raw[18:22], "little"), abs(n(raw[22:26], "little", signed=True))
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        if raw[12:16] == b"VP8X":
            return n(raw[24:27], "little") + 1, n(raw[27:30], "little") + 1
        if raw[12:16] == b"VP8L":
            bits = n(raw[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return n(raw[26:28], "little") & 0x3FFF, n(raw[28:30], "little") & 0x3FFF
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(raw) and raw[at] == 0xFF:
            if raw[at + 1] in range(0xC0, 0xD0) and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                return n(raw[at + 7 : at + 9], "big"), n(raw[at + 5 : at + 7], "big")
            at += 2 + n(raw[at + 2 : at + 4], "big")
    return None


def dimensions(content: Column) -> Column:
    """struct<width, height> of pictures, read from their first bytes; null fields where they cannot be told."""

    @F.pandas_udf("width int, height int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(dimensions_of(bytes(c)) if c is not None else None) or (None, None) for c in s], columns=["width", "height"]).astype("Int32")

    return run(F.substring(content, 1, 1 << 16))


def fetch_images(images: DataFrame, src: str, fetch: ImageFetcher | None = None) -> DataFrame:
    """Adds content, extension and reason: inline pictures are decoded, others fetched; what cannot be had has null content and a reason."""
    rows = images.withColumn("_inline", F.col(src).startswith("data:"))
    kind = F.when(F.col("_inline"), F.regexp_extract(src, "^data:([^;,]*)", 1))
    if fetch is None:
        return rows.withColumns({"content": F.when(F.col("_inline"), inline_image(src)), "extension": image_extension(F.coalesce(kind, F.lit("")))}).withColumn("reason", F.when(F.col("content").isNull(), F.when(F.col("_inline"), "not readable").otherwise("not fetched"))).drop("_inline")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for u in pdf["u"]:
                try:
                    out.append((u, *fetch(u), None))
                except Exception as e:
                    out.append((u, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["_u", "_kind", "_raw", "_why"])

    outside = rows.where(~F.col("_inline")).select(F.col(src).alias("u")).distinct()
    got = cut_lineage(outside.mapInPandas(run, "_u string, _kind string, _raw binary, _why string"))
    both = rows.join(got, F.col(src) == F.col("_u"), "left")
    content = F.when(F.col("_inline"), inline_image(src)).otherwise(F.col("_raw"))
    both = both.withColumns({"content": content, "extension": image_extension(F.coalesce(kind, F.col("_kind"), F.lit("")))})
    return both.withColumn("reason", F.when(F.col("content").isNull(), F.coalesce("_why", F.lit("not readable")))).drop("_inline", "_u", "_kind", "_raw", "_why")


def page_images(pages: DataFrame, key: str, images: str = "images") -> DataFrame:
    """(key, pos, src, alt, section, before, after): one row per picture of every page."""
    return pages.select(key, F.inline(images))


def image_records(rows: DataFrame, order: str) -> DataFrame:
    """Records of pictures with content, in order: the same bytes once, numbered file names, size and what stands around them.

    ``rows`` has content, extension, section, before, after and the column ``order``.
    """
    named = image_names(rows.where(F.col("content").isNotNull()), order, "extension")
    return named.select(
        F.col("file").alias("filename"), "section", F.col("before").alias("surrounding_before"), F.col("after").alias("surrounding_after"), size_kb(F.col("content")).alias("file_size_kb"), "image_hash", "content", F.lit(True).alias("needs_ocr"),
    )
