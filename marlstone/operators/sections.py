"""Markdown documents to sections, without a shuffle: a document's blocks are cut and folded inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADING_AHEAD, META_LINE, front_matter, parse_meta, strip


def blocks(text: Column) -> Column:
    """The text before the first heading, then one block per heading."""
    return F.split(text, HEADING_AHEAD)


def last_meta(block: Column) -> Column:
    """Last meta comment line of a block; null without one."""
    return F.try_element_at(F.regexp_extract_all(block, F.lit(r"(?dm)^[^\S\n]*(<!-- meta[^\n]*)"), 1), F.lit(-1))


def split_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no from 1, level, heading, content, meta): one row per non-empty section.

    Text before the first heading is left out; meta comments leave the content and belong to the next heading.
    Null texts give no rows.
    """
    opens = F.lit(r"\A#{1,4}[^\S\n][^\n]")
    parts = docs.select(F.col(key), blocks(F.col(text)).alias("bs"))
    parts = parts.withColumn("shift", F.when(F.rlike(F.get("bs", F.lit(0)), opens), 1).otherwise(0))  # no block before the first heading
    numbered = F.transform("bs", lambda b, i: F.struct(i.alias("i"), b.alias("b"), F.when(i > 0, last_meta(F.get("bs", i - 1))).alias("meta")))
    rows = parts.select(key, "shift", F.inline(F.filter(numbered, lambda x: F.rlike(x["b"], opens))))
    content = strip(F.regexp_replace("b", META_LINE, ""))
    out = rows.select(
        key, (F.col("i") + F.col("shift")).alias("i"), F.length(F.regexp_extract("b", r"\A(#{1,4})[^\S\n]", 1)).alias("level"),
        strip(F.regexp_extract("b", r"\A#{1,4}[^\S\n]+([^\n]*)", 1)).alias("heading"), content.alias("content"), "meta",
    )
    return out.where((F.col("content") != "") & (F.col("heading") != "")).withColumn("section_no", F.col("i").cast("int")).drop("i")


def with_metadata(sections: DataFrame, doc_title: Column, source_url: Column) -> DataFrame:
    """Document, section, breadcrumb and URL of every section: from its meta comment, else from the document."""
    return sections.select(
        "*",
        F.coalesce(parse_meta(F.col("meta"), "doc"), doc_title).alias("chunk_doc"),
        F.coalesce(parse_meta(F.col("meta"), "section"), F.col("heading")).alias("section"),
        F.coalesce(parse_meta(F.col("meta"), "breadcrumb"), F.concat(doc_title, F.lit(" > "), F.col("heading"))).alias("breadcrumb"),
        F.coalesce(parse_meta(F.col("meta"), "url"), source_url).alias("chunk_url"),
    )


def headings(text: Column) -> Column:
    """array<struct<level, title>> of a document."""
    lines = F.regexp_extract_all(text, F.lit(r"(?dm)^(#{1,4}[^\S\n]+[^\n]+)$"), 1)
    made = F.transform(lines, lambda s: F.struct(F.length(F.regexp_extract(s, r"\A(#+)", 1)).alias("level"), strip(F.regexp_replace(s, r"\A#+", "")).alias("title")))
    return F.filter(made, lambda h: h["title"] != "")


def breadcrumbs(hs: Column, doc: Column) -> Column:
    """Path of every heading: a stack that starts with the document, cut to the heading's level and pushed."""
    start = F.struct(F.array(doc).alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        stack = F.concat(F.slice(s["stack"], F.lit(1), F.least(F.size(s["stack"]), h["level"])), F.array(h["title"]))
        return F.struct(stack.alias("stack"), F.concat(s["out"], F.array(F.array_join(stack, " > "))).alias("out"))

    return F.aggregate(hs, start, step)["out"]


def section_index(doc_title: Column, hs: Column) -> Column:
    """Navigation text of a document; null without headings."""
    lines = F.transform(hs, lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- "), h["title"]))
    return F.when(F.size(hs) > 0, F.concat(F.lit("# Section Index: "), doc_title, F.lit("\n\n"), F.array_join(lines, "\n")))


def document_fields(docs: DataFrame, text: str) -> DataFrame:
    """Front-matter fields beside the columns there are."""
    t = F.col(text)
    return docs.withColumns({f"fm_{k}": front_matter(t, k) for k in ("doc_title", "source_url", "parent_doc", "scraped_at")})
