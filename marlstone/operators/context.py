"""Retrieved chunks to prompt context and cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.rules import is_noise_section


def _c(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def context_block() -> Column:
    """Text of one chunk in the prompt, by its type."""
    url = F.coalesce("link_url", "source_url", F.lit(""))
    image = F.concat(F.lit("[IMAGE: "), _c("section"), F.lit(" | URL: "), _c("source_url"), F.lit("]\nImage file: "), _c("image_file"), F.lit("\nContent: "), F.coalesce(F.nullif("image_content", F.lit("")), "content"))
    link = F.concat(F.lit("[REFERENCE LINK: "), _c("section"), F.lit(" | URL: "), url, F.lit("]\nTitle: "), _c("link_text"), F.lit("\nURL: "), url, F.lit("\nContains: "), _c("what_it_contains"), F.lit("\nUse when: "), _c("when_to_refer"))
    closed = F.concat(F.lit("[RESTRICTED DOCUMENT: "), _c("section"), F.lit(" | URL: "), url, F.lit("]\nURL: "), url, F.lit("\nNote: "), _c("note"), F.lit("\nContext: "), _c("content"))
    plain = F.concat(F.lit("[SOURCE: "), _c("doc_title"), F.lit(" — "), _c("section"), F.lit(" | URL: "), _c("source_url"), F.lit("]\n"), _c("content"))
    kind = F.col("chunk_type")
    return F.when(kind == "image", image).when(kind == "reference_link", link).when(kind == "restricted_doc", closed).otherwise(plain)


def context_text(ranked: DataFrame, qid: str) -> DataFrame:
    """(qid, context): the blocks of a query's chunks in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", context_block().alias("b"))))
    return ranked.groupBy(qid).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))


def shown_sources(cited: DataFrame) -> DataFrame:
    """The cited sources a reader sees: those with an address."""
    return cited.where(F.coalesce("url", F.lit("")) != "")


def sources(ranked: DataFrame, qid: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """(qid, rank, doc, section, url, kind): what an answer cites.

    Text and pictures share one key (document, section) and the first eligible row claims it; text is eligible above
    the score gate and outside noise sections.  Links and restricted documents are all cited.
    """
    kind = F.when(F.col("chunk_type").isin("text", "table", "section_index"), "document").when(F.col("chunk_type") == "image", "image").when(F.col("chunk_type") == "reference_link", "link").otherwise("restricted")
    rows = ranked.withColumn("kind", kind)
    gate = (F.col("kind") != "document") | ((F.col("raw") > int(cfg.source_gate * 1_000_000)) & ~F.coalesce(is_noise_section(F.col("section")), F.lit(False)))
    rows = rows.where(gate).withColumn("claims", F.col("kind").isin("document", "image"))
    w = Window.partitionBy(qid, "doc_title", "section", "claims").orderBy("rank")
    rows = rows.withColumn("n", F.row_number().over(w)).where(~F.col("claims") | (F.col("n") == 1))
    return rows.select(qid, "rank", F.col("doc_title").alias("doc"), "section", F.when(F.col("claims"), F.col("source_url")).otherwise(F.coalesce("link_url", "source_url")).alias("url"), "kind")
