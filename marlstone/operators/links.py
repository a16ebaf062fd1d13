"""Links found in documents: contexts, classes, levels."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage

#: Rounds after which the union of all levels is written as one table.
CUT_EVERY = 50


def link_contexts(links: DataFrame, url: str, found_at: str, order: str) -> DataFrame:
    """(url, found_at, also_found_in, n): the first place by ``order`` and the other places in order, each once."""
    places = links.groupBy(url, found_at).agg(F.min(order).alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o", found_at)))
    return places.groupBy(url).agg(ordered.alias("p")).select(
        url, F.get("p", F.lit(0))[found_at].alias(found_at), F.transform(F.slice("p", 2, 1 << 30), lambda x: x[found_at]).alias("also_found_in"), F.size("p").alias("n")
    )


def crawl_levels(edges: DataFrame, roots: DataFrame, src: str, dst: str, max_rounds: int | None = None) -> DataFrame:
    """(node, level): nodes in breadth-first order from the roots; cycles end at visited nodes.

    Every round is one join and one anti-join; visited nodes are cut to the shared folder, so lineage stays short.
    There is no depth limit unless ``max_rounds`` is given; meeting it with nodes left is an error.
    """
    frontier = cut_lineage(roots.select(F.col(roots.columns[0]).alias("node")).where("node IS NOT NULL").distinct().withColumn("level", F.lit(0)))
    visited = frontier
    for level in count(1):
        step = frontier.join(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")), "node").select(F.col("next").alias("node")).where("node IS NOT NULL").distinct()
        frontier = cut_lineage(step.join(visited, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return visited
        if level == max_rounds:
            raise RuntimeError(f"nodes are left after {max_rounds} rounds")
        visited = visited.unionByName(frontier)
        if level % CUT_EVERY == 0:
            visited = cut_lineage(visited)


def reference_links(pages: DataFrame, key: str, links: str = "links") -> DataFrame:
    """(url, link_text, surrounding_text, category, found_in, also_found_in): external links of extracted pages, each once.

    The first place in order of page and position gives the text, the others are listed.
    """
    from ..functions.rules import classify_link
    from ..functions.url import canonical, is_external

    rows = pages.select(key, F.inline(links)).withColumn("url", canonical(F.col("href"))).where(is_external(F.col("url")))
    rows = rows.groupBy("url", key).agg(F.min(F.struct("pos", "text", "around")).alias("at")).select("url", F.struct(F.col(key), F.col("at.pos"), F.col("at.text"), F.col("at.around")).alias("p"))
    each = rows.groupBy("url").agg(F.array_sort(F.collect_list("p")).alias("ps")).withColumn("p", F.get("ps", F.lit(0)))
    return each.select(
        "url", F.col("p.text").alias("link_text"), F.col("p.around").alias("surrounding_text"), classify_link(F.col("url"), F.lit(""), F.col("p.around")).alias("category"),
        F.col(f"p.{key}").alias("found_in"), F.transform(F.slice("ps", 2, 1 << 30), lambda x: x[key]).alias("also_found_in"),
    )
