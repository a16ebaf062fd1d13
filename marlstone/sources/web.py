"""A page source for Spark: fetches URLs, or reads them from a stand-in, and keeps what could not be read as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..operators.chunking import first_wins
from ..operators.links import CUT_EVERY
from .files import exists

LOGIN_SIGNS = ("Sign in", "accounts.google.com/signin")
Fetcher = Callable[[str], tuple[int, str]]


def http_fetcher(timeout: float = 15.0) -> Fetcher:
    """Fetches over the network with the standard library."""

    def fetch(url: str) -> tuple[int, str]:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url, timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except HTTPError as e:
            return e.code, ""

    return fetch


def judge(status: int, body: str, login_signs: tuple[str, ...] = LOGIN_SIGNS) -> str | None:
    """Why a page is rejected; None for a page that is kept."""
    if status == 401:
        return "login required"
    if status != 200:
        return f"status {status}"
    return "login wall" if any(s in body for s in login_signs) else None


def fetch_pages(urls: DataFrame, url: str, fetch: Fetcher, *, pause: float = 0.0, parallel: int | None = None) -> DataFrame:
    """(url, html, reason): pages in the order of the input's partitions; ``reason`` is null where the page is kept.

    At most ``parallel`` tasks fetch at a time, each waiting ``pause`` seconds before its next page.
    """
    if parallel:
        urls = urls.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = False
        for pdf in batches:
            rows = []
            for u in pdf["u"]:
                if pause and started:
                    time.sleep(pause)
                started = True
                try:
                    status, body = fetch(u)
                    why = judge(status, body)
                except Exception as e:
                    body, why = "", str(e)[:40]
                rows.append((u, None if why else body, why))
            yield pd.DataFrame(rows, columns=["url", "html", "reason"])

    return urls.select(F.col(url).alias("u")).mapInPandas(run, "url string, html string, reason string")


def crawl(roots: DataFrame, fetch: Fetcher, links_of: Callable[[DataFrame], DataFrame], max_rounds: int | None = None, *, state: str | None = None, follow: Callable[[Column], Column] | None = None, pause: float = 0.0, parallel: int | None = None) -> DataFrame:
    """(url, html, reason, level) of all pages reached: each round fetches the frontier once and cuts lineage.

    ``links_of`` gives (url) found on fetched pages; ``follow`` says which of them are pages to fetch.  Failed pages count
    as visited and are not fetched again.  There is no depth limit unless ``max_rounds`` is given; meeting it with pages
    left is an error.  With a folder ``state`` every level's pages and frontier are written there, and a crawl that was
    broken off goes on behind the last whole level; without one they are cut to the shared folder and go with the process.
    """
    spark = roots.sparkSession
    columns = "url string, html string, reason string, level int"

    def write(df: DataFrame, kind: str, level: int) -> DataFrame:
        if state is None:
            return cut_lineage(df)
        path = f"{state}/{kind}/{level:06d}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def whole(kind: str, level: int) -> bool:
        return state is not None and exists(spark, f"{state}/{kind}/{level:06d}/_SUCCESS")

    frontier, visited = roots.select(F.col(roots.columns[0]).alias("url")).where("url IS NOT NULL").distinct(), None
    for level in count():
        if whole("pages", level):
            pages = spark.read.schema(columns).parquet(f"{state}/pages/{level:06d}")
        else:
            pages = write(fetch_pages(frontier, "url", fetch, pause=pause, parallel=parallel).withColumn("level", F.lit(level)), "pages", level)
        visited = pages if visited is None else visited.unionByName(pages)
        if whole("frontier", level):
            frontier = spark.read.schema("url string").parquet(f"{state}/frontier/{level:06d}")
        else:
            found = links_of(pages.where("reason IS NULL")).select("url").where("url IS NOT NULL AND url <> ''")
            if follow is not None:
                found = found.where(follow(F.col("url")))
            frontier = write(found.distinct().join(visited.select("url"), "url", "left_anti"), "frontier", level)
        if frontier.isEmpty():
            return visited
        if level + 1 == max_rounds:
            raise RuntimeError(f"pages are left after {max_rounds} rounds")
        if state is None and (level + 1) % CUT_EVERY == 0:
            visited = cut_lineage(visited)


def restricted_links(links: DataFrame, pages: DataFrame, order: str) -> DataFrame:
    """The links whose page was rejected, each URL once at its first place by ``order``, with ``skip_reason``.

    ``links`` has url, found_in_doc, section, breadcrumb, source_url, surrounding_text; ``pages`` is what a crawl gave.
    """
    failed = pages.where("reason IS NOT NULL").groupBy("url").agg(F.min("reason").alias("skip_reason"))
    return first_wins(links.join(failed, "url"), "url", order).withColumn("access", F.lit("restricted"))
