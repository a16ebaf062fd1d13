"""HTML pages to titles, links, headings, tables and markdown, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "header", "footer", "noscript"}
#: Containers that are skipped by their id.
SKIPPED_IDS = {"header", "footer", "banners"}
#: Characters kept of the block around a link.
AROUND = 200
BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "td", "th", "tr", "table", "ul", "ol", "div", "section", "article", "main", "title", "br"}


class Reader(HTMLParser):
    """Collects (kind, level, text) blocks and (href, text, context) links; an open paragraph ends at the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.links: list[tuple[str, str, int]] = []
        self.kind, self.level, self.text = "", 0, []
        self.skip = ""  # tag that is being skipped, and how deep
        self.depth = 0
        self.images: list[tuple[str, str, int]] = []
        self.headings: list[tuple[int, str, str]] = []  # level, title, anchor
        self.own_id = ""  # id of the open heading, or of the first link or span in it
        self.pictured = False  # the open paragraph is that of a picture: its text does not count
        self.href: str | None = None
        self.anchor: list[str] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if self.pictured:
            self.text, self.kind, self.level, self.pictured = [], "", 0, False
            return
        if text:
            self.blocks.append((self.kind or "p", self.level, text))
            if self.kind == "heading":
                self.headings.append((self.level, text, self.own_id))
        self.text, self.kind, self.level = [], "", 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            self.depth += tag == self.skip
            return
        if tag in SKIPPED or tag == "div" and dict(attrs).get("id") in SKIPPED_IDS:
            self.skip, self.depth = tag, 1
            return
        if self.kind == "heading" and tag in ("a", "span") and not self.own_id:
            self.own_id = dict(attrs).get("id") or ""
        if tag == "img" and not self.pictured:
            src = dict(attrs).get("src") or ""
            if src:
                if self.kind == "p":
                    self.text = []
                self.flush()
                self.images.append((src, dict(attrs).get("alt") or "", len(self.blocks)))
                self.blocks.append(("image", len(self.images) - 1, src))
                self.pictured = True
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.text = []
        elif tag == "a":
            self.href, self.anchor = dict(attrs).get("href") or "", []
        elif tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS and self.rows is None:
            self.flush()
            self.kind = "heading" if tag in ("h1", "h2", "h3", "h4") else "title" if tag == "title" else "li" if tag == "li" else "p"
            self.level = int(tag[1]) if self.kind == "heading" else 0
            self.own_id = dict(attrs).get("id") or ""

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.depth -= tag == self.skip
            if not self.depth:
                self.skip = ""
            return
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.anchor).split()), len(self.blocks)))
            self.href = None
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.text).split()).replace("|", "\\|"))
            self.text = []
        elif tag == "tr" and self.rows is not None and self.row is not None:
            if any(self.row):
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            if self.rows:
                wide = max(map(len, self.rows))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in self.rows]
                lines.insert(1, "|" + "---|" * wide)
                self.blocks.append(("table", 0, "\n".join(lines)))
            self.rows = None
        elif tag in BLOCKS and self.rows is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.text.append(data)
        if self.href is not None:
            self.anchor.append(data)

    def close(self) -> None:
        super().close()
        self.flush()


def read(html: str) -> Reader:
    r = Reader()
    r.feed(html)
    r.close()
    return r


def with_section(r: Reader) -> list[tuple[str, int, str]]:
    """The blocks, every table behind a line that names the section it stands in."""
    out, section = [], ""
    for kind, level, text in r.blocks:
        if kind == "heading":
            section = text
        out.append((kind, level, f"> *Table from section: **{section}***\n\n{text}" if kind == "table" else text))
    return out


def markdown(r: Reader, annotate: bool = False) -> str:
    """Blocks as markdown, blank lines between them; with ``annotate`` tables are told apart by their section."""
    made = {"heading": lambda b: "#" * b[1] + " " + b[2], "li": lambda b: "- " + b[2], "image": lambda b: image_block(r, b[1])}
    return "\n\n".join(made.get(b[0], lambda b: b[2])(b) for b in (with_section(r) if annotate else r.blocks) if b[0] != "title")


def around_image(r: Reader, number: int, before: int = 150, after: int = 200) -> tuple[str, str, str]:
    """(section, text before, text after) of a picture: the paragraph since the heading, and the next paragraph or list item."""
    at = r.images[number][2]
    section, earlier = "", ""
    for kind, _, text in r.blocks[:at]:
        if kind == "heading":
            section, earlier = text, ""
        elif kind == "p":  # lists do not count
            earlier = text
    later = next((b[2] for b in r.blocks[at + 1 :] if b[0] in ("p", "li")), "")
    return section, earlier[:before], later[:after]


def image_block(r: Reader, number: int) -> str:
    """Marker of a picture with what stands around it."""
    src = r.images[number][0]
    _, before, after = around_image(r, number)
    return f"[IMAGE:{src if not src.startswith('data:') else f'inline {number}'}]\nContext before: {before}\nContext after: {after}"


def extract(pages: DataFrame, key: str, html: str, *, annotate: bool = False) -> DataFrame:
    """(key, title, markdown, links ARRAY<STRUCT<pos, href, text, around>>, images ARRAY<STRUCT<pos, src, alt, section, before, after>>, headings ARRAY<STRUCT<pos, level, title, anchor>>) of every page.

    The anchor of a heading is its own id, else that of the first link or span in it, else empty.
    ``around`` is the beginning of the block that a link stands in.  Of a paragraph with pictures the first one stays and
    its text does not count.  ``annotate`` puts the name of the section above every table.  A null page gives empty fields.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h in zip(pdf["k"], pdf["h"]):
                r = read(h or "")
                title = next((b[2] for b in r.blocks if b[0] == "title"), "")
                rows.append((k, title, markdown(r, annotate), [{"pos": i, "href": a, "text": t, "around": r.blocks[b][2][:AROUND] if b < len(r.blocks) else ""} for i, (a, t, b) in enumerate(r.links)], [dict(zip(("pos", "src", "alt", "section", "before", "after"), (i, s, alt, *around_image(r, i)))) for i, (s, alt, _) in enumerate(r.images)], [dict(zip(("pos", "level", "title", "anchor"), (i, *h))) for i, h in enumerate(r.headings)]))
            yield pd.DataFrame(rows, columns=["k", "title", "markdown", "links", "images", "headings"])

    out = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, title string, markdown string, links array<struct<pos: int, href: string, text: string, around: string>>, images array<struct<pos: int, src: string, alt: string, section: string, before: string, after: string>>, headings array<struct<pos: int, level: int, title: string, anchor: string>>")
    return out.withColumnRenamed("k", key)


def contents(links: Column) -> Column:
    """array<struct<anchor, number, title, level>> of a page's table of contents: links to anchors inside the page.

    The level is the number of dots plus one; of links to one anchor the last counts.
    """
    inner = F.filter(links, lambda x: x["href"].startswith("#h.") & (F.trim(x["text"]) != ""))
    number = lambda x: F.regexp_extract(x["text"], r"^\s*(\d+(?:\.\d+)*)", 1)
    level = lambda x: F.when(number(x) == "", 1).otherwise(F.size(F.split(number(x), r"\.")))
    made = F.transform(inner, lambda x: F.struct(F.substring(x["href"], 2, 1 << 20).alias("anchor"), number(x).alias("number"), F.trim(x["text"]).alias("title"), level(x).alias("level")))
    return F.filter(F.transform(made, lambda e, i: F.struct(e.alias("e"), F.exists(F.slice(made, i + 2, F.lit(1 << 20)), lambda y: y["anchor"] == e["anchor"]).alias("later"))), lambda z: ~z["later"])["e"]


def document_links(pages: DataFrame, key: str, links: str = "links") -> DataFrame:
    """(key, url, pos): canonical links of every page, each once, at its first place."""
    from ..functions.url import canonical

    rows = pages.select(key, F.explode(links).alias("x")).select(key, canonical(F.col("x.href")).alias("url"), F.col("x.pos").alias("pos"))
    return rows.where("url <> ''").groupBy(key, "url").agg(F.min("pos").alias("pos"))


def number_headings(headings: DataFrame, toc: DataFrame, anchor: str, key: str) -> DataFrame:
    """Headings with the number of their anchor in the page's table of contents (left outer join); null without one."""
    return headings.join(toc.select(key, F.col("anchor").alias(anchor), "number"), [key, anchor], "left")
