"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Parts of a redirect and of document links, as parameters with defaults.
REDIRECT, DOC_LINK = "google.com/url", r"/document/d/"
BLOCKED = ("facebook.com", "twitter.com", "instagram.com")


def canonical(href: Column, doc_link: str = DOC_LINK) -> Column:
    """One spelling for every link: redirects unwrapped, fragment, user prefix, edit suffix and trailing slashes off."""
    h = F.coalesce(href, F.lit(""))
    after = F.substring_index(F.substring(h, F.instr(h, "?q=") + F.lit(3), F.length(h)), "&", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(after, F.lit("+"), F.lit("%2B"))), after)
    h = F.when(h.contains(REDIRECT) & h.contains("?q="), plain).otherwise(h)
    h = F.substring_index(h, "#", 1)
    h = F.regexp_replace(h, r"/u/\d+/", "/")
    h = F.regexp_replace(h, r"/(edit|view|copy)(\?[^\n]*)?\z", "")
    h = F.when(h.rlike(doc_link) & ~h.endswith("/pub"), F.substring_index(h, "?", 1)).when(h.rlike(doc_link + r".*/pub\?"), F.substring_index(h, "?", 1)).otherwise(h)
    return F.rtrim(strip(h), F.lit("/"))


def is_doc(href: Column, doc_link: str = DOC_LINK) -> Column:
    return F.coalesce(href.rlike(doc_link), F.lit(False))


def is_blocked(href: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    return F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.contains(href, b))


def is_external(href: Column) -> Column:
    return (href != "") & ~href.startswith("#") & ~is_blocked(href) & ~is_doc(href) & href.startswith("http")


def should_follow(href: Column) -> Column:
    """Whether a link leads to a document to be fetched; what has been visited is an anti-join of the crawl's own."""
    h = F.coalesce(href, F.lit(""))
    return (h != "") & ~h.startswith("#") & ~is_blocked(h) & is_doc(h)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def authority(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def host_label(url: Column) -> Column:
    """First label of the host, capitalised."""
    return F.initcap(F.split_part(host(url), F.lit("."), F.lit(1)))
