"""Ordered rule tables turned into CASE expressions; the rules are data, so a corpus brings its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Questions that need no retrieval.
OFF_TOPIC = (
    "who are you", "what are you", "what can you do", "what do you know", "how do you work", "are you an ai", "are you a bot",
    "hello", "hi ", "hey ", "thanks", "thank you", "bye", "goodbye", "what is the capital", "who is the president", "weather", "recipe", "movie", "song", "game",
)
#: What a picture's text holds if it shows a table or a diagram.
TABLE_SIGNS = ("|", "---", "course code", "credits", "marks", "percentage", "grade", "fee", "term", "week", "total", "minimum", "maximum", "sl.no", "s.no")
DIAGRAM_SIGNS = ("→", "←", "↑", "↓", "flow", "process", "step", "level", "foundation", "diploma", "degree", "pathway", "arrow")
#: Sections that are never cited.
NOISE_SECTIONS = ("this will be in effect", "important advisory", "section index")

#: (parts of the URL, parts of the context, category): the first rule wins; an empty tuple matches everything.
LINK_RULES: tuple[tuple[tuple[str, ...], tuple[str, ...], str], ...] = (
    (("timetable", "schedule"), ("exam", "quiz"), "exam_info"),
    (("timetable", "schedule"), (), "schedule"),
    (("form", "registration"), ("request", "register"), "registration_form"),
    (("form",), (), "form"),
    (("video", "media."), (), "video"),
    (("library", "archive"), (), "archive"),
    (("portal",), (), "official_portal"),
    (("policy", "grading"), (), "policy"),
    ((), ("reading list",), "course_list"),
)


def any_of(c: Column, parts: Sequence[str]) -> Column:
    """Whether the text holds one of the parts."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(c, p))


def count_of(c: Column, parts: Sequence[str]) -> Column:
    """How many of the parts the text holds (presence, not frequency)."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(c, p)))


def is_off_topic(question: Column, patterns: Sequence[str] = OFF_TOPIC) -> Column:
    return any_of(F.trim(F.lower(question)), patterns)


def is_noise_section(section: Column, phrases: Sequence[str] = NOISE_SECTIONS) -> Column:
    return any_of(F.lower(section), phrases)


def classify_link(url: Column, section: Column, surrounding: Column, rules: Sequence = LINK_RULES, default: str = "external_reference") -> Column:
    """Category of a link by the first rule that holds."""
    u, context = F.lower(url), F.concat_ws(" ", F.lower(section), F.lower(surrounding))
    out = None
    for parts, words, category in rules:
        test = (any_of(u, parts) if parts else F.lit(True)) & (any_of(context, words) if words else F.lit(True))
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise(default)


def classify_image(text: Column, size_bytes: Column) -> Column:
    """image_empty, image_table, image_diagram or image_text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return (
        F.when(F.length(F.trim(t)) < 10, "image_empty")
        .when(size_bytes < 500, "image_empty")
        .when((count_of(low, TABLE_SIGNS) >= 2) | (pipes >= 3), "image_table")
        .when(count_of(low, DIAGRAM_SIGNS) >= 2, "image_diagram")
        .otherwise("image_text")
    )


def scan_result(text: Column, error: Column, size_bytes: Column, width: Column, height: Column) -> Column:
    """struct<chunk_type, is_decorative, scan_method> of a scanned picture.

    Tiny files are decorative without a scan; after an error the dimensions decide, and what is left is a placeholder.
    """
    made = lambda kind, decorative, method: F.struct(F.lit(kind).alias("chunk_type") if isinstance(kind, str) else kind.alias("chunk_type"), F.lit(decorative).alias("is_decorative") if isinstance(decorative, bool) else decorative.alias("is_decorative"), F.lit(method).alias("scan_method"))
    kind = classify_image(text, size_bytes)
    return (
        F.when(size_bytes < 500, made("image_empty", True, "size"))
        .when(error.isNotNull() & ((width < 10) | (height < 10)), made("image_empty", True, "dimensions"))
        .when(error.isNotNull(), made("image_text", False, "fallback"))
        .otherwise(made(kind, kind == "image_empty", "ocr"))
    )
