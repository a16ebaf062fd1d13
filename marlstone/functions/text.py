"""Text expressions (Column to Column, all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped: control spaces, no-break and other Unicode spaces.
SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
META_LINE = r"(?dm)^[^\S\n]*<!-- meta[^\n]*\n?"
HEADING_AHEAD = r"(?dm)(?=^#{1,4}[^\S\n][^\n])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACES}+|{SPACES}+\z", "")


def token_count(c: Column) -> Column:
    """Code points divided by four, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def words(c: Column) -> Column:
    """Lower-case words of two or more ASCII letters; words with other letters, digits or underscores do not count."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[a-z]{2,}$"))


def join_present(sep: str, *cols: Column) -> Column:
    """The non-empty ones, joined."""
    return F.concat_ws(sep, *[F.when(c != "", c) for c in cols])


def embed_text(content: Column, questions: Column) -> Column:
    """What is embedded: the text, then the questions."""
    return join_present(" ", strip(F.coalesce(content, F.lit(""))), F.array_join(F.coalesce(questions, F.array().cast("array<string>")), " "))


def post_clean(c: Column) -> Column:
    """Collapse blank lines, drop zero-width marks and boilerplate, trim line ends."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", "")
    c = F.regexp_replace(c, r"\x{A0}", " ")
    c = F.regexp_replace(c, r"Report abuse|Learn more", "")
    c = F.regexp_replace(c, r"\[\]\(#[^)]*\)|\[ \]", "")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return strip(c)


def front_matter(c: Column, key: str) -> Column:
    """Value of a front-matter key; null without front matter, empty without the key.  The last mention counts."""
    block = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---", 1)
    values = F.regexp_extract_all(block, F.lit(rf"(?dm)^{key}:([^\n]*)"), 1)
    return F.when(c.rlike(r"(?s)\A---\n(.*?)\n---"), strip(F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))))


def parse_meta(line: Column, key: str) -> Column:
    """Value of a key of a meta comment line; null without the key.  The last mention counts."""
    bare = F.regexp_replace(F.regexp_replace(line, r"<!--\s*meta\s*", ""), r"\s*-->", "")
    parts = F.transform(F.split(bare, r"\|"), strip)
    hits = F.filter(parts, lambda p: F.instr(p, ":").__gt__(0) & (strip(F.substring_index(p, ":", 1)) == key))
    last = F.try_element_at(hits, F.lit(-1))
    return strip(F.substring(last, F.instr(last, ":") + F.lit(1), F.length(last)))


def title_from_file(c: Column) -> Column:
    """Title made of a file name without its ending."""
    return F.initcap(F.replace(F.regexp_replace(c, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def parse_questions(response: Column, most: int = 3, least_chars: int = 10) -> Column:
    """Questions of a model's answer: numbering and bullets off, long enough, with a question mark, the first few."""
    lines = F.transform(F.split(response, "\n"), lambda s: strip(F.ltrim(strip(s), F.lit("0123456789.-)*• "))))
    return F.slice(F.filter(lines, lambda s: (F.length(s) > least_chars) & s.contains("?")), 1, most)


def strip_image_blocks(c: Column) -> Column:
    """Text before the first image marker."""
    return strip(F.regexp_replace(c, r"(?s)\[IMAGE:[^\]]+\].*\z", ""))


def strip_citation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\n*📎.*\z", "")


def clean_title(c: Column) -> Column:
    """Page title without the editor's suffix and the mark of a copy."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\s*-\s*Google Docs.*\z", ""), r"\ACopy of ", ""))


def front_matter_block(title: Column, url: Column, parent: Column, scraped_at: Column) -> Column:
    """Front matter of a document."""
    return F.concat(F.lit("---\ndoc_title: "), title, F.lit("\nsource_url: "), url, F.lit("\nparent_doc: "), parent, F.lit("\nscraped_at: "), scraped_at, F.lit("\n---\n"))


def meta_comment(doc: Column, section: Column, breadcrumb: Column, url: Column) -> Column:
    """Meta comment that belongs to the next heading."""
    return F.concat(F.lit("<!-- meta | doc:"), doc, F.lit(" | section:"), section, F.lit(" | breadcrumb:"), breadcrumb, F.lit(" | url:"), url, F.lit(" -->"))


def heading_line(level: Column, title: Column, number: Column) -> Column:
    """Heading with its number from the table of contents, unless the title has it."""
    shown = F.when(number.isNull() | (number == "") | F.contains(title, number), title).otherwise(F.concat_ws(" ", number, title))
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), shown)


def image_context(filename: Column, before: Column, after: Column) -> Column:
    """Picture marker with what stands around it."""
    return F.concat(F.lit("[IMAGE:"), filename, F.lit("]\nContext before: "), F.coalesce(before, F.lit("")), F.lit("\nContext after: "), F.coalesce(after, F.lit("")))


def question_prompt(content: Column, section: Column, most_chars: int = 1500, least_chars: int = 50) -> Column:
    """Prompt that asks a model for questions a text answers; null for very short texts."""
    text = strip(content)
    return F.when(F.length(text) >= least_chars, F.concat(F.lit("Write three questions that this text answers.\nSection: "), F.coalesce(section, F.lit("")), F.lit("\n\n"), F.substring(text, 1, most_chars)))


def cap_question(question: Column, most: int = 500) -> Column:
    """A question, cut to the length that is accepted."""
    return F.substring(question, 1, most)


def iso_now() -> Column:
    """Date and time of the run, in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")


def size_kb(content: Column) -> Column:
    """Kilobytes of binary content, two decimals."""
    return F.round(F.octet_length(content) / 1024.0, 2)
