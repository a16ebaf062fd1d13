"""Template residue, filler text, error pages and script notices (problem 1).

One Aho-Corasick automaton holds all phrases of all languages, the delimiters of template fields and the
typical words of filler text; one pass over a text finds them all.  A phrase counts where it stands on word
boundaries; an error message or script notice must also be a statement of its own: no quotation, and at most LEAD words
before it in its line or sentence, or half of that sentence.  Texts that talk about such messages are no residue.  A field delimiter only calls the grammar of fields for that text, a filler word only the run
test: at least FILLER_RUN filler words in a row with at least FILLER_OWN that no ordinary text uses.

Texts are compared in lower case, without accents, with digits as 0, words broken by a hyphen at a line end
joined and white space collapsed.  ``coverage`` is the part of the normalised text that matches.  ``find_residue``
names every record with a match, since that is what the data set asks for; ``without_residue`` excludes a record
when its coverage is at least MIN_COVERAGE, so that a long page which merely holds one field stays.

Defined cases: null and empty texts give no row; repeated rows of one key give one row; very long texts are
scanned whole; a null key is dropped; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

ERROR_PAGE = (
    "internal server error", "bad gateway", "service temporarily unavailable", "gateway timeout", "gateway time-out", "404 not found", "error 404:", "fehler 404", "erreur 404",
    "the page you asked for does not exist", "the page you requested could not be found", "page not found", "could not be found on this server", "403 forbidden",
    "you do not have permission to open this resource", "you do not have permission to access", "too many requests, slow down", "too many requests", "we couldn't find what you were looking for",
    "oops! something went wrong", "something went wrong while loading", "an unexpected error occurred", "this site can't be reached", "has expired, sign in to continue",
    "access denied: your", "the file you have requested has been moved or deleted", "the database connection failed", "error establishing a database connection",
    "fatal error: uncaught", "traceback (most recent call last)", "stack trace:", "connection timed out after", "image could not be displayed", "the link may be broken",
    "verify that you are human", "checking your connection before you proceed", "checking your browser", "just a moment, checking", "please complete the captcha",
    "loading, please wait", "your browser is not supported", "a mistyped address", "if the problem persists", "time of failure:",
    "seite nicht gefunden", "die seite wurde nicht gefunden", "zugriff verweigert:", "interner serverfehler", "es ist ein fehler aufgetreten",
    "cette page est introuvable", "page introuvable", "la page demandee n'existe pas", "acces refuse :", "une erreur est survenue",
    "la pagina solicitada no existe", "pagina no encontrada", "acceso denegado:", "se ha producido un error", "error interno del servidor",
)
SCRIPTS = (
    "please enable javascript", "enable javascript to", "this application needs javascript", "javascript is required", "javascript is disabled", "requires javascript to be enabled",
    "your browser has scripts turned off", "you need to turn on scripts", "turn on scripts and cookies", "scripts must be enabled", "enable scripts in your browser", "bitte aktivieren sie javascript", "javascript aktivieren", "javascript muss aktiviert sein", "veuillez activer javascript",
    "activez javascript", "javascript est desactive", "debe habilitar javascript", "habilite javascript", "active javascript en su navegador", "javascript esta desactivado",
)
FILLER = (
    "lorem ipsum", "dolor sit amet", "placeholder copy", "placeholder text", "replace this image", "replace this text", "your text goes here", "your content goes here", "text goes here",
    "this is dummy copy", "this is dummy text", "dummy copy for the layout", "caption for", "describe item", "enter subtitle", "enter title here", "type something about",
    "content coming soon", "column text", "sample paragraph", "sample text", "button label", "button text", "add a short description of this", "add your text here", "heading text here", "body text here", "title text here", "click here to edit",
    "headline goes here", "insert text here", "blindtext", "platzhaltertext", "texte factice", "faux texte", "texto de relleno", "texto de ejemplo", "hier steht ihr text", "votre texte ici", "su texto aqui",
)
KINDS = {"error_page": ERROR_PAGE, "script_notice": SCRIPTS, "filler": FILLER}

#: Classic filler vocabulary; the second line alone marks it as filler, the first occurs in other languages too.
FILLER_COMMON = "ad aliqua amet anim aute do ea elit enim esse est et ex id in ipsum irure magna non nulla officia qui quis sed sint sit sunt tempor ut velit veniam minim culpa lorem dolor dolore duis".split()
FILLER_OWN_WORDS = (
    "adipiscing aliquip cillum commodo consectetur consequat cupidatat deserunt eiusmod excepteur exercitation fugiat incididunt ipsum irure labore laboris lorem mollit nisi nostrud occaecat pariatur proident "
    "reprehenderit ullamco voluptate aute duis veniam sint"
).split()
KEYBOARD = "asdf asdfgh qwerty qwertz azerty foo bar baz xxx blah bla dummy test abc hjkl".split()
FILLER_RUN, FILLER_OWN, KEYBOARD_RUN = 4, 2, 5
LEAD, MIN_COVERAGE = 3, 0.2

TRIGGERS = ("{{", "${", "#{", "<%", "{%", "[[", "@@", "__", "%", "$", "here]", "here)", "here>", "<<", "[object", "[insert", "[enter", "[add", "xx/xx", "[your")
NAME = r"[A-Za-z_][\w.\-]*(?:[ \n][\w.\-]+){0,4}"
FIELDS = re.compile(
    rf"\{{\{{[{{#/&>]?\s*{NAME}\s*\}}\}}|[$#]\{{\s*{NAME}\s*\}}|<%[=\-]?\s*{NAME}[^%<>]{{0,60}}%>|\{{%-?\s*{NAME}[^%{{}}]{{0,60}}%\}}|\[\[\s*{NAME}\s*\]\]|@@\w+@@"
    rf"|(?<!\w)__[A-Za-z]\w*?__(?!\w)|(?<![\w%])%[A-Za-z_][\w.]*%(?!\w)|(?<![\w$])\$[A-Za-z_][\w.]*\$(?!\w)|<<\s*{NAME}\s*>>|<{NAME}\s+(?:goes\s+)?here>"
    rf"|\[(?:INSERT|ENTER|ADD|YOUR)\s+[A-Z][A-Z_ \n]*\]|\[[A-Z][A-Z_ \n]*\sHERE\]|\((?:enter|insert|add)\s+[^()]{{1,60}}?\s+here\)|\[object Object\]|\bXX/XX/XXXX\b"
)

JOIN = re.compile(r"(?<=[^\W\d_])[-­‐¬]\n(?=[^\W\d_])")
WORDS = re.compile(r"[^\W\d_]+")


def normalise(text: str) -> str:
    """The form that phrases are compared in."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("’", "'")) if not unicodedata.combining(c))
    return " ".join(JOIN.sub("", text).lower().split())


@cache
def automaton() -> ahocorasick.Automaton:
    """All phrases, field delimiters and filler words."""
    a = ahocorasick.Automaton()
    entries: dict[str, tuple[str, int]] = {}
    for kind, phrases in KINDS.items():
        for p in phrases:
            q = normalise(p)
            entries[q] = (kind, len(q))
    for p in TRIGGERS:
        entries.setdefault(p, ("field?", len(p)))
    for w in FILLER_OWN_WORDS:
        entries.setdefault(w, ("latin?", len(w)))
    for w in KEYBOARD:
        entries.setdefault(w, ("keys?", len(w)))
    for p, v in entries.items():
        a.add_word(p, v)
    a.make_automaton()
    return a


_LATIN, _OWN, _KEYS = frozenset(FILLER_COMMON) | frozenset(FILLER_OWN_WORDS), frozenset(FILLER_OWN_WORDS), frozenset(KEYBOARD)


GAP, SEGMENT, QUOTES = re.compile(r"\s+"), re.compile(r"\n|[.!?:|/>] "), "\"'“„«‘‚‹`"


def with_lines(text: str, norm: str) -> str:
    """The normalised text with its line breaks, place by place."""
    lined = GAP.sub(lambda m: "\n" if "\n" in m.group() else " ", JOIN.sub("", text).strip())
    return lined if len(lined) == len(norm) else norm


def own_statement(lined: str, a: int, b: int) -> bool:
    """Whether the phrase from a to b is said, not talked about."""
    start = max((m.end() for m in SEGMENT.finditer(lined, max(0, a - 400), a)), default=max(0, a - 400))
    before = lined[start:a]
    if before.rstrip()[-1:] in QUOTES and before.rstrip() and before.strip(QUOTES + " "):
        return False
    stop = SEGMENT.search(lined, b)
    whole = (stop.start() if stop else len(lined)) - start
    return len(WORDS.findall(before)) <= LEAD or 2 * (b - a) >= whole


def _runs(norm: str, inside: frozenset, own: frozenset, least: int, least_own: int) -> list[tuple[int, int]]:
    """Spans of runs of at least ``least`` words of ``inside``, ``least_own`` different ones of ``own`` among them."""
    out, start, end, n, seen = [], 0, 0, 0, set()
    for m in WORDS.finditer(norm):
        w = m.group()
        if w in inside:
            if not n:
                start = m.start()
            n, end = n + 1, m.end()
            if w in own:
                seen.add(w)
            continue
        if n >= least and len(seen) >= least_own:
            out.append((start, end))
        n, seen = 0, set()
    if n >= least and len(seen) >= least_own:
        out.append((start, end))
    return out


def scan(text: str | None) -> tuple[float, list[str]] | None:
    """(coverage, kinds found) of a text; None without a match."""
    if not text:
        return None
    norm = normalise(text)
    spans: list[tuple[int, int]] = []
    kinds: set[str] = set()
    field = latin = keys = False
    lined = None
    n = len(norm)
    for end, (kind, size) in automaton().iter(norm):
        if kind == "field?":
            field = True
        elif kind == "latin?":
            latin = True
        elif kind == "keys?":
            keys = True
        else:
            a, b = end - size + 1, end + 1
            if (a == 0 or not norm[a - 1].isalnum()) and (b == n or not norm[b].isalnum() or not norm[b - 1].isalnum()):
                if kind != "filler":
                    lined = lined or with_lines(text, norm)
                    if not own_statement(lined, a, b):
                        continue
                spans.append((a, b))
                kinds.add(kind)
    if latin and (found := _runs(norm, _LATIN, _OWN, FILLER_RUN, FILLER_OWN)):
        spans += found
        kinds.add("filler")
    if keys and (found := _runs(norm, _KEYS, _KEYS, KEYBOARD_RUN, 2)):
        spans += found
        kinds.add("filler")
    covered = 0
    if field and (found := [m.span() for m in FIELDS.finditer(text)]):
        covered = sum(b - a for a, b in found)
        kinds.add("template_field")
    if not kinds:
        return None
    at = 0
    for a, b in sorted(spans):
        covered += max(0, b - max(a, at))
        at = max(at, b)
    return min(1.0, covered / max(1, n)), sorted(kinds)


def find_residue(df: DataFrame, key: str, text: str, min_coverage: float = 0.0) -> DataFrame:
    """(key, coverage DOUBLE, kinds ARRAY<STRING>) of every record with residue; see the module for the defined cases."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = spread(rows, "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, *r) for k, t in zip(pdf["k"], pdf["t"]) if (r := scan(t)) and r[0] >= min_coverage]
            yield pd.DataFrame(found, columns=["k", "coverage", "kinds"])

    kind = df.schema[key].dataType.simpleString()
    hits = rows.mapInPandas(run, f"k {kind}, coverage double, kinds array<string>")
    # a key with several texts counts once, with its greatest coverage; there are only a few kinds to collect
    hits = hits.select("k", "coverage", F.explode("kinds").alias("kind")).groupBy("k")
    return hits.agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("kind")).alias("kinds")).withColumnRenamed("k", key)


def without_residue(df: DataFrame, key: str, text: str, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``df`` whose record is covered by residue to less than ``min_coverage``; rows with a null key are kept."""
    return df.join(find_residue(df, key, text, min_coverage).select(key), key, "left_anti")
