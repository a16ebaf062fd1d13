"""Noise in text of scanned pages: find it and put the text together again (problem 3).

1. *Line labels.*  A hidden Markov model labels the lines of each page as body, running header, page number,
   section heading, table or break.  It sees layout features only (relative length, marks, capitals, place on
   the page, whether the line interrupts a sentence, on how many other pages the line stands with other
   numbers).  Its start, transition and emission counts are estimated from the pages themselves: a first
   labelling by rules, then ROUNDS of Viterbi decoding and counting.  Counts are summed by Spark over all pages;
   the model has the same few hundred numbers for any corpus.
2. *Words broken over lines.*  A body line that ends with a letter and a hyphen, and whose next body line starts
   with a small letter, is broken noise unless the corpus writes the word with its hyphen more often than without.
3. *Misread words.*  Each distinct word is turned into the words it may stand for (glyph and letter confusions);
   it is misread if one of those is at least RATIO times as frequent.  Both sides are tables of distinct words and meet
   in a join; no vocabulary is broadcast.  The model of step 1 says which lines hold words at all, the table which of
   them are misread.

Words are counted inside each Arrow batch before they are shuffled.  To find their places again, the misread words are
put into a bit table of at most FILTER_BITS bits, and only words that it may hold leave the pages for the exact join;
common words never do.

The repaired text joins the body lines of a paragraph, closes broken words, replaces misread ones and leaves
headers and page numbers out.

Defined cases: null, empty and blank texts give no rows; repeated rows of one key count once (the least text);
a text of one line has no headers or page numbers; ties between corrections go to the more frequent, then the
lesser word; very long texts are read whole; a null key is dropped; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import spread

BODY, HEADER, PAGE_NO, HEADING, TABLE, BREAK = range(6)
LABELS = ["body", "header", "page_no", "heading", "table", "break"]
ROUNDS, SMOOTHING = 2, 0.5
RATIO, LEAST = 6, 4
FILTER_BITS = 1 << 27

GLYPHS = {"0": "o", "1": "l", "|": "l", "5": "s", "9": "g", "6": "b", "(": "c", "†": "t", "ø": "o", "€": "e", "$": "s", "¢": "c", "@": "a", "8": "b", "!": "l", "4": "a", "3": "e", "ł": "l", "¡": "i", "ß": "b"}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ﬅ": "st", "œ": "oe", "æ": "ae"}
#: What stands in the text, and what it may stand for (fixed confusions of character recognition).
CONFUSIONS = [("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("i", "l"), ("l", "i"), ("vv", "w"), ("w", "vv"), ("in", "m"), ("nn", "m"), ("o", "c"), ("f", "t"), ("t", "f"), ("u", "n"), ("a", "o"), ("q", "g"), ("tl", "d"), ("ll", "u")]
HYPHENS = "-‐¬­"
ROMAN = re.compile(r"(?i)^(?=[ivxlc])(?:x{0,3}|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
PAGE = re.compile(r"(?i)^[^\w]*(?:(?:pa[g9]e|seite|p[g9]|p|página|s)\s*\.?\s*)?\d{1,4}(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?[^\w]*$")
NUMBERED = re.compile(r"^\d{1,2}(?:\.\d{1,2}){1,3}\.?\s+\w")
SPACED = re.compile(r"^(?:\S ){3,}\S?|(?:^|\s)(?:\S ){4,}\S(?:\s|$)")


def fold(text: str) -> str:
    """Small letters without accents, ligatures opened."""
    if text.isascii():
        return text.lower()
    for a, b in LIGATURES.items():
        if a in text:
            text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def mask(line: str) -> str:
    """A line as it would stand on another page: numbers as 0."""
    return re.sub(r"\d+", "0", " ".join(fold(line).split()))


def layout(lines: list[str], seen: list[int]) -> np.ndarray:
    """Categorical layout features of every line (one column each); ``seen``: other pages with the same masked line."""
    n = len(lines)
    texts = [x.strip() for x in lines]
    longest = max(map(len, texts), default=1) or 1
    filled = [i for i in range(n) if texts[i]]
    place = {i: k for k, i in enumerate(filled)}
    out = np.zeros((n, len(SIZES)), np.int64)
    for i, s in enumerate(texts):
        if not s:
            out[i] = 0
            out[i, 0] = 5
            continue
        k = place[i]
        before = texts[filled[k - 1]] if k else ""
        after = texts[filled[k + 1]] if k + 1 < len(filled) else ""
        r = len(s) / longest
        words = s.split()
        letters = [w for w in words if w[0].isalpha()]
        capital = sum(w[0].isupper() for w in letters) / len(letters) if letters else 0.0
        out[i, 0] = 0 if r < 0.25 else 1 if r < 0.5 else 2 if r < 0.8 else 3
        out[i, 1] = 1 if PAGE.match(s) and not s.endswith(".") else 2 if ROMAN.match(s) else 3 if not any(c.isalpha() for c in s) else 0
        out[i, 2] = 1 if s[-1] in ".!?:" else 2 if s[-1] in HYPHENS + "," else 3 if s[-1].isdigit() else 4 if s[-1] == ")" else 0
        out[i, 3] = 0 if s[0].islower() else 1 if s[0].isupper() else 2 if s[0].isdigit() else 3
        out[i, 4] = 4 if SPACED.search(s) else 3 if len(s) > 5 and s.upper() == s and any(c.isalpha() for c in s) else 2 if capital > 0.95 and len(letters) > 1 else 1 if capital >= 0.5 else 0
        out[i, 5] = 1 if re.search(r"\s[|·•—]\s", s) else 2 if re.search(r"\([^()]*\)$", s) else 3 if ": " in s else 0
        out[i, 6] = 1 if k == 0 else 2 if k == len(filled) - 1 else 3 if k == 1 else 0
        out[i, 7] = min(2, seen[i])
        open_before = bool(before) and before[-1] not in ".!?:" and len(before) > 0.5 * longest
        out[i, 8] = (2 if after[:1].islower() else 1) if open_before and not s[0].islower() else 3 if s[0].islower() else 0
        out[i, 9] = int(bool(NUMBERED.match(s)) and len(words) <= 7)
        out[i, 10] = (1 if i and not texts[i - 1] else 0) + (2 if i + 1 < n and not texts[i + 1] else 0)
        out[i, 12] = int(not open_before and after[:1].islower() and s[-1] not in ".!?:")
        out[i, 11] = 1 if s[0] == "|" and s.count("|") > 2 or s in "↓→▼" or "->" in s or "→" in s else 0
    return out


#: Values of each feature.
SIZES = [6, 4, 5, 4, 5, 4, 4, 3, 4, 2, 4, 2, 2]
OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))
STATES = len(LABELS)
WIDTH = int(OFFSETS[-1])


def first_labels(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rules that the estimation starts from; the pages' lines stand one after another, ``sizes`` lines each."""
    y = np.full(len(x), BODY)
    if not len(x):
        return y
    starts = np.cumsum(sizes) - sizes
    several = np.repeat(np.add.reduceat((x[:, 0] != 5).astype(np.int64), starts) > 1, sizes)
    header = (x[:, 9] == 0) & (x[:, 2] != 1) & ((x[:, 4] >= 3) | ((x[:, 4] >= 1) & (x[:, 5] > 0) & (x[:, 7] > 0)))
    y[header & several & (x[:, 1] == 0)] = HEADER
    y[(x[:, 9] == 1) & (x[:, 2] == 0)] = HEADING
    y[((x[:, 1] == 1) | (x[:, 1] == 2)) & several] = PAGE_NO
    y[x[:, 11] == 1] = TABLE
    y[x[:, 0] == 5] = BREAK
    return y


def viterbi(x: np.ndarray, sizes: np.ndarray, model: np.ndarray | None) -> np.ndarray:
    """Best labels of the lines of several pages, line by line for all pages together; the first rules without a model."""
    if model is None or not len(x):
        return first_labels(x, sizes)
    emit = model[:, STATES + 1 :].T
    score = np.zeros((len(x), STATES))
    for f in range(len(SIZES)):
        score += emit[OFFSETS[f] + x[:, f]]
    starts = np.cumsum(sizes) - sizes
    blank = x[:, 0] == 5
    score[~blank, BREAK] = -1e9
    score[blank] = -1e9
    score[blank, BREAK] = 0.0
    plain = (x[:, 4] <= 2) & ((x[:, 5] == 0) | (x[:, 5] == 3))
    score[(x[:, 11] == 1) | (x[:, 12] == 1) & plain, HEADER] = -1e9  # tables, diagrams and plain lines that go on in the next are none
    single = np.repeat(np.add.reduceat((~blank).astype(np.int64), starts) <= 1, sizes)
    score[np.ix_(single, [HEADER, PAGE_NO])] = -1e9
    step = model[:, 1 : STATES + 1]
    order = np.argsort(-sizes, kind="stable")  # at every line the pages that are long enough stand first
    first, length = starts[order], sizes[order]
    best = model[:, 0] + score[first]
    back = np.zeros((len(x), STATES), np.int8)
    for i in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -i, side="left"))
        total = best[:live, :, None] + step
        back[first[:live] + i] = total.argmax(axis=1)
        best[:live] = total.max(axis=1) + score[first[:live] + i]
    y = np.zeros(len(x), np.int64)
    y[first + length - 1] = best.argmax(axis=1)
    for i in range(int(length[0]) - 1, 0, -1):
        at = first[: int(np.searchsorted(-length, -i, side="left"))] + i
        y[at - 1] = back[at, y[at]]
    return y


def tally(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, into: np.ndarray) -> None:
    """Add the start, transition and emission counts of several pages."""
    if not len(y):
        return
    starts = np.cumsum(sizes) - sizes
    into[:, 0] += np.bincount(y[starts], minlength=STATES)
    later = np.ones(len(y), bool)
    later[starts] = False
    at = np.flatnonzero(later)
    into[:, 1 : STATES + 1] += np.bincount(y[at - 1] * STATES + y[at], minlength=STATES * STATES).reshape(STATES, STATES)
    for f, n in enumerate(SIZES):
        part = slice(STATES + 1 + OFFSETS[f], STATES + 1 + OFFSETS[f + 1])
        into[:, part] += np.bincount(y * n + x[:, f], minlength=STATES * n).reshape(STATES, n)


def unpack(raw: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(features of all lines, lines of every page) of packed pages."""
    sizes = np.array([len(r) // len(SIZES) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.int8).astype(np.int64).reshape(-1, len(SIZES)), sizes


def estimate(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the smoothed probabilities."""
    model = counts + SMOOTHING
    out = np.zeros_like(model)
    out[:, 0] = np.log(model[:, 0] / model[:, 0].sum())
    out[:, 1 : STATES + 1] = np.log(model[:, 1 : STATES + 1] / model[:, 1 : STATES + 1].sum(axis=1, keepdims=True))
    for f in range(len(SIZES)):
        part = slice(STATES + 1 + OFFSETS[f], STATES + 1 + OFFSETS[f + 1])
        out[:, part] = np.log(model[:, part] / model[:, part].sum(axis=1, keepdims=True))
    return out


# ---------------------------------------------------------------------------------------------- words

EDGE = ".,;:!?\"'“”„…»«’"
NOT_A_WORD = re.compile(r"[\[\]{}/\\=<>@#%&+*~^_]|://|^\W*\d[\d.,:\-/]*\W*$|^[A-Z]{2,}-?\d")


@lru_cache(maxsize=1 << 18)
def core(token: str) -> str | None:
    """The word in a token, in the form words are counted in; None if the token is no word."""
    w = token.strip(EDGE)
    if w.startswith("(") and ")" in w or w.endswith(")"):
        w = w.strip("()").strip(EDGE)
    if len(w) < 2 or NOT_A_WORD.search(w) or not any(c.isalpha() for c in w):
        return None
    if not w.isupper():
        w = w[0] + w[1:].replace("I", "|")  # a capital inside a word is a tall stroke
    return w.lower()


_PLAIN = re.compile(r"^[a-z]+(?:['’\-][a-z]+)*$")


def corrections(word: str) -> list[tuple[str, int]]:
    """(what the word may stand for, place of its first misread character)."""
    out: dict[str, int] = {}
    glyph, first, odd = [], -1, False
    for i, c in enumerate(word):
        d = GLYPHS.get(c) or LIGATURES.get(c)
        if d is None:
            e = unicodedata.normalize("NFD", c)
            d = e[0] if len(e) > 1 and e[0].isalpha() else c
        if d != c:
            odd = True
            if first < 0:
                first = i
        glyph.append(d)
    plain = "".join(glyph)
    if odd and _PLAIN.match(plain):
        out[plain] = first
        for a, b in (("l", "i"), ("e", "c")):  # a stroke may be either letter
            for i, (c, d) in enumerate(zip(word, glyph)):
                if c in "1|!" and d == a:
                    out.setdefault("".join(glyph[:i]) + b + "".join(glyph[i + 1 :]), first)
    if not _PLAIN.match(plain):
        return sorted(out.items())
    if len(plain) >= 3:
        for a, b in CONFUSIONS:
            at = plain.find(a)
            while at >= 0:
                out.setdefault(plain[:at] + b + plain[at + len(a) :], min(first, at) if first >= 0 else at)
                at = plain.find(a, at + 1)
    out.pop(word, None)
    return sorted(out.items())


def words_of(lines: list[str], labels: np.ndarray) -> list[tuple[int, int, int, str, str | None]]:
    """(line, line of the rest, length of the first part, word, hyphenated form) of the words of body and headings.

    Only words broken over lines have a hyphenated form; then the lines differ.
    """
    out: list[tuple[int, int, int, str, str | None]] = []
    text = [i for i in range(len(lines)) if labels[i] in (BODY, HEADING)]
    taken: set[int] = set()  # lines whose first token belongs to the line before
    for k, i in enumerate(text):
        tokens = lines[i].split()
        if i in taken:
            tokens = tokens[1:]
        if not tokens:
            continue
        last = tokens[-1]
        nxt = text[k + 1] if k + 1 < len(text) else -1
        stem = last[:-1]
        if (
            last[-1] in HYPHENS and stem and stem[-1].isalpha() | (stem[-1] in GLYPHS) and nxt >= 0 and labels[i] == BODY == labels[nxt]
            and not any(labels[j] == BREAK for j in range(i + 1, nxt)) and (head := lines[nxt].split()) and (head[0][0].islower() or head[0][0] in GLYPHS and any(c.isalpha() for c in head[0]))
        ):
            left, right = stem.lstrip(EDGE), head[0]
            whole, split = core(left + right), core(left + "-" + right)
            if whole and split:
                taken.add(nxt)
                out.append((i, nxt, len(left), whole, split))
                tokens = tokens[:-1]
        for t in tokens:
            if (w := core(t)) is not None:
                out.append((i, i, 0, w, None))
    return out


# ---------------------------------------------------------------------------------------------- Spark


def label_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, lines ARRAY<STRING>, labels ARRAY<INT>) of every page, by the model estimated on all pages."""
    kind = df.schema[key].dataType.simpleString()
    pages = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    pages = cut_lineage(spread(pages, "k").groupBy("k").agg(F.min("t").alias("t")))

    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, xxhash.xxh64_intdigest(m) - (1 << 63)) for k, t in zip(pdf["k"], pdf["t"]) for i, s in enumerate(t.split("\n")) if (e := s.strip()) and e[-1] not in ".!?" and len(m := mask(s)) > 5]
            yield pd.DataFrame(rows, columns=["k", "i", "m"])

    lines = pages.mapInPandas(masked, f"k {kind}, i int, m bigint")
    shared = lines.groupBy("m").agg(F.count_distinct("k").alias("n")).where("n > 1")
    seen = lines.join(shared, "m").groupBy("k").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("i", F.least(F.col("n") - 1, F.lit(9)).cast("int"))))).alias("seen"))
    pages = pages.join(seen, "k", "left")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, s in zip(pdf["k"], pdf["t"], pdf["seen"]):
                ls = t.split("\n")
                s = dict(s) if s is not None else {}
                rows.append((k, ls, layout(ls, [s.get(i, 0) for i in range(len(ls))]).astype(np.int8).tobytes()))
            yield pd.DataFrame(rows, columns=["k", "lines", "x"])

    pages = cut_lineage(pages.mapInPandas(features, f"k {kind}, lines array<string>, x binary"))
    model = None
    for _ in range(ROUNDS + 1):
        current = model

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((STATES, 1 + STATES + WIDTH))
            for pdf in batches:
                if len(pdf):
                    x, sizes = unpack(pdf["x"])
                    tally(x, sizes, viterbi(x, sizes, current), total)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"slot": at, "n": total.ravel()[at]})

        sums = pages.select("x").mapInPandas(count, "slot bigint, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(STATES * (1 + STATES + WIDTH))
        counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
        model = estimate(counts.reshape(STATES, -1))

    final = model

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, sizes = unpack(pdf["x"])
                labels = np.split(viterbi(x, sizes, final).astype(np.int32), np.cumsum(sizes)[:-1])
                yield pd.DataFrame({"k": pdf["k"], "lines": pdf["lines"], "labels": labels})

    return cut_lineage(pages.mapInPandas(decode, f"k {kind}, lines array<string>, labels array<int>"))


def filter_bits(word: str, bits: int) -> tuple[int, int]:
    """The two places of a word in a table of ``bits`` bits, as Spark's xxhash64 gives them."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h & (bits - 1), h >> 32 & (bits - 1)


def word_filter(words: DataFrame) -> np.ndarray:
    """Bit table that holds every ``word`` of a table and few others; 16 bits a word, FILTER_BITS at most."""
    n = words.count()
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    h = F.xxhash64("word")
    mask = F.lit(bits - 1)
    at = words.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("at"))
    blocks = at.groupBy(F.shiftright("at", 5).cast("int").alias("b")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("w")).toPandas()
    table = np.zeros(bits >> 5, np.uint32)
    table[blocks["b"].to_numpy()] = blocks["w"].to_numpy().astype(np.uint32)
    return table


def _word_noise(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(breaks (k, i, j, word), misread (k, i, j, line, word, right)): broken and misread words by line, counted from 0."""
    kind = pages.schema["k"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for ls, y in zip(pdf["lines"], pdf["labels"]):
                for _, _, _, word, split in words_of(list(ls), y):
                    seen[word, split] += 1
            yield pd.DataFrame([(w, s, n) for (w, s), n in seen.items()], columns=["word", "split", "n"])

    # per batch one row of each word; those of broken words carry their hyphenated form
    tokens = cut_lineage(pages.select("lines", "labels").mapInPandas(count, "word string, split string, n bigint"))
    counts = cut_lineage(tokens.where("split IS NULL").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = tokens.where("split IS NOT NULL").select("word", "split").distinct()
    forms = tokens.select("word").union(pairs.select("split")).distinct()

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(w, c, p) for w in pdf["word"] for c, p in corrections(w)], columns=["word", "right", "place"])

    proposed = forms.mapInPandas(propose, "word string, right string, place int")
    judged = proposed.join(counts.toDF("right", "nr"), "right").join(counts, "word", "left").fillna(0, ["n"])
    judged = judged.where((F.col("nr") >= LEAST) & (F.col("nr") >= RATIO * F.greatest("n", F.lit(1))))
    best = judged.groupBy("word").agg(F.max(F.struct("nr", "right", "place")).alias("b"))
    best = cut_lineage(best.select("word", F.col("b.nr").alias("nr"), F.col("b.right").alias("right"), F.col("b.place").alias("place")))

    known = counts.join(best.select("word", "nr"), "word", "full").select("word", F.coalesce("nr", "n").alias("n"))
    pairs = pairs.join(known.toDF("word", "nw"), "word", "left").join(known.toDF("split", "ns"), "split", "left").fillna(0, ["nw", "ns"])
    # no noise where it is written with its hyphen elsewhere, and more often than without (misread forms count as what they stand for)
    pairs = pairs.select("word", "split", (F.col("ns") <= F.col("nw")).alias("noise"))
    shared = pages.sparkSession.sparkContext.broadcast(word_filter(best))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        bits = len(table) << 5
        known: dict[str, bool] = {}
        for pdf in batches:
            rows = []
            if len(known) > 300_000:
                known.clear()
            for k, ls, y in zip(pdf["k"], pdf["lines"], pdf["labels"]):
                for w in words_of(list(ls), y):
                    may = known.get(w[3])
                    if may is None:
                        a, b = filter_bits(w[3], bits)
                        may = known[w[3]] = bool(table[a >> 5] >> (a & 31) & 1 and table[b >> 5] >> (b & 31) & 1)
                    if may or w[4] is not None:
                        rows.append((k, *w))
            yield pd.DataFrame(rows, columns=["k", "i", "j", "part", "word", "split"])

    found = cut_lineage(pages.mapInPandas(places, f"k {kind}, i int, j int, part int, word string, split string"))
    broken = found.where("split IS NOT NULL").join(pairs, ["word", "split"])
    broken = cut_lineage(broken.select("k", "i", "j", "part", F.when(F.col("noise"), F.col("word")).otherwise(F.col("split")).alias("word"), "noise"))
    suspects = found.where("split IS NULL").select("k", "i", "j", "part", "word").union(broken.select("k", "i", "j", "part", "word"))
    wrong = suspects.join(best, "word")
    line = F.when((F.col("i") == F.col("j")) | (F.col("place") < F.col("part")), F.col("i")).otherwise(F.col("j"))
    return broken.where("noise").select("k", "i", "j", "word"), wrong.select("k", "i", "j", line.alias("line"), "word", "right")


def find_noise(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no BIGINT from 1, noise_kind STRING): distinct spoiled lines; see the module for the defined cases."""
    pages = label_lines(df, key, text)
    breaks, wrong = _word_noise(pages)
    marked = pages.select("k", F.posexplode("labels").alias("i", "y")).where(F.col("y").isin(HEADER, PAGE_NO))
    marked = marked.select("k", "i", F.when(F.col("y") == HEADER, "header").otherwise("page_no").alias("noise_kind"))
    found = marked.union(breaks.select("k", "i", F.lit("hyphen"))).union(wrong.select("k", "line", F.lit("misread")))
    return found.select(F.col("k").alias(key), (F.col("i") + 1).cast("bigint").alias("line_no"), "noise_kind").distinct()


def _same_case(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def paragraphs(lines: list[str], labels: list[int], fix: dict[str, str], joined: set[int]) -> str:
    """The repaired text of a page; ``joined``: body lines whose last word goes on in the next one without its hyphen."""
    out: list[str] = []
    open_end = ""  # "", "space" or "word"
    for i, s in enumerate(lines):
        y = labels[i]
        s = s.strip()
        if y in (HEADER, PAGE_NO):
            continue
        if y == BREAK:
            open_end = ""
            continue
        body = s[:-1] if i in joined else s
        tail = "word" if i in joined or (s and s[-1] in "-‐" and y == BODY) else "space"
        if y == BODY and open_end and out:
            out[-1] += ("" if open_end == "word" else " ") + body
        elif y == TABLE and open_end == "table":
            out[-1] += "\n" + body
        else:
            out.append(body)
        open_end = tail if y == BODY else "table" if y == TABLE else ""

    def mend(m: re.Match) -> str:
        token = m.group()
        w = core(token)
        if w is None or w not in fix:
            return token
        bare = token.strip(EDGE)
        start = token.find(bare)
        return token[:start] + _same_case(bare, fix[w]) + token[start + len(bare) :]

    return "\n\n".join(re.sub(r"\S+", mend, p) for p in out)


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text STRING): every page as continuous paragraphs; see the module for the defined cases."""
    kind = df.schema[key].dataType.simpleString()
    pages = label_lines(df, key, text)
    breaks, wrong = _word_noise(pages)
    fixes = wrong.groupBy("k").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("fix"))
    cuts = breaks.groupBy("k").agg(F.collect_set("i").alias("joined"))
    rows = pages.join(fixes, "k", "left").join(cuts, "k", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [
                paragraphs(list(ls), list(y), dict(f) if f is not None else {}, set(j) if j is not None else set())
                for ls, y, f, j in zip(pdf["lines"], pdf["labels"], pdf["fix"], pdf["joined"])
            ]
            yield pd.DataFrame({"k": pdf["k"], "text": texts})

    return rows.select("k", "lines", "labels", "fix", "joined").mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)
