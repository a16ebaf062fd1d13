"""Keyword-stuffed and link-list pages (problem 9).

A text becomes a sequence of word classes: each function word of four languages is a class of its own, other
words are classed by their shape (lower case, capital, all capitals, number, address, joined tag), marks by
themselves.  A class-based trigram model is trained on the prose of the corpus itself, that is on all texts with a
usual share of function words and sentence ends: a token costs the bits of its class after the two classes before,
and a word of an open class EMISSION bits more, since it is one of many.  The counts live in hashed tables of fixed
size (TRIGRAMS, BIGRAMS), summed over all documents by Spark, so no more than these tables reaches the driver.

A page is read in windows of WINDOW classes, whose score is the logarithm of their perplexity.  Median and spread of
the scores of all prose pages come from a histogram of fixed size; a window is abnormal if it lies HIGH spreads or
more above the median (bare keywords, tags, menus) or LOW spreads or more below it (lists of addresses: always the
same step).  It is also abnormal if its perplexity under a cache model is low: that model mixes the page's own last
CACHE words (a word that followed the same word there has probability CACHED) with the prose model, and a window of
CACHE_LOW bits a word or less says nothing new (sentences that only repeat a keyword).  A page is flagged when at
least SHARE of its windows are abnormal.

Front matter, comments and heading lines are left out first.  Defined cases: null, empty and blank texts and
texts of fewer than LEAST_WORDS words are no cases; very long texts are read whole; repeated rows of one key
count once; a corpus without any prose flags by the cache model alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import spread
from .pairs import STOPWORDS, WORD

TRIGRAMS, BIGRAMS = 1 << 18, 1 << 16
WINDOW, CACHE, LEAST_WORDS = 24, 160, 15
EMISSION, HIGH, LOW, SHARE = 6.0, 3.25, 5.0, 0.51
CACHED, CACHE_LOW = 0.9, 2.4
SMOOTHING = 0.05
#: Scores of windows are counted in steps of 1 / BINS bit, up to TOP bits.
BINS, TOP = 64, 40

EXTRA = {
    "en": "more than once both two four seven first so they their them into out over between next same may must does did will would should only another other all some few whoever".split(),
    "de": "dem diese dieser als für mindestens wird dann dass noch niemanden jede alle mehr nach beim vom innerhalb unter".split(),
    "fr": "tout tous toute sous dès lors si leurs y en moins plus deux notre vous nos reste a".split(),
    "es": "sea ha han hay todo toda cada salvo junto juntos siguen menos dos nuestro lo dónde hacia".split(),
}
FUNCTION = sorted({w for d in (STOPWORDS, EXTRA) for ws in d.values() for w in ws})
MARKS = [".", ",", "?", "!", ":", ";", "|", "/", "-", "·", "•", ">", "»", "#", "*", "[", "]", "(", ")", "<", '"', "\n"]
SHAPES = ["lower", "capital", "capitals", "number", "address", "tag", "mark", "mixed"]
CLASS = {w: i for i, w in enumerate([*SHAPES, *MARKS, *FUNCTION])}
assert len(CLASS) < 256 * 2
_END = np.array([CLASS["."], CLASS["?"], CLASS["!"]], np.int64)
_FIRST_FUNCTION = len(SHAPES) + len(MARKS)

FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
NOISE = re.compile(r"<!--.*?-->|^\s*#{1,6}\s[^\n]*$|^\[IMAGE:[^\]\n]*\]", re.S | re.M)
TOKEN = re.compile(r"\[[^\]\n]{0,200}\]\([^()\s]{0,400}\)|<a\s[^>]{0,400}>[^<]{0,200}</a>|(?:https?://|www\.)[^\s<>\"\])]+|[#@]?\w+(?:[-_'’.]\w+)*|\n|[^\w\s]")
MEMO: dict[str, int] = {}


def class_of(token: str) -> int:
    """Class of one token."""
    low = token.lower()
    c = CLASS.get(low)
    if c is not None:
        return c
    if low.startswith(("http://", "https://", "www.", "<a ")) or (len(token) > 3 and token[0] == "["):
        return CLASS["address"]
    if token[0] in "#@" or "_" in token or token.count("-") > 2:
        return CLASS["tag"]
    if not token[0].isalnum():
        return CLASS["mark"]
    if any(ch.isdigit() for ch in token):
        return CLASS["number"]
    if token.islower():
        return CLASS["lower"]
    if len(token) > 1 and token.isupper():
        return CLASS["capitals"]
    return CLASS["capital"] if token[0].isupper() else CLASS["mixed"]


def body(text: str) -> str:
    return NOISE.sub("\n", FRONT.sub("", text))


def analyse(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(classes, whether a word pair is new within the last CACHE words) of a text; None for short texts."""
    tokens = TOKEN.findall(body(text))
    if not tokens:
        return None
    memo = MEMO
    known = list(map(memo.get, tokens))
    if None in known:
        if len(memo) > 300_000:
            memo.clear()
        for i, c in enumerate(known):
            if c is None:
                memo[tokens[i]] = known[i] = xxhash.xxh64_intdigest(tokens[i].lower()) >> 10 << 9 & 0x7FFFFFFFFFFFFFFF | class_of(tokens[i])
    both = np.array(known, np.int64)  # the class in the low 9 bits, the word above
    seq = both & 511
    words = np.flatnonzero(~_IS_MARK[seq])
    if len(words) < LEAST_WORDS and (len(seq) < 3 or len(WORD.findall(FRONT.sub("", text))) < LEAST_WORDS):
        return None  # heading lines count as words of the text, though they are not judged
    h = both[words] >> 9
    pairs = h.copy()
    pairs[1:] ^= h[:-1] * 0x9E3779B1
    order = np.argsort(pairs, kind="stable")
    again = (pairs[order][1:] == pairs[order][:-1]) & (np.diff(order) <= CACHE)
    new = np.ones(len(seq), bool)
    new[words[order[1:][again]]] = False
    return seq, new


_IS_MARK = np.zeros(len(CLASS), bool)
_IS_MARK[len(SHAPES) : _FIRST_FUNCTION] = True
_IS_MARK[CLASS["mark"]] = True
_IS_OPEN = np.zeros(len(CLASS), bool)
_IS_OPEN[[CLASS[c] for c in ("lower", "capital", "capitals", "mixed", "tag")]] = True


def _slots(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all trigrams and of their contexts."""
    two = seq[:-2] * 512 + seq[1:-1]
    three = two * 512 + seq[2:]
    return (three * 0x9E3779B1 & 0xFFFFFFFF) >> 14, (two * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def is_prose(seq: np.ndarray) -> bool:
    """Usual shares of function words and sentence ends: what the model is trained on."""
    words = int((~_IS_MARK[seq]).sum())
    ends = int(np.isin(seq, _END).sum())
    return words > 0 and (seq >= _FIRST_FUNCTION).sum() >= 0.22 * words and words / 40 <= ends <= words / 4


def logarithms(trigrams: np.ndarray, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the smoothed counts."""
    return np.log2(trigrams + SMOOTHING), np.log2(bigrams + SMOOTHING * len(CLASS))


def window_scores(seq: np.ndarray, new: np.ndarray, log_three: np.ndarray, log_two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits a class under the prose model, bits a word under the cache model) of each window."""
    three, two = _slots(seq)
    bits = log_two[two] - log_three[three] + EMISSION * _IS_OPEN[seq[2:]]
    edges = np.arange(0, len(bits), WINDOW)
    if len(edges) > 1 and len(bits) - edges[-1] < WINDOW // 2:
        edges = edges[:-1]  # a short rest belongs to the last window
    prose = np.add.reduceat(bits, edges) / np.diff(np.append(edges, len(bits)))
    isw = ~_IS_MARK[seq[2:]]
    mixed = bits - np.log2(1 - CACHED)
    known = np.flatnonzero(~new[2:])
    mixed[known] = -np.log2(np.exp2(-mixed[known]) + CACHED)
    cache = np.add.reduceat(np.where(isw, mixed, 0.0), edges) / np.maximum(np.add.reduceat(isw.astype(np.int64), edges), 1)
    return prose, cache


def usual(counts: np.ndarray) -> tuple[float, float]:
    """(median, spread) of scores counted in steps of 1 / BINS; the spread is that of a normal law with the same 5th and 95th percentiles."""
    total = np.cumsum(counts)
    low, middle, high = ((np.searchsorted(total, q * total[-1]) + 0.5) / BINS for q in (0.05, 0.5, 0.95))
    return float(middle), float(max(high - low, 2.0 / BINS) / 3.29)


def abnormal(prose: np.ndarray, cache: np.ndarray, median: float | None, spread: float) -> np.ndarray:
    """Which windows are abnormal; without a median (no prose to learn from) the cache model decides alone."""
    odd = cache <= CACHE_LOW
    return odd if median is None else odd | (prose >= median + HIGH * spread) | (prose <= median - LOW * spread)


def score_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, windows INT, abnormal DOUBLE, prose_perplexity DOUBLE, cache_perplexity DOUBLE): perplexities are means over the page's windows."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if (r := analyse(t)) is not None:
                    out.append((k, r[0].astype(np.uint16).tobytes(), np.packbits(r[1]).tobytes()))
            yield pd.DataFrame(out, columns=["k", "seq", "new"])

    pages = cut_lineage(spread(rows, "k").mapInPandas(classify, f"k {kind}, seq binary, new binary"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        three, two = np.zeros(TRIGRAMS, np.int64), np.zeros(BIGRAMS, np.int64)
        for pdf in batches:
            for raw in pdf["seq"]:
                seq = np.frombuffer(raw, np.uint16).astype(np.int64)
                if is_prose(seq):
                    a, b = _slots(seq)
                    np.add.at(three, a, 1)
                    np.add.at(two, b, 1)
        for which, counts in ((3, three), (2, two)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"which": np.full(len(at), which, np.int32), "slot": at, "n": counts[at]})

    counts = pages.select("seq").mapInPandas(count, "which int, slot bigint, n bigint").groupBy("which", "slot").agg(F.sum("n").alias("n")).toPandas()
    tables = {3: np.zeros(TRIGRAMS), 2: np.zeros(BIGRAMS)}
    for which, part in counts.groupby("which"):
        tables[which][part["slot"].to_numpy()] = part["n"].to_numpy()
    shared = pages.sparkSession.sparkContext.broadcast(logarithms(tables[3], tables[2]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        three, two = shared.value
        for pdf in batches:
            out = []
            for k, raw, bits in zip(pdf["k"], pdf["seq"], pdf["new"]):
                seq = np.frombuffer(raw, np.uint16).astype(np.int64)
                new = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(seq)].astype(bool)
                prose, cache = window_scores(seq, new, three, two)
                out.append((k, is_prose(seq), prose.astype(np.float32).tobytes(), cache.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["k", "is_prose", "prose", "cache"])

    windows = cut_lineage(pages.mapInPandas(score, f"k {kind}, is_prose boolean, prose binary, cache binary"))

    def spread_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS * TOP, np.int64)
        for pdf in batches:
            scores = np.frombuffer(b"".join(pdf["prose"]), np.float32)
            total += np.bincount(np.minimum((scores * BINS).astype(np.int64), len(total) - 1), minlength=len(total))
        yield pd.DataFrame({"bin": np.flatnonzero(total), "n": total[total > 0]})

    seen = windows.where("is_prose").select("prose").mapInPandas(spread_of, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    histogram = np.zeros(BINS * TOP, np.int64)
    histogram[seen["bin"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    median, deviation = usual(histogram) if histogram.any() else (None, 0.0)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            size = np.array([len(p) // 4 for p in pdf["prose"]], np.int64)
            prose, cache = (np.frombuffer(b"".join(pdf[c]), np.float32).astype(np.float64) for c in ("prose", "cache"))
            first = np.cumsum(size) - size
            mean = lambda x: np.add.reduceat(x, first) / size
            odd = abnormal(prose, cache, median, deviation).astype(np.float64)
            yield pd.DataFrame({"k": pdf["k"], "windows": size.astype(np.int32), "abnormal": mean(odd), "prose_perplexity": np.exp2(mean(prose)), "cache_perplexity": np.exp2(mean(cache))})

    scored = windows.mapInPandas(judge, f"k {kind}, windows int, abnormal double, prose_perplexity double, cache_perplexity double")
    return scored.withColumnRenamed("k", key)


def find_spam(df: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """(key) of every keyword-stuffed or link-list page; see the module for the defined cases."""
    return score_pages(df, key, text).where(F.col("abnormal") >= share).select(key).distinct()
