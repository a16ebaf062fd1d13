"""Boundaries to outside models, with deterministic offline stand-ins.

A provider is a plain function over lists; it runs inside Arrow batches.  ``complete`` tries providers in order
with capped exponential waiting, and reports the error instead of failing the job when asked to.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str], str]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Stand-in: signed hashing of words to ``dim`` numbers, of length 1; a text without words gives zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def extractive_chat(prompt: str) -> str:
    """Stand-in: the first sentence of the prompt's last paragraph."""
    last = prompt.strip().split("\n\n")[-1]
    return re.split(r"(?<=[.!?])\s", last)[0]


def embed_column(df: DataFrame, text: str, out: str, provider: Embedder, *, tries: int = 5, wait: float = 0.0) -> DataFrame:
    """Adds ``out`` ARRAY<DOUBLE>; the provider sees one Arrow batch at a time and is retried before the task fails."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for n in range(tries):
                try:
                    made = provider(["" if x is None else x for x in s])
                    break
                except Exception:
                    if n == tries - 1:
                        raise
                    time.sleep(wait)
            yield pd.Series(made)

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def complete(prompt: Column, providers: Sequence[tuple[str, Chat]], *, retryable: tuple[str, ...] = ("rate limit", "timeout", "connection"), cap: float = 8.0, unit: float = 0.0) -> Column:
    """struct<text, model, error>: the first provider that answers; errors that are not retryable end the chain."""

    @F.pandas_udf("text string, model string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in s:
            row = (None, None, "no provider")
            for i, (name, chat) in enumerate(providers):
                try:
                    row = (chat(p or ""), name, None)
                    break
                except Exception as e:
                    row = (None, None, str(e)[:200])
                    if not any(x in str(e).lower() for x in retryable):
                        break
                    time.sleep(unit * min(2**i, cap))
            rows.append(row)
        return pd.DataFrame(rows, columns=["text", "model", "error"])

    return run.asNondeterministic()(prompt)


Reader = Callable[[bytes], str]


def plain_reader(content: bytes) -> str:
    """Stand-in for a reader of pictures: the text that the bytes hold, empty for others."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return ""


def read_images(content: Column, reader: Reader) -> Column:
    """struct<text, error>: what a reader makes of the bytes of pictures; an error fails the picture, not the job."""

    @F.pandas_udf("text string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for c in s:
            try:
                rows.append((reader(bytes(c)), None) if c is not None else (None, "no content"))
            except Exception as e:
                rows.append((None, str(e)[:200]))
        return pd.DataFrame(rows, columns=["text", "error"])

    return run.asNondeterministic()(content)


def backoff(attempt: Column, cap: float = 8.0) -> Column:
    """Waiting units before an attempt: 1, 2, 4 and so on, ``cap`` at most."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(cap))
