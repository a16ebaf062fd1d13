"""Conversations and answer streams as ordered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..models import Chat, complete


def turns(df: DataFrame, key: str, history: str) -> DataFrame:
    """(key, turn, role, content): a history array as rows."""
    return df.select(F.col(key), F.posexplode(history).alias("turn", "m")).select(key, "turn", "m.role", "m.content")


def last_turns(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The last ``k`` non-empty turns of every conversation, in order of ``turn``."""
    w = Window.partitionBy(key).orderBy(F.desc("turn"))
    kept = rows.where(F.coalesce("content", F.lit("")) != "")
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def last_user_message(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``asked``: the nearest earlier message of the user."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def next_id(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, next_id): one more than the greatest number."""
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"))


def prompt_messages(history: Column, system: Column, user: Column, cfg: Settings = DEFAULTS) -> Column:
    """array<struct<role, content>>: the system text, the last turns, the user's block."""
    said = F.coalesce(history, F.array().cast("array<struct<role: string, content: string>>"))
    last = F.when(F.size(said) > cfg.history_turns, F.slice(said, -cfg.history_turns, cfg.history_turns)).otherwise(said)
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", system), last, one("user", user))


def rewrite_prompt(history: Column, question: Column, cfg: Settings = DEFAULTS) -> Column:
    """Prompt for making a question stand alone: the last turns, then the question."""
    said = F.coalesce(history, F.array().cast("array<struct<role: string, content: string>>"))
    last = F.when(F.size(said) > cfg.rewrite_turns, F.slice(said, -cfg.rewrite_turns, cfg.rewrite_turns)).otherwise(said)
    return F.concat(F.array_join(F.transform(last, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), F.lit("\nQuestion: "), question)


def expand_hints(question: Column, hints: Mapping[str, str]) -> Column:
    """A question with the expansions of the phrases it holds behind it; phrases are compared in small letters."""
    found = [F.when(F.contains(F.lower(question), F.lit(phrase.lower())), F.lit(more)) for phrase, more in hints.items()]
    return F.concat_ws(" ", question, *found)


def standalone(history: Column, question: Column, providers: Sequence[tuple[str, Chat]] | None = None, hints: Mapping[str, str] | None = None, cfg: Settings = DEFAULTS) -> Column:
    """A question that stands alone: rewritten by a model when there is one, else put behind the last turns, with the expansions of ``hints``.

    A failing model leaves the question as it is.
    """
    asked = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, rewrite_prompt(history, question, cfg)).otherwise(question)
    if providers:
        asked = F.coalesce(F.nullif(F.trim(complete(asked, providers)["text"]), F.lit("")), question)
    return expand_hints(asked, hints) if hints else asked


def sse_line(kind: Column, text: Column) -> Column:
    """One event of an answer stream."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), text.alias("text"))), F.lit("\n\n"))


def fold_events(events: DataFrame, key: str) -> DataFrame:
    """(key, answer, sources): token texts joined in order, the last sources; lines that are no events do not count."""
    body = F.from_json(F.when(F.col("line").startswith("data: "), F.substring("line", 7, 1 << 30)), "type STRING, text STRING, sources STRING", {"mode": "PERMISSIVE"})
    rows = events.withColumn("e", body).where(F.col("e.type").isNotNull())
    token = F.when(F.col("e.type") == "token", F.struct("seq", F.col("e.text").alias("t")))
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["t"]), "")
    found = F.max_by("e.text", F.when(F.col("e.type") == "sources", F.col("seq")))
    return rows.groupBy(key).agg(answer.alias("answer"), found.alias("sources"))
