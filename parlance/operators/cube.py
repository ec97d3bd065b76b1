"""One pass over a table for all of its plain statistics.

A cube holds counts and sums for several groupings of the same rows at once (grouping sets): the
columns a statistic needs are computed once per row, added up per task and shuffled once, and every
statistic reads its own slice of the small result.  ``slice_of`` names a slice by its columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.dates import sunday_week_label
from parlance.functions.text import contains_any, word_count
from parlance.operators.chat_stats import length_order
from parlance.operators.mood import hits, sentiment_value, toxicity_score
from parlance.resources.phrases import PHRASES
from parlance.schema import HATE_EMOTIONS, KEYS, LOVE_EMOTIONS


def cube(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], sets: Sequence[Sequence[str]], measures: Sequence[Column]
) -> DataFrame:
    """``measures`` for every set of ``columns`` beside ``keys``; other columns are null."""
    every = [*keys, *columns]
    return rows.groupingSets([[*keys, *s] for s in sets], *every).agg(F.grouping_id(*every).alias("_set"), *measures)


def slice_of(table: DataFrame, keys: Sequence[str], columns: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """The rows of a cube that belong to one set of columns."""
    number = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in wanted)
    measures = [c for c in table.columns if c not in (*keys, *columns, "_set")]
    return table.where(F.col("_set") == number).select(*keys, *wanted, *measures)


MESSAGE_COLUMNS = ("sender", "type", "hour")


def message_cube(messages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per sender, per sender and type, per hour: messages, words, messages with content, the longest
    one's order and the messages that hold a phrase of each list."""
    text = F.lower("content")
    narrow = messages.select(
        *keys, "sender", "type", F.hour("ts").alias("hour"),
        word_count(F.col("content")).alias("_words"), F.col("content").isNotNull().alias("_said"),
        F.when(F.col("content").isNotNull(), length_order()).alias("_order"),
        *[contains_any(text, phrases).alias(f"_{kind}") for kind, phrases in PHRASES.items()],
    )
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_said"), F.col("_words"))).alias("words"),
        F.count_if(F.col("_said")).alias("said"),
        F.max("_order").alias("_order"),
        *[F.count_if(F.col(f"_{kind}")).alias(kind) for kind in PHRASES],
    ]
    return cube(narrow, keys, MESSAGE_COLUMNS, [["sender"], ["sender", "type"], ["hour"]], measures)


CALL_COLUMNS = ("sender", "receiver", "type", "hour", "date")


def call_cube(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calls, and seconds and number of those that took place, per chat and in five groupings."""
    narrow = calls.select(
        *keys, "sender", "receiver", "type", F.hour("ts").alias("hour"), F.col("ts").cast("date").alias("date"),
        F.when(F.col("duration") > 0, F.col("duration")).alias("_seconds"),
    )
    measures = [F.count(F.lit(1)).alias("n"), F.sum("_seconds").alias("seconds"), F.count("_seconds").alias("held")]
    sets = [[], ["sender"], ["receiver", "type"], ["type"], ["hour"], ["date"]]
    return cube(narrow, keys, CALL_COLUMNS, sets, measures)


CONTEXT_COLUMNS = ("sender", "sentiment", "date", "week")


def context_cube(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contexts, their sentiment, toxicity and love and hate, per sender, sender and label, day and week."""
    narrow = scored.select(
        *keys, "sender", "sentiment", "date", sunday_week_label(F.col("date")).alias("week"),
        sentiment_value(F.col("sentiment")).alias("_value"), toxicity_score(F.col("toxicity")).alias("_toxic"),
        hits(LOVE_EMOTIONS).alias("_love"), hits(HATE_EMOTIONS).alias("_hate"),
    )
    measures = [
        F.count(F.lit(1)).alias("n"), F.sum("_value").alias("_sum"), F.count("_value").alias("_n"),
        F.sum("_toxic").alias("_toxic"), F.sum("_love").alias("_love"), F.sum("_hate").alias("_hate"),
    ]
    sets = [["sender"], ["sender", "sentiment"], ["date"], ["week"]]
    return cube(narrow, keys, CONTEXT_COLUMNS, sets, measures)
