"""Wording habits: how many messages of a participant contain a phrase of a list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import contains_any
from parlance.operators.chat_stats import zero_fill
from parlance.operators.participants import from_rows
from parlance.resources.phrases import PHRASES
from parlance.schema import KEYS


def phrase_counts(
    messages: DataFrame,
    phrases: Mapping[str, Sequence[str]] = PHRASES,
    people: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One count column per list, all in one pass.  A message counts once per list, however many
    phrases it holds; phrases match as substrings of the lower-cased text."""
    text = F.col("_text")
    stats = (
        messages.where(F.col("content") != "")
        .select(*keys, F.col("sender").alias("participant"), F.lower("content").alias("_text"))
        .groupBy(*keys, "participant")
        .agg(*[F.count_if(contains_any(text, words)).alias(kind) for kind, words in phrases.items()])
    )
    people = people if people is not None else from_rows(messages, keys)
    return zero_fill(people, stats, keys, **{kind: 0 for kind in phrases})


def _one(kind: str, messages: DataFrame, people, keys) -> DataFrame:
    return phrase_counts(messages, {kind: PHRASES[kind]}, people, keys).withColumnRenamed(kind, "n")


def apologies(messages, people=None, keys=KEYS) -> DataFrame:
    return _one("apology", messages, people, keys)


def compliments(messages, people=None, keys=KEYS) -> DataFrame:
    return _one("compliment", messages, people, keys)


def questions(messages, people=None, keys=KEYS) -> DataFrame:
    return _one("questioning", messages, people, keys)


def swearing(messages, people=None, keys=KEYS) -> DataFrame:
    return _one("swearing", messages, people, keys)
