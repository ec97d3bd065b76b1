"""Who takes part in a chat, and who a message goes to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip
from parlance.plans.blocks import attach
from parlance.plans.once import once
from parlance.schema import KEYS

MARKER = "‎"

# Fixed value: the participant pattern of the bracketed export.  Its greedy head makes the last
# bracket of a line count, and lines that are no messages are included.
IOS_PARTICIPANT = r"(?d)^\[.*\] (.+?): .*"


def from_lines(lines: DataFrame, platform: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct participants of raw lines: ``keys, participant``."""
    from parlance.operators.parse import split_android

    if platform == "ios":
        clean = strip(F.replace(F.col("line"), F.lit(MARKER), F.lit("")))
        person = F.regexp_extract(clean, IOS_PARTICIPANT, 1)
        found = once(lines.select(*keys, "line"), "participant", person)
        return found.where("participant <> ''").select(*keys, "participant").distinct()
    if platform == "android":
        return split_android(lines, keys).select(*keys, F.col("sender").alias("participant")).distinct()
    raise ValueError(f"unknown platform {platform!r}")


def from_rows(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct senders of a message, call or scored table: ``keys, participant``."""
    return rows.select(*keys, F.col("sender").alias("participant")).distinct()


def receiver_of(sender: Column, n: Column, first: Column, last: Column) -> Column:
    other = F.when(sender == first, last).otherwise(first)
    return F.when(n > 2, F.lit("group")).when(n == 2, other)


def with_receiver(
    rows: DataFrame,
    people: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    blocks_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``receiver``: ``group`` for more than two participants, the other one for two, null
    below that.  Does not depend on the order of participants."""
    per_chat = people.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("participant").alias("_a"),
        F.max("participant").alias("_b"),
    )
    joined = attach(rows, per_chat, keys, blocks_from=blocks_from)
    receiver = receiver_of(F.col("sender"), F.col("_n"), F.col("_a"), F.col("_b"))
    return joined.withColumn("receiver", receiver).drop("_n", "_a", "_b")
