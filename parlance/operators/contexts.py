"""Merge messages into time-bounded conversation contexts.

A participant's context opens with an own message and stays open while the next own message comes
within the threshold.  It holds every message of the chat, whoever sent it, from its first own
message up to the threshold after its last own one; own messages after the first are held twice.
It is closed by the first later message of the chat, which also gives the receiver, or by the end
of the chat.

No step joins all sessions of a chat with all its messages: sessions are listed per slot they touch
and meet only the messages of that slot.  A slot is no wider than the threshold, so a session fills
every slot between its first and last one, and only those two hold messages it does not reach.  The
closing row is the one that follows the last message held, so each message brings its successor's
receiver along.  Windows and the join carry keys only; texts are joined to the outcome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.dates import HOUR, epoch_seconds, shift_minutes, slot
from parlance.plans.ordered import nearest
from parlance.schema import KEYS

SESSION = ("sender", "first_ts", "first_seq", "last_ts")


def sessions(
    messages: DataFrame, threshold: int, keys: Sequence[str] = KEYS, span: int = HOUR
) -> DataFrame:
    """``keys, sender, first_ts, first_seq, last_ts``: runs of own messages without a longer gap.

    A session ends where the next one says its predecessor's last message was, so only session
    starts are ordered per participant: at most one per threshold of time.
    """
    own = [*keys, "sender"]
    rows = messages.select(*own, "ts", "seq")
    before = nearest(rows, own, F.col("ts"), "_before", span=span)
    gap = epoch_seconds("ts") - epoch_seconds("_before")
    starts = before.where(F.col("_before").isNull() | (gap > threshold * 60)).select(
        *own, F.col("ts").alias("first_ts"), F.col("seq").alias("first_seq"), "_before"
    )
    ends = rows.groupBy(*own).agg(F.max("ts").alias("_before"))
    marks = starts.withColumn("_end", F.lit(False)).unionByName(
        ends.withColumn("_end", F.lit(True)), allowMissingColumns=True
    )
    w = Window.partitionBy(*own).orderBy("_end", "first_ts", "first_seq")
    return (
        marks.withColumn("last_ts", F.lead("_before").over(w))
        .where(~F.col("_end"))
        .drop("_before", "_end")
    )


def members(
    messages: DataFrame,
    threshold: int = 60,
    text_column: str = "content",
    dedupe: bool = False,
    keys: Sequence[str] = KEYS,
    span: int | None = None,
) -> DataFrame:
    """Long form: one row per context and message in it, with ``copies`` 1 or 2 and ``_text``.

    This is the form for contexts of any length; ``parts`` and ``merge`` build on it.  ``span`` is
    the width of a slot in seconds, by default an hour or the threshold if that is shorter.
    """
    held = _held(messages, threshold, text_column, dedupe, keys, _width(threshold, span))
    return held.join(_texts(messages, text_column, keys), [*keys, "seq"])


def _width(threshold: int, span: int | None) -> int:
    return span or max(1, min(HOUR, threshold * 60))


def _texts(messages: DataFrame, text_column: str, keys: Sequence[str]) -> DataFrame:
    rows = messages.where(F.col(text_column).isNotNull())
    return rows.select(*keys, "seq", F.col(text_column).alias("_text"))


def _held(messages, threshold, text_column, dedupe, keys, span) -> DataFrame:
    """Members without their texts."""
    usable = F.col(text_column).isNotNull() & F.col("ts").isNotNull()
    rows = messages.where(usable).select(*keys, "seq", "sender", "receiver", "ts")
    reach = shift_minutes(F.col("last_ts"), threshold)
    windows = (
        sessions(rows, threshold, keys, span)
        .withColumn("_reach", reach)
        .withColumn("_hour", F.explode(F.sequence(slot("first_ts", span), slot("_reach", span))))
    )
    said = nearest(
        rows.withColumnRenamed("sender", "_by"), keys, F.struct("receiver"), "_next",
        after=True, slot_column="_hour", span=span,
    )
    first = (F.col("ts") == F.col("first_ts")) & (F.col("seq") == F.col("first_seq"))
    begun = (F.col("ts") > F.col("first_ts")) | (
        (F.col("ts") == F.col("first_ts")) & (F.col("seq") >= F.col("first_seq"))
    )
    twice = (F.col("_by") == F.col("sender")) & ~first & F.lit(not dedupe)
    return (
        said.join(windows, [*keys, "_hour"])
        .where(begun & (F.col("ts") <= F.col("_reach")))
        .withColumn("copies", F.when(twice, 2).otherwise(1))
    )


def parts(held: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Text of each context per slot (joined in order, a context is its full text) and the last
    message held in that slot."""
    text = F.when(F.col("copies") == 2, F.concat_ws(" ", "_text", "_text")).otherwise(F.col("_text"))
    pieces = F.sort_array(F.collect_list(F.struct("ts", "seq", text.alias("text"))))
    return held.groupBy(*keys, *SESSION, "_hour").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("_part"),
        F.max(F.struct("ts", "seq", "receiver", "_next")).alias("_last"),
    )


def merge(
    messages: DataFrame,
    threshold: int = 60,
    text_column: str = "content",
    merged_column: str = "merged_content",
    dedupe: bool = False,
    keys: Sequence[str] = KEYS,
    span: int | None = None,
) -> DataFrame:
    """One row per context whose trimmed text is longer than three characters.

    ``start_ts`` is the participant's last own message; ``end_ts`` equals it unless the chat ended
    first, in which case it is the last message held.
    """
    held = members(messages, threshold, text_column, dedupe, keys, span)
    slices = F.sort_array(F.collect_list(F.struct("_hour", "_part")))
    whole = (
        parts(held, keys)
        .groupBy(*keys, *SESSION)
        .agg(
            F.array_join(F.transform(slices, lambda s: s["_part"]), " ").alias(merged_column),
            F.max("_last").alias("_last"),
        )
        .where(F.length(F.trim(merged_column)) > 3)
    )
    ended = F.col("_last._next").isNull()
    return whole.select(
        *keys, "sender",
        F.when(ended, F.col("_last.receiver")).otherwise(F.col("_last._next.receiver")).alias(
            "receiver"
        ),
        merged_column,
        F.col("last_ts").cast("date").alias("date"),
        F.col("last_ts").alias("start_ts"),
        F.when(ended, F.col("_last.ts")).otherwise(F.col("last_ts")).alias("end_ts"),
    )
