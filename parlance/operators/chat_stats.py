"""Per-chat statistics over messages.

Every result is a frame with one row per (chat, participant, ...).  Raw rows are only ever grouped
with partial aggregation or cut into time slots (see plans.ordered).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import emoji as E
from parlance.functions.dates import HOUR, epoch_seconds
from parlance.functions.text import tokens, word_count
from parlance.operators.participants import from_rows
from parlance.plans.ordered import nearest
from parlance.plans.topk import top_n
from parlance.schema import KEYS


def zero_fill(people: DataFrame, stats: DataFrame, keys: Sequence[str], **fill) -> DataFrame:
    """One row per participant, with defaults where ``stats`` has none.  ``stats`` is keyed by
    ``keys, participant``."""
    joined = people.select(*keys, "participant").join(stats, [*keys, "participant"], "left")
    for name, default in fill.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return joined


def _appearance() -> Column:
    """(ts, seq) as one number with room for a position, so that a running minimum is a plain
    fixed-width aggregate instead of a sort of every token.  Rows without a time come after all
    others, in the order of ``seq``."""
    seconds = F.coalesce(epoch_seconds("ts"), F.lit(10**13))
    at = seconds.cast("decimal(38,0)") * F.lit(Decimal(10) ** 24)
    row = F.col("seq").cast("decimal(14,0)") * F.lit(Decimal(10) ** 9)
    return (at + row).cast("decimal(38,0)")


def top_words(
    messages: DataFrame, n: int = 10, min_len: int = 3, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Most frequent words per chat; ties go to the word seen first.

    A token counts if it has at least ``min_len`` characters and is no emoji; punctuation goes
    afterwards, so the counted word may be shorter or empty.
    """
    words = (
        messages.where(F.col("content") != "")
        .select(*keys, "content", _appearance().alias("_row"))
        .select(
            *keys, "_row", F.posexplode(tokens(F.lower("content"))).alias("_pos", "_token")
        )
        .where((F.length("_token") >= min_len) & ~E.is_item(F.col("_token")))
        .select(
            *keys,
            F.regexp_replace("_token", "[^A-Za-z0-9]+", "").alias("word"),
            (F.col("_row") + F.col("_pos")).cast("decimal(38,0)").alias("_seen"),
        )
    )
    counts = words.groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("n"), F.min("_seen").alias("_seen")
    )
    return top_n(counts, n, keys, [F.desc("n"), F.asc("_seen")]).drop("_seen")


def first_texter(messages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """On how many days each sender wrote first."""
    firsts = (
        messages.where(F.col("ts").isNotNull())
        .groupBy(*keys, F.col("ts").cast("date").alias("_date"))
        .agg(F.min_by("sender", F.struct("ts", "seq")).alias("sender"))
    )
    return firsts.groupBy(*keys, "sender").agg(F.count(F.lit(1)).alias("days"))


def avg_message_length(messages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean number of words per message; messages without content do not count."""
    return messages.groupBy(*keys, "sender").agg(
        F.avg(word_count(F.col("content"))).alias("avg_words")
    )


def length_order() -> Column:
    """Words, then early, then first in the file, as one number: a plain fixed-width maximum."""
    words = word_count(F.col("content")).cast("decimal(38,0)") * F.lit(Decimal(10) ** 26)
    late = (F.lit(10**12) - F.coalesce(epoch_seconds("ts"), F.lit(10**12))).cast("decimal(38,0)")
    last = F.lit(10**14 - 1) - F.col("seq")
    return (words + late * F.lit(Decimal(10) ** 14) + last).cast("decimal(38,0)")


def longest_of(best: DataFrame, messages: DataFrame, people: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The messages behind the largest ``_order`` of each participant."""
    best = best.select(
        *keys, "participant",
        (F.lit(10**14 - 1) - F.pmod("_order", F.lit(Decimal(10) ** 14))).cast("bigint").alias("seq"),
    )
    said = messages.where(F.col("content").isNotNull())
    found = best.join(
        said.select(*keys, "seq", "content", word_count(F.col("content")).alias("length"), "ts"), [*keys, "seq"]
    )
    return zero_fill(people, found, keys).select(*keys, "participant", "content", "length", "ts")


def longest_message(
    messages: DataFrame, people: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Longest message in words per participant, the earliest of equals."""
    said = messages.where(F.col("content").isNotNull())
    best = said.select(*keys, F.col("sender").alias("participant"), length_order().alias("_order"))
    best = best.groupBy(*keys, "participant").agg(F.max("_order").alias("_order"))
    return longest_of(best, messages, people if people is not None else from_rows(messages, keys), keys)


def active_hours(messages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Messages per hour of day; empty hours are absent."""
    timed = messages.where(F.col("ts").isNotNull())
    return timed.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def reply_gaps(
    messages: DataFrame,
    threshold_minutes: int = 480,
    keys: Sequence[str] = KEYS,
    span: int = HOUR,
) -> DataFrame:
    """``keys, participant, seconds``: the time until somebody else answered, credited to the
    participant who was answered.  Longer gaps than the threshold are no replies."""
    rows = messages.where(F.col("ts").isNotNull()).select(*keys, "ts", "seq", "sender")
    before = nearest(rows, keys, F.struct("sender", "ts"), "_before", span=span)
    gap = epoch_seconds("ts") - epoch_seconds("_before.ts")
    return before.where(
        (F.col("_before.sender") != F.col("sender")) & (gap <= threshold_minutes * 60)
    ).select(*keys, F.col("_before.sender").alias("participant"), gap.alias("seconds"))


def reply_time(
    messages: DataFrame,
    people: DataFrame | None = None,
    threshold_minutes: int = 480,
    keys: Sequence[str] = KEYS,
    span: int = HOUR,
) -> DataFrame:
    """Mean minutes until a participant is answered; null without any answer.

    ``span`` is the width in seconds of the slots a chat is ordered in (see plans.ordered).
    """
    stats = reply_gaps(messages, threshold_minutes, keys, span).groupBy(*keys, "participant").agg(
        (F.sum("seconds") / F.count("seconds") / 60).alias("avg_reply_minutes")
    )
    people = people if people is not None else from_rows(messages, keys)
    return zero_fill(people, stats, keys)


def _emoji_counts(messages: DataFrame, group: Sequence[str]) -> DataFrame:
    rows = messages.where(F.col("content") != "").select(
        *group, "content", _appearance().alias("_row")
    )
    found = rows.select(
        *group, "_row", F.posexplode(E.items(F.col("content"))).alias("_pos", "emoji")
    )
    return found.groupBy(*group, "emoji").agg(
        F.count(F.lit(1)).alias("n"),
        F.min((F.col("_row") + F.col("_pos")).cast("decimal(38,0)")).alias("_seen"),
    )


def top_emojis(messages: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most used emojis per chat; every occurrence counts, ties go to the one seen first."""
    counts = _emoji_counts(messages, list(keys))
    return top_n(counts, n, keys, [F.desc("n"), F.asc("_seen")]).drop("_seen")


def with_absent(stats: DataFrame, people: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Participants that ``stats`` (by sender) lacks, with a count of 0 and nothing to count."""
    if people is None:
        return stats
    everyone = people.select(*keys, F.col("participant").alias("sender"))
    full = everyone.join(stats, [*keys, "sender"], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0))).select(*stats.columns)


def top_emojis_by_sender(
    messages: DataFrame, n: int = 10, keys: Sequence[str] = KEYS, people: DataFrame | None = None
) -> DataFrame:
    """As top_emojis per sender; with ``people`` those without emojis get a row without one."""
    group = [*keys, "sender"]
    counts = _emoji_counts(messages, group)
    best = top_n(counts, n, group, [F.desc("n"), F.asc("_seen")]).drop("_seen")
    return with_absent(best, people, keys)


def media_stats(
    messages: DataFrame, keys: Sequence[str] = KEYS, people: DataFrame | None = None
) -> DataFrame:
    """Messages per sender and type, for every type but text; with ``people`` those who sent none
    get a row without a type."""
    counts = (
        messages.where(F.col("type") != "text")
        .groupBy(*keys, "sender", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return with_absent(counts, people, keys)


def media_table(
    messages: DataFrame, people: DataFrame, types: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Wide form of media_stats: one row per participant, one column per type, zero-filled."""
    wide = (
        messages.where(F.col("type") != "text")
        .groupBy(*keys, F.col("sender").alias("participant"))
        .agg(*[F.count_if(F.col("type") == t).alias(t) for t in types])
    )
    return zero_fill(people, wide, keys, **{t: 0 for t in types})
