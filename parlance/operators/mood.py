"""Statistics over scored contexts: ``sentiment`` label, ``emotion`` map, ``toxicity`` struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.dates import monday_week, sunday_week_label
from parlance.operators.chat_stats import zero_fill
from parlance.operators.participants import from_rows
from parlance.plans.topk import top_n
from parlance.schema import (
    EMOTIONS, HATE_EMOTIONS, KEYS, LOVE_EMOTIONS, MOOD_BINS, SENTIMENTS, TOXICITY_BINS,
)

FLOOR = 0.001


def sentiment_value(label: Column) -> Column:
    """-2 .. 2; null for an unknown label."""
    table = F.create_map(*[F.lit(x) for pair in SENTIMENTS.items() for x in pair])
    return F.try_element_at(table, label)


def toxicity_score(toxicity: Column) -> Column:
    return F.coalesce(toxicity["score"], F.lit(0.0))


def toxicity_type(toxicity: Column) -> Column:
    return toxicity["type"]


def emotions_str(emotion: Column) -> Column:
    """Names of the emotions above the floor, joined by a comma."""
    return F.array_join(F.map_keys(F.map_filter(emotion, lambda _, v: v > FLOOR)), ", ")


def hits(names: Sequence[str]) -> Column:
    """How many of the named emotions are above the floor."""
    present = (F.when(F.try_element_at("emotion", F.lit(name)) > FLOOR, 1).otherwise(0) for name in names)
    return sum(present, F.lit(0))


def emotion_score(stats: DataFrame, people: DataFrame, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Score and percentage per participant from the sums ``_hits`` over ``n`` contexts."""
    shares = stats.select(
        *keys, "participant", F.col("_hits").alias(f"{kind}_score"),
        F.bround(F.col("_hits") / F.col("n") * 100, 2).alias(f"{kind}_percentage"),
    )
    return zero_fill(people, shares, keys, **{f"{kind}_score": 0, f"{kind}_percentage": 0.0})


def _emotion_score(scored, names, kind, people, keys) -> DataFrame:
    stats = scored.groupBy(*keys, F.col("sender").alias("participant")).agg(
        F.sum(hits(names)).alias("_hits"), F.count(F.lit(1)).alias("n")
    )
    return emotion_score(stats, people if people is not None else from_rows(scored, keys), kind, keys)


def love_score(scored: DataFrame, people=None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Present love emotions per participant, and their number per 100 messages."""
    return _emotion_score(scored, LOVE_EMOTIONS, "love", people, keys)


def hate_score(scored: DataFrame, people=None, keys: Sequence[str] = KEYS) -> DataFrame:
    return _emotion_score(scored, HATE_EMOTIONS, "hate", people, keys)


def sentiment_summary(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contexts per sender and label, with the sender's mean sentiment."""
    value = sentiment_value(F.col("sentiment"))
    counts = scored.groupBy(*keys, "sender", "sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    return sender_means(counts, keys)


def sender_means(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per sender and label, with the sender's mean from the sums of all labels."""
    w = Window.partitionBy(*keys, "sender")
    mean = F.sum("_sum").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0))
    return counts.withColumn("mean_sentiment", mean).drop("_sum", "_n")


def mood_trends(scored: DataFrame, window: int = 7, keys: Sequence[str] = KEYS) -> DataFrame:
    """Daily means of sentiment and toxicity, averaged over the last ``window`` days present."""
    daily = scored.groupBy(*keys, "date").agg(
        F.avg(sentiment_value(F.col("sentiment"))).alias("_s"),
        F.avg(toxicity_score(F.col("toxicity"))).alias("_t"),
    )
    return rolling(daily, window, keys)


def rolling(daily: DataFrame, window: int = 7, keys: Sequence[str] = KEYS) -> DataFrame:
    """Daily means _s and _t, averaged over the last ``window`` days present."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    return daily.select(
        *keys, "date",
        F.avg("_s").over(w).alias("sentiment_rolling"),
        F.avg("_t").over(w).alias("toxicity_rolling"),
    )


def emotion_trend_wide(
    scored: DataFrame, labels: Sequence[str] = EMOTIONS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Share of each emotion in the weekly total (Monday weeks), one column per label.

    ``neutral`` takes no part.  An emotion without scores is 0; all are null when the total is 0.
    """
    names = [e for e in labels if e != "neutral"]
    score = {e: F.coalesce(F.try_element_at("emotion", F.lit(e)), F.lit(0.0)) for e in names}
    sums = (
        scored.where(F.col("emotion").isNotNull())
        .groupBy(*keys, monday_week(F.col("date")).alias("week"))
        .agg(*[F.sum(score[e]).alias(e) for e in names])
    )
    total = F.aggregate(F.array(*names), F.lit(0.0), lambda acc, x: acc + x)
    shares = sums.withColumn("_total", F.nullif(total, F.lit(0.0)))
    return shares.select(*keys, "week", *[(F.col(e) / F.col("_total")).alias(e) for e in names])


def emotion_trend(
    scored: DataFrame, labels: Sequence[str] = EMOTIONS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Long form: ``keys, week, emotion, share``."""
    names = [e for e in labels if e != "neutral"]
    wide = emotion_trend_wide(scored, labels, keys)
    return wide.unpivot([*keys, "week"], names, "emotion", "share")


def _bin(x: Column, low: Column, high: Column, labels: Sequence[str]) -> Column:
    """Equal-width bin, closed on the right; the lowest edge is widened by 0.1 % of the range and
    equal limits give the middle bin.  Edges use one fixed order of arithmetic."""
    n = len(labels)
    step = (high - low) / n
    label = F.when(low == high, labels[n // 2])
    label = label.when(
        (x > low - (high - low) * 0.001) & (x <= F.lit(1) * step + low), labels[0]
    )
    for i in range(1, n):
        upper = high if i == n - 1 else F.lit(i + 1) * step + low
        label = label.when((x > F.lit(i) * step + low) & (x <= upper), labels[i])
    return label


def mood_heatmap(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weekly mean sentiment and toxicity (Sunday weeks) as five equal-width bins per chat."""
    weekly = scored.groupBy(*keys, sunday_week_label(F.col("date")).alias("week")).agg(
        F.avg(sentiment_value(F.col("sentiment"))).alias("_s"),
        F.avg(toxicity_score(F.col("toxicity"))).alias("_t"),
    )
    return binned(weekly, keys)


def binned(weekly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weekly means _s and _t as five equal-width bins per chat."""
    limits = weekly.groupBy(*keys).agg(
        F.min("_s").alias("_s0"), F.max("_s").alias("_s1"),
        F.min("_t").alias("_t0"), F.max("_t").alias("_t1"),
    )
    return weekly.join(limits, list(keys)).select(
        *keys, "week",
        _bin(F.col("_s"), F.col("_s0"), F.col("_s1"), MOOD_BINS).alias("sentiment_bin"),
        _bin(F.col("_t"), F.col("_t0"), F.col("_t1"), TOXICITY_BINS).alias("toxicity_bin"),
    )


def toxicity_summary(
    scored: DataFrame, n: int = 10, above: float = 0.5, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The ``n`` most toxic contexts per chat; equals in time order."""
    order = [c for c in ("ts", "start_ts", "date", "src", "seq", "sender") if c in scored.columns]
    rows = scored.withColumn("toxicity_score", toxicity_score(F.col("toxicity"))).withColumn(
        "toxicity_type", toxicity_type(F.col("toxicity"))
    )
    hot = rows.where(F.col("toxicity_score") > above)
    return top_n(hot, n, keys, [F.desc("toxicity_score"), *[F.asc(c) for c in order]])
