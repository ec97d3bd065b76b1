"""Per-chat statistics over calls."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.dates import day_label
from parlance.plans.topk import top_n
from parlance.schema import KEYS, MISSED_CALL_TYPES


def _count(calls: DataFrame, keys, *group) -> DataFrame:
    return calls.groupBy(*keys, *group).agg(F.count(F.lit(1)).alias("n"))


def _date():
    return F.col("ts").cast("date").alias("date")


def avg_call_duration(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean seconds of calls that took place; 0 when none did."""
    took_place = F.when(F.col("duration") > 0, F.col("duration"))
    return calls.groupBy(*keys).agg(
        F.coalesce(F.avg(took_place), F.lit(0.0)).alias("avg_duration")
    )


def call_mode(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most frequent call type, the first in alphabet among equals."""
    ranked = top_n(_count(calls, keys, "type"), 1, keys, [F.desc("n"), F.asc("type")])
    return ranked.select(*keys, "type", "n")


def calls_per_day(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean number of calls over days that have any."""
    return _count(calls, keys, _date()).groupBy(*keys).agg(F.avg("n").alias("avg_calls"))


def call_hours(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _count(calls, keys, F.hour("ts").alias("hour"))


def longest_call(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The whole record of the longest call, the first of equals.

    Duration and order in the file make one number, so that the best is a plain fixed-width maximum;
    its record is joined by ``seq``.  Calls without a duration come last.
    """
    last = F.lit(10**14 - 1) - F.col("seq")
    order = F.coalesce(F.col("duration") + 1, F.lit(0)).cast("decimal(38,0)") * F.lit(Decimal(10) ** 14) + last
    best = calls.groupBy(*keys).agg(F.max(order.cast("decimal(38,0)")).alias("_order"))
    best = best.select(
        *keys, (F.lit(10**14 - 1) - F.pmod("_order", F.lit(Decimal(10) ** 14))).cast("bigint").alias("seq")
    )
    return best.join(calls, [*keys, "seq"]).select(*calls.columns)


def calls_per_sender(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _count(calls, keys, "sender")


def calls_per_type(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _count(calls, keys, "type")


def missed_calls(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Missed and silenced calls per receiver."""
    return _count(calls.where(F.col("type").isin(*MISSED_CALL_TYPES)), keys, "receiver")


def days_without_calls(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Days between the first and the last call that have none."""
    days = calls.select(*keys, _date()).distinct()
    span = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    every = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))
    return every.join(days, [*keys, "date"], "left_anti")


def busiest_call_days(calls: DataFrame, n: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calls per sender on the ``n`` days with most calls, the earlier of equals."""
    per_sender = _count(calls, keys, _date(), "sender")
    per_day = per_sender.groupBy(*keys, "date").agg(F.sum("n").alias("day_calls"))
    top = top_n(per_day, n, keys, [F.desc("day_calls"), F.asc("date")])
    return per_sender.join(top, [*keys, "date"]).withColumn("day", day_label(F.col("date")))
