"""Order-dependent lookups that never put a whole chat into one window group.

A chat may hold a third of all rows, so ``Window.partitionBy(chat)`` over raw rows would leave one
task with all of them.  Rows are cut into cells instead: hours, the minutes of hours that hold more
than ``CROWD`` rows, and in minutes that hold more the single times, cut by ``seq`` into runs of
``CROWD``.  So a burst is split like a long chat, and no cell outgrows that number.  Each cell needs
one value from outside, its neighbour's edge value, which enters it as an extra row.  Only edge values
are ordered per key as a whole: one row per key and cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.dates import HOUR, epoch_micros, slot

#: Rows of a cell.
CROWD = 1 << 16


def celled(rows: DataFrame, keys: Sequence[str], span: int = HOUR, crowd: int | None = None) -> DataFrame:
    """Add the cell (``_at``, ``_run``) of each row and its slot ``_slot``; cells follow one another in the
    order of (ts, seq).

    Minutes are counted per key, and only those of crowded slots are joined back: none, as a rule.
    """
    crowd = crowd or CROWD
    fine = 60 if span % 60 == 0 else 1
    cut = rows.withColumns({"_slot": slot("ts", span), "_fine": slot("ts", fine)})
    counts = cut.groupBy(*keys, "_slot", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    every = F.sum("_n").over(Window.partitionBy(*keys, "_slot"))
    crowded = counts.withColumn("_all", every).where(F.col("_all") > crowd).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col("_fine").alias("_minute"), (F.col("_n") > crowd).alias("_burst"),
    )
    same = F.col("_fine") == F.col("_minute")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    at = F.when(F.col("_burst"), epoch_micros("ts")).when(~F.col("_burst"), F.col("_fine") * (fine * 1_000_000))
    run = F.when(F.col("_burst"), F.floor(F.col("seq") / crowd)).otherwise(F.lit(0))
    placed = cut.join(crowded, same, "left").withColumns(
        {"_at": F.coalesce(at, F.col("_slot") * (span * 1_000_000)), "_run": run.cast("bigint")}
    )
    return placed.select(*rows.columns, "_slot", "_at", "_run")


def nearest(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str,
    *,
    after: bool = False,
    slot_column: str | None = None,
    span: int = HOUR,
    crowd: int | None = None,
) -> DataFrame:
    """Add ``name``: the nearest non-null ``value`` strictly before (``after``: strictly after)
    each row in ``(ts, seq)`` order among the rows with the same keys.

    ``slot_column`` keeps the slot of ``span`` seconds for a later join.  Slots of more than ``crowd``
    rows are ordered in smaller cells (see ``celled``).
    """
    keys = list(keys)
    direction = F.desc if after else F.asc
    earlier = [Window.unboundedPreceding, -1]
    cut = celled(rows.withColumn("_held", value), keys, span, crowd)

    position = F.when(F.col("_held").isNotNull(), F.struct("ts", "seq"))
    edge = (F.min_by if after else F.max_by)("_held", position)
    edges = cut.groupBy(*keys, "_at", "_run").agg(edge.alias("_edge"))
    along = Window.partitionBy(*keys).orderBy(direction("_at"), direction("_run")).rowsBetween(*earlier)
    entering = (
        edges.withColumn("_held", F.last("_edge", ignorenulls=True).over(along))
        .where(F.col("_held").isNotNull())
        .select(*keys, "_at", "_run", "_held", F.lit(True).alias("_enters"))
    )
    stream = cut.withColumn("_enters", F.lit(False)).unionByName(
        entering, allowMissingColumns=True
    )
    inside = (
        Window.partitionBy(*keys, "_at", "_run")
        .orderBy(F.desc("_enters"), direction("ts"), direction("seq"))
        .rowsBetween(*earlier)
    )
    found = (
        stream.withColumn(name, F.last("_held", ignorenulls=True).over(inside))
        .where(~F.col("_enters"))
        .drop("_held", "_enters", "_at", "_run")
    )
    return found.withColumnRenamed("_slot", slot_column) if slot_column else found.drop("_slot")
