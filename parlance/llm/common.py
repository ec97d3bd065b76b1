"""What the operators of this package share."""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.session import scratch

#: A word is a maximal run of anything but ASCII white space (a Java pattern).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def by_value(module: str) -> None:
    """Send a module's functions to tasks by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write rows once to the folder all executors share and read them back: cuts the lineage."""
    spark = rows.sparkSession
    path = scratch(spark, f"llm-{label}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def aside(docs: DataFrame, taken) -> tuple[DataFrame, list]:
    """``docs`` with columns named like one of ``taken`` renamed, and what selects all columns under
    their own names again.  Names are compared as Spark does, without case; ``docs`` without such
    columns come back as they are."""
    held = {c.lower() for c in [*docs.columns, *taken]}
    moved = {}
    for c in docs.columns:
        if c.lower() in {t.lower() for t in taken}:
            fresh = f"{c}_"
            while fresh.lower() in held:
                fresh += "_"
            held.add(fresh.lower())
            moved[c] = fresh
    back = [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(moved) if moved else docs, back


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns that an operator adds under these names."""
    clash = [c for c in docs.columns if c.lower() in {n.lower() for n in names}]
    return docs.drop(*clash) if clash else docs


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def block_count(docs: DataFrame, block_bytes: int, text: str = "text") -> int:
    """How many blocks of about ``block_bytes`` the texts fill (one number reaches the driver)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def numbered(rows: DataFrame, order: list[str], keys: list[str] | None = None, label: str = "numbered") -> DataFrame:
    """``rows`` with ``pos``, the place from 0 among rows of equal ``keys`` in ascending ``order``, and
    ``count``, how many there are.  Nulls come first.

    The rows are range-sorted and written with their partition and place in it; a key's place is
    shifted by the counts of earlier partitions, one row per key and partition.  No key, however
    frequent, is ordered in one task, provided ``order`` tells its rows apart.
    """
    keys = keys or []
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    laid = stored(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()),
        label,
    ).withColumn("__part", F.shiftright("__at", 33))
    parts = laid.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *[F.col(c).alias(f"__{c}") for c in keys],
        F.col("__part").alias("__p"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(whole).alias("count"),
    )
    same = F.col("__part") == F.col("__p")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return laid.join(starts, same).withColumn("pos", F.col("__at") + F.col("__shift")).select(*rows.columns, "pos", "count")
