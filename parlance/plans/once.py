"""Keep a costly expression from being copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Filters on a plain computed column are pushed below it by copying its expression, and the next
    one copies the copies; a chain of pattern matches then runs each pattern dozens of times.  No
    filter passes an explode, here of exactly one element.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
