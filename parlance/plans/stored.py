"""Cut a plan that many statistics share by writing its rows once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parlance.session import scratch


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared scratch folder.

    Lost executors then re-read files instead of recomputing the plan, every reader prunes to its
    columns, and the table can be dropped with the folder when the job is over.
    """
    spark = rows.sparkSession
    path = scratch(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
