"""Intermediates and reports: typed Parquet, CSV and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_parquet(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Header, no index; nested values as JSON text.

    CSV has one way to say nothing: an empty text comes back as null.  Parquet and JSON keep the two
    apart.
    """
    flat = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name)
        for f in rows.schema.fields
    ]
    rows.select(*flat).write.mode("overwrite").options(**CSV).option(
        "maxRecordsPerFile", FILE_ROWS
    ).csv(path)


CSV = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
#: A CSV file with line breaks in its texts is read by one task, so files stay small.
FILE_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read what write_csv wrote; nested columns come back with their types."""
    flat = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, NESTED) else f.dataType)
            for f in schema.fields
        ]
    )
    rows = spark.read.schema(flat).options(**CSV).csv(path)
    return rows.select(
        *[
            F.from_json(f.name, f.dataType).alias(f.name)
            if isinstance(f.dataType, NESTED)
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def _by_name(column: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every record in name order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [_by_name(column[f.name], f.dataType).alias(f.name) for f in fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: _by_name(x, kind.elementType))
    return column


def write_json(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """One object per line, fields in name order at every level."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    ordered = rows.select(*[_by_name(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    ordered.write.mode("overwrite").partitionBy(*partition_by).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Processed results as they are: every column a string."""
    return spark.read.options(**CSV).csv(path)
