"""Chat exports to ``lines(chat_id, seq, line)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators import workers

MEMBER = "_chat.txt"
#: Bytes that fit a binary cell.
CELL = (1 << 31) - 64
LINES = "chat_id string, seq bigint, line string"


def chat_of_path(path: Column) -> Column:
    """File name without its extension.  Paths are URI-encoded, in which a plus is a plus."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def scan_lines(
    spark: SparkSession, path: str, chat_id: Column | None = None, pattern: str = "*"
) -> DataFrame:
    """Read text exports line by line; ``seq`` is the line number in the file.

    Files are split like any other input, so one huge chat is read by many tasks.  The row id of
    the scan counts up inside a split; the lines of earlier splits of the file are added to it.
    ``chat_id`` may name an expression, such as a partition column; default is the file name.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(path)
    raw = raw.select(
        (chat_id if chat_id is not None else chat_of_path(F.col("_metadata.file_path"))).alias(
            "chat_id"
        ),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = splits.select(
        "_file", "_start",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return raw.join(offsets, ["_file", "_start"]).select(
        "chat_id", (F.col("_id") + F.col("_shift")).alias("seq"), "line"
    )


def unzip(files: DataFrame, member: str = MEMBER, batch_lines: int = 10_000) -> DataFrame:
    """Lines of zipped exports ``(path, content)``.

    The chat is named by the words of the file name from the fourth on.  A zip cannot be split:
    each file is one task's work, read through in bounded batches.
    """
    run = workers.unzip_lines
    return files.select("path", "content").mapInPandas(
        lambda batches: run(batches, member, batch_lines), LINES
    )


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The zips under a file, folder or glob, by file name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)


def scan_zip(spark: SparkSession, path: str, member: str = MEMBER) -> DataFrame:
    """Read zipped exports, a file at a time.  Archives that can't be read have no lines, damaged ones
    those before the damage, see ``unreadable``."""
    return unzip(archives(spark, path).where(F.col("length") < CELL), member)


def unreadable(spark: SparkSession, path: str, member: str = MEMBER) -> DataFrame:
    """``path, reason`` of the zips that ``scan_zip`` has no lines of, or not all."""
    files = archives(spark, path)
    large = files.where(F.col("length") >= CELL).select("path", F.lit("too large").alias("reason"))
    run = workers.unzip_errors
    broken = (
        files.where(F.col("length") < CELL)
        .select("path", "content")
        .mapInPandas(lambda batches: run(batches, member), "path string, reason string")
    )
    return large.unionByName(broken)


def scan(
    spark: SparkSession, path: str, chat_id: Column | None = None, member: str = MEMBER
) -> DataFrame:
    """Lines of all text and zip exports under a file, folder or glob, told apart by file name."""
    texts = scan_lines(spark, path, chat_id, "*.[tT][xX][tT]")
    return texts.unionByName(scan_zip(spark, path, member))
