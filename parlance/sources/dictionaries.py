"""JSON dictionaries as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """``key, phrase`` of a JSON object, both lower-cased; of equal keys the last one counts."""
    pairs = _whole(spark, path).select(
        F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e")
    )
    return (
        pairs.select("pos", F.lower("e.key").alias("key"), F.lower("e.value").alias("phrase"))
        .groupBy("key")
        .agg(F.max_by("phrase", "pos").alias("phrase"))
    )


def phrase_lists(spark: SparkSession, path: str) -> DataFrame:
    """``kind, phrase`` of a JSON object of lists, in file order within a kind."""
    lists = _whole(spark, path).select(
        F.explode(F.from_json("value", "map<string,array<string>>")).alias("kind", "phrases")
    )
    return lists.select("kind", F.posexplode("phrases").alias("pos", "phrase"))
