"""Tables that grow when they are exploded are never sent whole to the driver and all tasks."""

import pytest

from parlance.operators import preprocess as P
from parlance.plans import blocks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df, column):
    return [x.strip(" +-:*()0123456789") for x in plan(df).splitlines() if "Join " in x and f"[{column}#" in x]


def words(spark, values):
    return spark.createDataFrame([(w, 1) for w in values], "word string, freq bigint")


@pytest.mark.parametrize("distance", [1, 2])
def test_deletions_are_not_broadcast(spark, distance):
    d = P.stored(words(spark, ["hello", "help", "winter"]), "dictionary")
    unknown = P.stored(words(spark, ["helo", "wintre"]).select("word"), "unknown")
    found = joins(P._closest(unknown, d, distance), "_left")
    assert found and all(x.startswith("SortMergeJoin") for x in found)


def test_stored_words_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 0, "helo winter", "en")], "chat_id long, seq long, content string, language string")
    out = P.correct_text(rows, words(spark, ["hello", "winter"]))
    assert [r["content"] for r in out.collect()] == ["hello winter"]
    assert joins(out, "key") and "BroadcastHashJoin [key#" not in plan(out)


def test_copies_of_a_table_are_not_broadcast(spark):
    rows = spark.createDataFrame([(b, "hot") for b in range(50)], "_block int, key string")
    table = P.stored(spark.createDataFrame([("hot", "cold")], "key string, phrase string"), "table")
    for salts in (1, 2, 16):
        found = blocks.salted_lookup(rows, table, "key", ["_block"], salts=salts, how="inner")
        assert [r["phrase"] for r in found.collect()] == ["cold"] * 50
        assert ("explode" in plan(found)) == (salts > 1) == ("SortMergeJoin" in plan(found))


def test_salts_follow_the_number_of_blocks():
    assert [blocks.salts_of(n) for n in (1, 1 << 16, (1 << 16) + 1, 1 << 20)] == [1, 1, 2, 16]


def test_a_task_holds_few_blocks(spark, monkeypatch):
    """20 blocks of short rows are little to shuffle and would go to one task."""
    from pyspark.sql import functions as F

    from parlance.operators.phrases import map_runs_by_table

    monkeypatch.setattr(blocks, "TASK_BLOCKS", 1, raising=False)
    n = 20 * blocks.PACK_ROWS
    rows = spark.range(n).select(F.lit(1).alias("chat_id"), F.col("id").alias("seq"), F.lit("a b c").alias("content"))
    table = spark.createDataFrame([("a b", "x"), ("c", "y")], "key string, phrase string")
    for mapped, want in ((map_runs_by_table, "x y"), (P.map_tokens_by_table, "a b y")):
        out = mapped(rows, "content", table).groupBy(F.spark_partition_id().alias("p"), "content").count().collect()
        assert {r["content"] for r in out} == {want} and sum(r["count"] for r in out) == n
        assert max(r["count"] for r in out) <= n // 3
