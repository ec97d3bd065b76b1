import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from parlance.functions.dates import monday_week, sunday_week_label
from parlance.operators import call_stats, chat_stats, insights, mood
from parlance.schema import EMOTIONS, MOOD_BINS, calls
from parlance.sources import tables

from test_plans import START, chat


def scored(spark, data):
    return spark.createDataFrame(
        data,
        "chat_id bigint, sender string, date date, sentiment string, emotion map<string,double>, "
        "toxicity struct<score:double,type:string>, seq bigint, merged_content string, receiver string",
    )


def test_week_labels(spark):
    days = [dt.date(2023, 12, 25) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d", sunday_week_label(F.col("d")).alias("u"), monday_week(F.col("d")).alias("w")
    )
    for r in df.collect():
        assert r["u"] == r["d"].strftime("%Y-%U")
        assert r["w"] == r["d"] - dt.timedelta(days=r["d"].weekday())


def test_bins_equal_pandas(spark):
    rng = random.Random(3)
    groups = {g: [rng.choice([rng.uniform(-2, 2), rng.randrange(5) / 4]) for _ in range(12)]
              for g in range(60)}
    groups[60], groups[61] = [0.5] * 4, [0.0, 1.0, 0.2, 0.4, 0.6, 0.8]
    data = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(data, "g int, x double")
    limits = df.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = df.join(limits, "g").select(
        "g", "x", mood._bin(F.col("x"), F.col("lo"), F.col("hi"), MOOD_BINS).alias("b"))
    want = {}
    for g, xs in groups.items():
        for x, b in zip(xs, pd.cut(pd.Series(xs), bins=5, labels=list(MOOD_BINS))):
            want[g, x] = b
    assert {(r["g"], r["x"]): r["b"] for r in got.collect()} == want


def test_mood_edges(spark):
    monday = dt.date(2024, 1, 1)
    rows = scored(spark, [
        (1, "A", monday, "Positive", {"neutral": 0.9}, None, 0, "x", "B"),
        (1, "A", monday + dt.timedelta(7), None, {"love": 0.5, "caring": 0.0005, "neutral": 0.4},
         (0.7, "insult"), 1, "y", "B"),
        (1, "A", monday + dt.timedelta(8), "Very Negative", None, (0.5, None), 2, "z", "B"),
    ])
    people = spark.createDataFrame([(1, "A"), (1, "B")], "chat_id bigint, participant string")
    love = {r["participant"]: (r["love_score"], r["love_percentage"])
            for r in mood.love_score(rows, people).collect()}
    assert love == {"A": (1, 33.33), "B": (0, 0.0)}
    wide = {r["week"]: r for r in mood.emotion_trend_wide(rows).collect()}
    assert wide[monday]["love"] is None
    assert wide[monday + dt.timedelta(7)]["love"] > 0.99
    long = mood.emotion_trend(rows)
    assert long.count() == 2 * (len(EMOTIONS) - 1)
    shares = long.groupBy("week").agg(F.sum("share").alias("s")).where("s is not null").collect()
    assert [round(r["s"], 9) for r in shares] == [1.0]
    toxic = mood.toxicity_summary(rows).collect()
    assert [(r["merged_content"], r["toxicity_score"]) for r in toxic] == [("y", 0.7)]
    trend = mood.mood_trends(rows, window=2).orderBy("date").collect()
    assert [r["toxicity_rolling"] for r in trend] == [0.0, 0.35, 0.6]
    assert [r["sentiment_rolling"] for r in trend] == [1.0, 1.0, -2.0]


def test_no_calls(spark):
    from pyspark.sql import types as T

    empty = spark.createDataFrame([], calls(T.LongType()))
    for op in (call_stats.avg_call_duration, call_stats.call_mode, call_stats.calls_per_day,
               call_stats.longest_call, call_stats.days_without_calls, call_stats.busiest_call_days):
        assert op(empty).count() == 0


def test_participants_without_messages(spark):
    people = spark.createDataFrame([(0, p) for p in "ABC"], "chat_id bigint, participant string")
    rows = chat(spark, [(0, 0, "A", 0, "sorry sorry my bad"), (0, 1, "A", 1, None), (0, 2, "B", 2, "")])
    got = {r["participant"]: r["n"] for r in insights.apologies(rows, people).collect()}
    assert got == {"A": 1, "B": 0, "C": 0}
    longest = {r["participant"]: r["length"] for r in chat_stats.longest_message(rows, people).collect()}
    assert longest == {"A": 4, "B": 0, "C": None}
    replies = {r["participant"]: r["avg_reply_minutes"]
               for r in chat_stats.reply_time(rows, people).collect()}
    assert replies == {"A": 1.0, "B": None, "C": None}


def test_word_ties_go_to_the_first_seen(spark):
    rows = chat(spark, [(0, 5, "A", 9, "bbb ccc"), (0, 6, "A", 0, "ccc! aaa 👨‍👩‍👧 ... ab"),
                        (0, 7, "B", 0, "aaa bbb")])
    got = [(r["word"], r["n"]) for r in chat_stats.top_words(rows).orderBy("rank").collect()]
    assert got == [("ccc", 2), ("aaa", 2), ("bbb", 2), ("", 1)]


def test_typed_results_survive_storage(spark, sf, tmp_path):
    from parlance.catalog import fixtures as X

    rows = X.messages(spark, sf).withColumn("content", F.when(
        F.col("seq") == 1, '"q", \\ back\nnew ').when(F.col("seq") == 2, "").otherwise(F.col("content")))
    tables.write_csv(rows, str(tmp_path / "c"))
    no_empty = rows.withColumn("content", F.nullif("content", F.lit("")))
    back = tables.read_csv(spark, str(tmp_path / "c"), rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, no_empty.collect()))
    want = sorted(map(str, rows.collect()))
    tables.write_json(rows, str(tmp_path / "j"))
    assert sorted(map(str, tables.read_json(spark, str(tmp_path / "j"), rows.schema).collect())) == want
    assert tables.read_results(spark, str(tmp_path / "c")).columns == rows.columns
    assert START.year == 2024


def test_cubes_give_what_the_single_statistics_give(spark):
    """Slices of a cube against the operators, with null senders, types and times."""
    from parlance.operators import cube

    rows = [
        (i % 3, i, [None, "a", "b"][i % 3 if i % 7 else 0], ["text", "image", None][i % 4 % 3], ["sorry you are great", None, "", "why so damn"][i % 4],
         None if i % 9 == 0 else dt.datetime(2024, 1, 1 + i % 5, i % 24))
        for i in range(200)
    ]
    messages = spark.createDataFrame(rows, "chat_id int, seq int, sender string, type string, content string, ts timestamp_ntz")
    facts = cube.message_cube(messages).cache()
    of = lambda *columns: cube.slice_of(facts, ["chat_id"], cube.MESSAGE_COLUMNS, columns)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(chat_stats.active_hours(messages), of("hour").where("hour IS NOT NULL"))
    assert same(chat_stats.media_stats(messages), of("sender", "type").where("type <> 'text'"))
    lengths = of("sender").withColumn("avg_words", F.col("words") / F.nullif("said", F.lit(0)))
    assert same(chat_stats.avg_message_length(messages), lengths)
    assert facts.where("sender IS NULL").select("_set").distinct().count() == 3
    calls = messages.select("chat_id", "sender", F.lit("r").alias("receiver"), "type", "ts", (F.col("seq") % 4).alias("duration"))
    facts = cube.call_cube(calls).cache()
    of = lambda *columns: cube.slice_of(facts, ["chat_id"], cube.CALL_COLUMNS, columns)
    assert same(call_stats.calls_per_sender(calls), of("sender")) and same(call_stats.calls_per_type(calls), of("type"))
    assert same(call_stats.call_hours(calls), of("hour"))
    assert same(call_stats.avg_call_duration(calls), of().withColumn("avg_duration", F.coalesce(F.col("seconds") / F.col("held"), F.lit(0.0))))
