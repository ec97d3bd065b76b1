import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import chat_stats, contexts
from parlance.plans import blocks
from parlance.plans.ordered import celled, nearest

START = dt.datetime(2024, 1, 1)


def chat(spark, rows):
    """rows: (chat, seq, sender, minutes, content)"""
    data = [
        (c, s, who, "group" if len(who) > 2 else f"to-{s}", text, START + dt.timedelta(minutes=m))
        for c, s, who, m, text in rows
    ]
    return spark.createDataFrame(
        data,
        "chat_id bigint, seq bigint, sender string, receiver string, content string, "
        "ts timestamp_ntz",
    )


def random_rows(seed, n=120, chats=3, gap=90):
    rng = random.Random(seed)
    rows, clock = [], [0] * chats
    for seq in range(n):
        c = rng.choice([0, 0, 0, *range(chats)])
        clock[c] += rng.choice([0, 0, 1, 10, 59, 60, 61, rng.randrange(gap), 480, 481, 5000])
        text = None if rng.random() < 0.1 else rng.choice(["a", "hello there", "ok", "x y z", ""])
        rows.append((c, seq, rng.choice("ABC"), clock[c], text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("seed, span, crowd", [(0, 3600, None), (1, 3600, 2), (2, 60, None), (3, 86_400, 1), (4, 7, 3)])
def test_nearest(spark, after, seed, span, crowd):
    rows = random_rows(seed)
    df = nearest(
        chat(spark, rows), ["chat_id"], F.col("content"), "found", after=after, span=span, crowd=crowd
    )
    got = {(r["chat_id"], r["seq"]): r["found"] for r in df.collect()}
    for c, seq, _, m, _ in rows:
        side = [r for r in rows if r[0] == c and r[4] is not None]
        side = [r for r in side if ((r[3], r[1]) > (m, seq) if after else (r[3], r[1]) < (m, seq))]
        pick = (min if after else max)(side, key=lambda r: (r[3], r[1]), default=None)
        assert got[c, seq] == (pick[4] if pick else None)
    assert len(got) == len(rows)


@pytest.mark.parametrize("after", [False, True])
def test_a_burst_is_cut_into_cells(spark, after):
    """100,000 messages in one minute beside quiet hours: no cell outgrows its size, order is kept."""
    n, crowd = 100_000, 1_000
    second = F.col("id") % 3 * (F.col("id") % 2)  # times that cross the order of seq
    burst = spark.range(n).select(
        F.lit(1).alias("chat_id"), F.col("id").alias("seq"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=second)).alias("ts"),
    )
    quiet = spark.range(50).select(
        F.lit(1).alias("chat_id"), (F.col("id") + n).alias("seq"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") - 25).cast("int"), mins=F.lit(7))).alias("ts"),
    )
    rows = burst.unionByName(quiet)
    sizes = [r["count"] for r in celled(rows, ["chat_id"], crowd=crowd).groupBy("chat_id", "_at", "_run").count().collect()]
    assert max(sizes) <= crowd and sum(sizes) == n + 50 and len(sizes) <= 3 * n // crowd + 50
    found = nearest(rows, ["chat_id"], F.col("seq"), "found", after=after, crowd=crowd).collect()
    order = [r["seq"] for r in sorted(found, key=lambda r: (r["ts"], r["seq"]))]
    beside = dict(zip(order, [*order[1:], None])) if after else dict(zip(order[1:], order))
    assert all(r["found"] == beside.get(r["seq"]) for r in found) and len(found) == n + 50


@pytest.mark.parametrize("n", [1, 7, 40, 1000])
@pytest.mark.parametrize("block", [1, 8, 1 << 16])
def test_tail(spark, n, block):
    rows = random_rows(5)
    got = blocks.tail(chat(spark, rows), n, ["chat_id"], block_rows=block)
    want = set()
    for c in {r[0] for r in rows}:
        want |= {(c, s) for s in sorted((r[1] for r in rows if r[0] == c), reverse=True)[:n]}
    found = [(r["chat_id"], r["seq"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_salted_lookup(spark):
    rows = chat(spark, [(0, i, "A", i, "hot" if i % 3 else "cold") for i in range(90)])
    table = spark.createDataFrame([("hot", 1)], "content string, v int")
    got = blocks.salted_lookup(rows, table, "content", ["chat_id", "seq"]).groupBy("v").count()
    assert {(r["v"], r["count"]) for r in got.collect()} == {(1, 60), (None, 30)}


def fold(rows, threshold):
    """Row-by-row contexts of one chat, straight from the rules."""
    rows = sorted((r for r in rows if r[4] is not None), key=lambda r: (r[3], r[1]))
    people = sorted({r[2] for r in rows})
    open_, out = {p: None for p in people}, []
    for _, seq, who, m, text in rows:
        for p in people:
            if open_[p]:
                if m - open_[p]["start"] <= threshold:
                    open_[p]["texts"].append(text)
                    open_[p]["end"] = m
                else:
                    o = open_[p]
                    out.append((p, f"to-{seq}", " ".join(o["texts"]), o["start"], o["start"]))
                    open_[p] = None
        texts = open_[who]["texts"] if open_[who] else []
        open_[who] = {"texts": [*texts, text], "start": m, "end": m}
    for p in people:
        if open_[p]:
            o = open_[p]
            out.append((p, f"to-{rows[-1][1]}", " ".join(o["texts"]), o["start"], o["end"]))
    return [o for o in out if len(o[2].strip()) > 3]


@pytest.mark.parametrize("threshold", [1, 60, 600])
@pytest.mark.parametrize("seed", range(3))
def test_contexts_equal_a_fold(spark, threshold, seed):
    rows = random_rows(seed, 90)
    got = contexts.merge(chat(spark, rows), threshold).collect()
    minutes = lambda t: round((t - START).total_seconds() / 60)
    found = sorted(
        (r["chat_id"], r["sender"], r["receiver"], r["merged_content"], minutes(r["start_ts"]),
         minutes(r["end_ts"]))
        for r in got
    )
    want = sorted(
        (c, *o) for c in {r[0] for r in rows} for o in fold([r for r in rows if r[0] == c], threshold)
    )
    assert found == want
    assert all(r["date"] == r["start_ts"].date() for r in got)


def test_contexts_without_copies(spark):
    rows = chat(spark, [(0, 0, "A", 0, "one"), (0, 1, "A", 5, "two"), (0, 2, "B", 6, "three")])
    texts = {r["sender"]: r["merged_content"] for r in contexts.merge(rows, dedupe=True).collect()}
    assert texts == {"A": "one two three", "B": "three"}


@pytest.mark.parametrize("partitions, span", [(1, 3600), (7, 60), (64, 86400)])
def test_reply_time(spark, partitions, span):
    rows = random_rows(11)
    df = chat(spark, rows).repartition(partitions)
    got = chat_stats.reply_time(df, span=span).collect()
    sums = {}
    for c in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == c), key=lambda r: (r[3], r[1]))
        for p in {r[2] for r in ordered}:
            sums[c, p] = []
        for a, b in zip(ordered, ordered[1:]):
            if a[2] != b[2] and b[3] - a[3] <= 480:
                sums[c, a[2]].append(b[3] - a[3])
    want = {k: sum(v) / len(v) if v else None for k, v in sums.items()}
    assert {(r["chat_id"], r["participant"]): r["avg_reply_minutes"] for r in got} == pytest.approx(want)


def test_plans_pair_nothing_blindly(spark, sf):
    """No cross joins anywhere, no window over all rows, no window over a raw chat."""
    from parlance.catalog.queries import QUERIES

    for name, run in QUERIES.items():
        plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "SinglePartition" not in plan, name
