import datetime as dt

import pytest

from parlance.operators import parse, participants
from parlance.resources.phrases import PHRASES

IOS = "[28/05/24, 1:02:03 PM] Ann: "
WHEN = dt.datetime(2024, 5, 28, 13, 2, 3)


def lines(spark, *texts, chat="c"):
    return spark.createDataFrame(
        [(chat, i, t) for i, t in enumerate(texts)], "chat_id string, seq bigint, line string"
    )


def ios(spark, *texts):
    return lines(spark, "[28/05/24, 1:00:00 PM] Ben: hey", *[IOS + t for t in texts])


@pytest.mark.parametrize(
    "text, kind, content",
    [
        ("Hello There", "text", "hello there"),
        ("‎image omitted", "image", None),
        ("‎video note omitted", "video", None),
        ("‎contact card omitted", "contact_card", None),
        ("my audio: image omitted", "audio", None),
        ("Location: https://maps.x/?q=1", "location", ""),
        ("report.pdf document omitted", "document", "report.pdf document omitted"),
        ("You deleted this message.", "deleted_by_me", None),
        ("This message was deleted.", "deleted_by_others", None),
        ("You blocked this contact", "blocked", None),
        ("You unblocked this contact", "unblocked", None),
        ("fine <This message was edited>", "text_edited_message", "fine"),
        ("a http://x.y/1 b http://x.y/1 <This message was edited>", "text_edited_message", "a  b "),
        ("see http://x.y/1", "text", "see http://x.y/1"),
        ("Voice call, 12 min", "text", "voice call, 12 min"),
        ("a: b: c", "text", "a: b: c"),
        ("Location: Home, you deleted this message.", "location", "home, you deleted this message."),
    ],
)
def test_ios_messages(spark, text, kind, content):
    row = parse.parse_lines(ios(spark, text), "ios").where("seq = 1").first()
    assert (row["type"], row["content"], row["receiver"], row["ts"]) == (kind, content, "Ben", WHEN)


@pytest.mark.parametrize(
    "text, kind, seconds, invites, reason",
    [
        ("Voice call, 5 min", "voice_call", 300, 0, None),
        ("Voice call, 7 sec", "voice_call", 7, 0, None),
        ("Video call, 1 h", "video_call", 3600, 0, None),
        ("Missed voice call", "missed_voice_call", 0, 0, None),
        ("Video call, No answer", "missed_video_call", 0, 0, None),
        ("Call failed, try again", "failed_call", 0, 0, None),
        ("Group call, 3 invited", "group_call", 0, 3, None),
        ("Silenced video call, Busy", "silenced_video_call", 0, 0, "busy"),
        ("Silenced voice call, Busy", "silenced_voice_call", 0, 0, "busy"),
        ("Missed voice call, voice call, 2 min", "voice_call", 120, 0, None),
    ],
)
def test_ios_calls(spark, text, kind, seconds, invites, reason):
    row = parse.parse_calls(ios(spark, text)).first()
    assert row["type"] == kind
    assert (row["duration"], row["group_call_invites"], row["silence_reason"]) == (
        seconds, invites, reason,
    )
    assert parse.parse_lines(ios(spark, text), "ios").count() == 1


def test_ios_dropped_lines(spark):
    from parlance.catalog.fixtures import NOTICE_TEXT

    rows = ios(spark, NOTICE_TEXT, "").unionByName(lines(spark, "no prefix: here", "[28/05/24] x: y"))
    assert parse.parse_lines(rows, "ios").count() == 1


def test_unicode_space_and_line_separators(spark):
    row = parse.parse_lines(ios(spark, "a b  "), "ios").where("seq = 1").first()
    assert row["content"] == "a b"
    odd = lines(spark, "   [28/05/24, 1:02:03 PM] A B:  hi  ")
    row = parse.parse_lines(odd, "ios").first()
    assert (row["sender"], row["content"], row["receiver"]) == ("A B", "hi", None)


@pytest.mark.parametrize(
    "stamp, year, hour",
    [("01/02/68, 12:00:00 AM", 2068, 0), ("01/02/69, 12:00:00 PM", 1969, 12),
     ("01/02/99, 11:00:00 PM", 1999, 23), ("1/2/99, 1:00:00 PM", None, None),
     ("41/02/24, 1:00:00 PM", 0, 0), ("01/02/24, 13:00:00 PM", 0, 0)],
)
def test_clock(spark, stamp, year, hour):
    row = parse.parse_lines(lines(spark, f"[{stamp}] A: x"), "ios").first()
    if year is None:
        assert row is None
    elif year == 0:
        assert row["ts"] is None
    else:
        assert (row["ts"].year, row["ts"].month, row["ts"].hour) == (year, 2, hour)


def test_android(spark):
    from parlance.catalog.fixtures import NOTICE_TEXT

    p = "28/05/24, 11:52 pm - Ann: "
    rows = lines(
        spark, p + "Hi", p + "<Media omitted>", p + "", NOTICE_TEXT, "28/05/24, 1:5 am - Ben: ok: x"
    )
    got = [tuple(r) for r in parse.parse_lines(rows, "android").orderBy("seq").collect()]
    late = dt.datetime(2024, 5, 28, 23, 52)
    assert got == [
        ("c", 0, "Ann", "Ben", "hi", late, "text"),
        ("c", 1, "Ann", "Ben", None, late, "media"),
        ("c", 4, "Ben", "Ann", "ok: x", dt.datetime(2024, 5, 28, 1, 5), "text"),
    ]
    assert parse.parse_calls(rows, "android").count() == 0
    assert parse.parse_calls(rows, "android").columns == parse.parse_calls(rows, "ios").columns


def test_participants_follow_the_last_bracket(spark):
    rows = ios(spark, "see [1] note: x")
    names = {r["participant"] for r in participants.from_lines(rows, "ios").collect()}
    assert names == {"Ben", "note"}
    receivers = {r["receiver"] for r in parse.parse_lines(rows, "ios").collect()}
    assert receivers == {"Ben", "note"}


def test_receiver_does_not_depend_on_blocks(spark):
    from parlance.plans import blocks

    rows = ios(spark, *[f"m{i}" for i in range(50)])
    people = participants.from_lines(rows, "ios")
    split = parse.split_ios(rows)
    per_chat = people.groupBy("chat_id").count()
    small = blocks.attach(split, per_chat, ["chat_id"], block_rows=7)
    assert small.where("count = 2").count() == split.count() == 51


def test_round_trip(spark, sf):
    """Messages rendered in both formats parse back to sender, content and time."""
    from pyspark.sql import functions as F

    from parlance.catalog import fixtures as X

    texts = X.messages(spark, sf).where("type = 'text'")
    ios_line = F.concat(
        F.lit("["), F.date_format("ts", "dd/MM/yy, h:mm:ss a"), F.lit("] "), "sender", F.lit(": "),
        "content",
    )
    android_line = F.concat(
        F.date_format("ts", "dd/MM/yy, h:mm"), F.lit(X.NARROW_SPACE),
        F.lower(F.date_format("ts", "a")), F.lit(" - "), "sender", F.lit(": "), "content",
    )
    want = {tuple(r) for r in texts.select("chat_id", "seq", "sender", "content", "ts").collect()}
    for platform, line in (("ios", ios_line), ("android", android_line)):
        back = parse.parse_lines(texts.select("chat_id", "seq", line.alias("line")), platform)
        got = {tuple(r) for r in back.select("chat_id", "seq", "sender", "content", "ts").collect()}
        assert got == want


def test_phrase_lists_are_whole():
    assert [len(PHRASES[k]) for k in ("compliment", "apology", "questioning", "swearing")] == [
        49, 16, 25, 124,
    ]
