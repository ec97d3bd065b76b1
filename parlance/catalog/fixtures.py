"""Views that the registered queries run on, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.participants import with_receiver
from parlance.schema import SENTIMENTS

NARROW_SPACE, MARKER = " ", "‎"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text message per conversation turn, whole, with an ending that has links, emoji or
    abbreviations; after some turns a message without text follows (seq is 2 turn, 2 turn + 1)."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"), "turn", F.col("role").alias("sender"), "text"
    )
    chat, turn = F.col("chat_id"), F.col("turn")
    kind_no = (chat * 7 + turn * 3) % 13
    extra = (
        F.when(kind_no == 0, "image").when(kind_no == 1, "audio")
        .when(kind_no == 2, "deleted_by_others")
    )
    tail_no = (chat + turn) % 6
    tail = (
        F.when(tail_no == 0, " brb! sorry 😂😂").when(tail_no == 1, " this is so cool 👍")
        .when(tail_no == 2, " asap, damn").when(tail_no == 3, " why 😂 http://x.io/a")
        .otherwise("")
    )
    minutes = (
        (chat % 90) * 1440 + (chat * 37) % 1440 + turn * 10
        + F.when(turn >= 3, (chat % 7) * 50).otherwise(0)
        + F.when(turn >= 5, (chat % 3) * 235).otherwise(0)
        + F.when(turn >= 7, (chat % 4) * 300).otherwise(0)
        + F.col("m.extra")
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    people = turns.select("chat_id", F.col("sender").alias("participant")).distinct()
    both = F.array(
        F.struct(F.lit(0).alias("extra"), F.lit("text").alias("type")),
        F.struct(F.lit(1).alias("extra"), extra.alias("type")),
    )
    rows = (
        turns.withColumn("m", F.explode(both))
        .where(F.col("m.type").isNotNull())
        .select(
            "chat_id", (turn * 2 + F.col("m.extra")).alias("seq"), "sender",
            F.when(F.col("m.extra") == 0, F.concat(F.lower(F.trim("text")), tail)).alias("content"),
            (start + F.make_dt_interval(mins=minutes.cast("int"))).alias("ts"),
            F.col("m.type").alias("type"),
        )
    )
    return with_receiver(rows, people).select(
        "chat_id", "seq", "sender", "receiver", "content", "ts", "type"
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per event.  Calls of every seventh day are moved to the day before, so that there
    are days without calls."""
    kind = F.col("event_type")
    user = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("seq"),
            (user % 3).alias("chat_id"),
            F.concat(F.lit("u"), (user % 20).cast("string")).alias("sender"),
            F.concat(F.lit("u"), ((user + 1 + F.col("event_id") % 3) % 20).cast("string")).alias(
                "receiver"
            ),
            F.when(kind.isin("signup", "purchase"), F.floor("value").cast("int")).otherwise(0).alias(
                "duration"
            ),
            F.when(kind == "signup", "voice_call").when(kind == "purchase", "video_call")
            .when(kind == "view", "missed_voice_call").when(kind == "click", "missed_video_call")
            .otherwise("silenced_voice_call").alias("type"),
            F.expr("CASE WHEN dayofmonth(ts) % 7 = 3 THEN ts - INTERVAL 1 DAY ELSE ts END").alias("ts"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored contexts: one per text message, in three chats, with typed scores."""
    chat, seq = F.col("chat_id"), F.col("seq")
    level = (chat * 17 + seq * 29) % 100
    which = (chat + seq) % 3
    labels = list(SENTIMENTS)
    mood = (chat * 3 + seq) % 5
    sentiment = F.when(mood == 0, labels[0])
    for i, label in enumerate(labels[1:], 1):
        sentiment = sentiment.when(mood == i, label)
    names = ("love", "caring", "anger", "annoyance", "joy", "sadness", "neutral", "fear")

    def emotion(i):
        pick = F.get(F.array(*[F.lit(n) for n in names]), ((chat + seq * 2 + i) % 8).cast("int"))
        return F.struct(pick.alias("emotion"), F.lit((0.7, 0.2, 0.0005)[i]).alias("score"))

    return (
        messages(spark, sf_dir)
        .where(F.col("content").isNotNull())
        .select(
            (chat % 3).alias("chat_id"), chat.alias("src"), "seq", "sender", "receiver",
            F.col("content").alias("merged_content"), F.col("ts").cast("date").alias("date"), "ts",
            sentiment.alias("sentiment"),
            F.map_from_entries(F.array(*[emotion(i) for i in range(3)])).alias("emotion"),
            F.struct(
                (level.cast("double") / 100).alias("score"),
                F.when(
                    level > 50,
                    F.when(which == 0, "insult").when(which == 1, "threat").otherwise("obscene"),
                ).alias("type"),
            ).alias("toxicity"),
        )
    )


# Golden contents of the extra lines, by (chat_id * 5 + seq) % 29; higher numbers have none.
SPECIAL = (
    f"{MARKER}image omitted",
    f"{MARKER}video note omitted",
    f"{MARKER}contact card omitted",
    "Location: https://maps.x/?q=1",
    "report.pdf document omitted",
    "You deleted this message.",
    "This message was deleted.",
    "You blocked this contact",
    "You unblocked this contact",
    "fine http://a.b/c and http://a.b/c <This message was edited>",
    "Voice call, 5 min",
    "Video call, 1 h",
    "Voice call, 12 min",
    "Missed voice call",
    "Video call, No answer",
    "Call failed, try again",
    "Group call, 3 invited",
    "Silenced video call, Busy",
    "Silenced voice call, Busy",
    "see [1] note: Hello There",
)


#: Line numbers that a message may use.
STRIDE = 1_000


def _lines(rows: DataFrame, prefix, notice, extra) -> DataFrame:
    """The lines of an export: the notice before the first message, every message with all lines of
    its text, an extra message with a golden content, and a line that continues it."""
    chat, seq = F.col("chat_id"), F.col("seq")
    head = F.concat(prefix, F.col("sender"), F.lit(": "))
    body = F.coalesce(F.col("content"), F.concat(F.lit(f"{MARKER}"), "type", F.lit(" omitted")))
    more = F.when((chat + seq) % 5 == 0, F.lit("and a second line: more"))
    pieces = F.concat(
        F.array(F.when(seq == 0, notice)),
        F.split(F.concat(head, body), "\n"),
        F.array(F.concat(head, extra), more),
    )
    lines = F.filter(pieces, lambda line: line.isNotNull())
    return rows.select("chat_id", "seq", F.posexplode(lines).alias("at", "line")).select(
        "chat_id", (seq * STRIDE + F.col("at")).alias("seq"), "line"
    )


def _golden():
    at = ((F.col("chat_id") * 5 + F.col("seq")) % 29).cast("int")
    return F.get(F.array(*[F.lit(s) for s in SPECIAL]), at)


NOTICE_TEXT = (
    "Messages and calls are end-to-end encrypted. No one outside of this chat, not even WhatsApp, "
    "can read or listen to them."
)


def lines_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.concat(F.lit("["), F.date_format("ts", "dd/MM/yy, h:mm:ss a"), F.lit("] "))
    poster = F.when(F.col("chat_id") % 2 == 0, F.lit("Desk")).otherwise(F.col("sender"))
    notice = F.concat(prefix, poster, F.lit(": "), F.lit(NOTICE_TEXT))
    return _lines(messages(spark, sf_dir), prefix, notice, _golden())


def lines_android(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.lower(F.date_format("ts", "a"))
    prefix = F.concat(
        F.date_format("ts", "dd/MM/yy, h:mm"), F.lit(NARROW_SPACE), half, F.lit(" - ")
    )
    media = F.when((F.col("chat_id") + F.col("seq")) % 4 == 0, F.lit("<Media omitted>"))
    extra = F.coalesce(media, _golden())
    return _lines(messages(spark, sf_dir), prefix, F.lit(NOTICE_TEXT), extra)
