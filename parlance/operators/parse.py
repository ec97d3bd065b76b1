"""Export lines to typed messages and calls.

Only the fixed prefix of a line needs a pattern; the rest is cut with string functions, and the
content classifiers use substring tests wherever a pattern has no wildcard.  ``(?d)`` makes ``.``
stop at a line feed only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import SPACE_CLASS, normalize, strip, strip_first_link
from parlance.operators import participants as people_ops
from parlance.operators.participants import MARKER, with_receiver
from parlance.plans.once import once
from parlance.schema import KEYS

# Line prefixes of the two export formats.
IOS_PREFIX = r"^\[\d{2}/\d{2}/\d{2}, \d{1,2}:\d{2}:\d{2} [APM]{2}\] "
ANDROID_PREFIX = r"(?d)^\d{2}/\d{2}/\d{2}," + SPACE_CLASS + r"\d{1,2}:\d{1,2}.[ap]m - "

# Fixed value: the notice at the top of every export.
NOTICE = (
    "messages and calls are end-to-end encrypted. no one outside of this chat, not even whatsapp, "
    "can read or listen to them."
)

# Content patterns of calls, tried in this order.
COMPLETED_CALL = r"(voice call|video call), \d (min|sec|h)"
GROUP_CALL = r"group call, \d invited"
# Attachment words; the leftmost one in the text names the type.
ATTACHMENTS = ("image", "audio", "video", "gif", "sticker", "contact card", "video note")
EDITED = " <this message was edited>"


def _split_rest(rows: DataFrame, pattern: str) -> DataFrame:
    """Match the prefix of ``_line`` and cut the rest at its first ``': '`` into sender and content;
    other lines are dropped."""
    found = once(rows, "_prefix", F.regexp_extract("_line", pattern, 0)).where("_prefix <> ''")
    rest = F.substring(F.col("_line"), F.length("_prefix") + 1, F.length("_line"))
    found = once(found, "_rest", rest)
    found = once(found, "_cut", F.instr("_rest", ": ")).where("_cut > 0")
    content = normalize(F.substring(F.col("_rest"), F.col("_cut") + 2, F.length("_rest")))
    return once(found, "content", content).withColumn(
        "sender", F.substring(F.col("_rest"), F.lit(1), F.col("_cut") - 1)
    )


def _timestamp(date: Column, hour: Column, minute: Column, second: Column, half: Column) -> Column:
    """Day-first date with a two-digit year (69-99 are 19xx) and a 12-hour clock; null if invalid."""
    yy = F.substring(date, 7, 2).cast("int")
    year = yy + F.when(yy >= 69, 1900).otherwise(2000)
    hour24 = F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    return F.call_function(
        "try_make_timestamp_ntz",
        year,
        F.substring(date, 4, 2).cast("int"),
        F.substring(date, 1, 2).cast("int"),
        hour24,
        minute,
        second.cast("decimal(16,6)"),
    )


def split_ios(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, seq, sender, content, ts`` of bracketed lines, notice lines left out."""
    line = F.replace(strip(F.col("line")), F.lit(MARKER), F.lit(""))
    rows = _split_rest(once(lines.select(*keys, "seq", "line"), "_line", line), IOS_PREFIX)
    clock = F.split(F.substring(F.col("_prefix"), F.lit(12), F.length("_prefix") - 13), "[: ]")
    ts = _timestamp(
        F.substring("_prefix", 2, 8),
        clock[0].cast("int"),
        clock[1].cast("int"),
        clock[2].cast("int"),
        F.lower(F.substring(clock[3], 1, 1)),
    )
    return rows.where(F.col("content") != NOTICE).select(
        *keys, "seq", "sender", "content", ts.alias("ts")
    )


def split_android(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, seq, sender, content, ts`` of dashed lines; the notice line has no prefix."""
    line = strip(F.col("line"))
    rows = _split_rest(once(lines.select(*keys, "seq", "line"), "_line", line), ANDROID_PREFIX)
    clock = F.substring(F.col("_prefix"), F.lit(11), F.length("_prefix") - 13)
    digits = F.split(F.substring(clock, F.lit(1), F.length(clock) - 3), ":")
    ts = _timestamp(
        F.substring("_prefix", 1, 8),
        digits[0].cast("int"),
        digits[1].cast("int"),
        F.lit(0),
        F.substring(clock, F.length(clock) - 1, F.lit(1)),
    )
    return rows.select(*keys, "seq", "sender", "content", ts.alias("ts"))


def _any(text: Column, *phrases: str) -> Column:
    test = F.contains(text, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        test = test | F.contains(text, F.lit(phrase))
    return test


def call_type(content: Column) -> Column:
    """Type of a call line, null for everything else.  First match wins."""
    underscored = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    completed = F.regexp_extract(content, "voice call|video call", 0)
    missed = F.regexp_extract(content, "missed (voice|video) call", 0)
    unanswered = F.regexp_extract(content, "(voice|video) call, no answer", 1)
    silenced = F.regexp_extract(content, "silenced (voice|video) call", 0)
    found = (
        F.when(content.rlike(COMPLETED_CALL), underscored(completed))
        .when(_any(content, "missed voice call", "missed video call"), underscored(missed))
        .when(
            _any(content, "voice call, no answer", "video call, no answer"),
            F.concat(F.lit("missed_"), unanswered, F.lit("_call")),
        )
        .when(_any(content, "call failed, try again"), F.lit("failed_call"))
        .when(content.rlike(GROUP_CALL), F.lit("group_call"))
        .when(
            _any(content, "silenced voice call, ", "silenced video call, "), underscored(silenced)
        )
    )
    return F.when(_any(content, "call"), found)


def call_duration(content: Column, kind: Column) -> Column:
    """Seconds of a completed call: first integer times the first unit named; otherwise 0."""
    unit = F.regexp_extract(content, "sec|min|h", 0)
    factor = F.when(unit == "sec", 1).when(unit == "min", 60).otherwise(3600)
    seconds = F.regexp_extract(content, r"\d+", 0).try_cast("bigint") * factor
    return F.when(kind.isin("voice_call", "video_call"), seconds).otherwise(0).try_cast("int")


def call_invites(content: Column, kind: Column) -> Column:
    invited = F.regexp_extract(content, r"(\d) invited", 1).try_cast("int")
    return F.when(kind == "group_call", invited).otherwise(0)


def silence_reason(content: Column, kind: Column) -> Column:
    """Text after a silenced call, for voice as for video."""
    reason = F.regexp_extract(content, r"(?d)silenced (?:voice|video) call, (.+)$", 1)
    return F.when(kind.startswith("silenced"), F.nullif(reason, F.lit("")))


def ios_message_type(content: Column) -> Column:
    """Type of a line that is no call.  First match wins."""
    attachment = F.regexp_extract(content, "image|audio|video|gif|sticker|contact card", 0)
    return (
        F.when(
            _any(content, *[f"{a} omitted" for a in ATTACHMENTS]),
            F.replace(attachment, F.lit(" "), F.lit("_")),
        )
        .when(_any(content, "location: "), F.lit("location"))
        .when(content.endswith(" document omitted"), F.lit("document"))
        .when(content.endswith("you deleted this message."), F.lit("deleted_by_me"))
        .when(content.endswith("this message was deleted."), F.lit("deleted_by_others"))
        .when(content.endswith("you blocked this contact"), F.lit("blocked"))
        .when(content.endswith("you unblocked this contact"), F.lit("unblocked"))
        .when(
            content.endswith(EDITED) & (F.length(content) > len(EDITED)),
            F.lit("text_edited_message"),
        )
        .otherwise("text")
    )


def ios_content(content: Column, kind: Column) -> Column:
    """What is left of the text once its type is known; links go from typed rows only."""
    place = F.substring(content, F.instr(content, "location: ") + 10, F.length(content))
    before_tag = F.substring(content, F.lit(1), F.length(content) - len(EDITED))
    return (
        F.when(kind == "text", content)
        .when(kind == "location", strip_first_link(place))
        .when(kind == "document", strip_first_link(content))
        .when(kind == "text_edited_message", strip_first_link(before_tag))
    )


def android_message_type(content: Column) -> Column:
    return (
        F.when(content.endswith("<media omitted>"), F.lit("media"))
        .when(content != "", F.lit("text"))
        .otherwise("unknown")
    )


def route(rows: DataFrame) -> DataFrame:
    """Add ``call_type`` (null for messages) to split iOS rows."""
    return once(rows, "call_type", call_type(F.col("content")))


def ios_messages(routed: DataFrame) -> DataFrame:
    rows = routed.where(F.col("call_type").isNull()).drop("call_type")
    typed = once(rows, "type", ios_message_type(F.col("content")))
    return typed.withColumn("content", ios_content(F.col("content"), F.col("type")))


def ios_calls(routed: DataFrame) -> DataFrame:
    text, kind = F.col("content"), F.col("call_type")
    return (
        routed.where(kind.isNotNull())
        .withColumn("duration", call_duration(text, kind))
        .withColumn("group_call_invites", call_invites(text, kind))
        .withColumn("silence_reason", silence_reason(text, kind))
        .withColumnRenamed("call_type", "type")
        .drop("content")
    )


def android_messages(rows: DataFrame) -> DataFrame:
    typed = once(rows, "type", android_message_type(F.col("content")))
    return typed.withColumn("content", F.when(F.col("type") == "text", F.col("content")))


def _people(lines, platform, people, keys):
    return people if people is not None else people_ops.from_lines(lines, platform, keys)


def parse_lines(
    lines: DataFrame,
    platform: str,
    people: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Messages of raw lines.  ``people`` (keys, participant) is derived when not given."""
    if platform == "ios":
        rows = ios_messages(route(split_ios(lines, keys)))
    elif platform == "android":
        rows = android_messages(split_android(lines, keys))
    else:
        raise ValueError(f"unknown platform {platform!r}")
    people = _people(lines, platform, people, keys)
    return with_receiver(rows, people, keys, blocks_from=lines).select(
        *keys, "seq", "sender", "receiver", "content", "ts", "type"
    )


def parse_calls(
    lines: DataFrame,
    platform: str = "ios",
    people: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Calls of raw lines.  The dashed export records none, so its result is empty."""
    if platform == "ios":
        rows = ios_calls(route(split_ios(lines, keys)))
    elif platform == "android":
        rows = ios_calls(route(split_android(lines, keys))).where(F.lit(False))
    else:
        raise ValueError(f"unknown platform {platform!r}")
    people = _people(lines, platform, people, keys)
    return with_receiver(rows, people, keys, blocks_from=lines).select(
        *keys, "seq", "sender", "receiver", "duration", "type", "group_call_invites",
        "silence_reason", "ts",
    )
