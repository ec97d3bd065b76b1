"""The full report: every statistic of a chat in one record.

Plain counts and sums come from one cube per table (see cube); only what needs tokens, the order of
messages or whole records reads the rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import call_stats, chat_stats, cube, mood
from parlance.operators.preprocess import preprocess
from parlance.plans.stored import stored
from parlance.plans.topk import top_n
from parlance.resources.phrases import PHRASES
from parlance.schema import KEYS, MISSED_CALL_TYPES
from parlance.sources.tables import write_json


def _listed(stats: DataFrame, name: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per chat: an array of the statistic's records, ordered by the given fields.  A
    leading minus sorts a count from high to low."""
    fields = [c for c in stats.columns if c not in keys]
    sort = [-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    sort = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(sort)])
    held = F.sort_array(F.collect_list(F.struct(sort.alias("o"), F.struct(*fields).alias("r"))))
    return stats.groupBy(*keys).agg(F.transform(held, lambda x: x["r"]).alias(name))


def _tagged(stats: DataFrame, tag: str, keys: Sequence[str]) -> DataFrame:
    fields = [c for c in stats.columns if c not in keys]
    return stats.select(*keys, F.struct(*fields).alias(tag))


def _gather(parts: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Bring one-row-per-chat frames together with one union and one grouping, not a join each."""
    names = [c for p in parts for c in p.columns if c not in keys]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def chat_summary(
    messages: DataFrame, people: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per chat with the message statistics."""
    listed = lambda stats, name, *order: _listed(stats, name, keys, order)
    facts = stored(cube.message_cube(messages, keys), "message_cube")
    of = lambda *columns: cube.slice_of(facts, keys, cube.MESSAGE_COLUMNS, columns)
    participant = F.col("sender").alias("participant")
    lengths = of("sender").select(*keys, "sender", (F.col("words") / F.nullif("said", F.lit(0))).alias("avg_words"))
    longest = of("sender").where(F.col("_order").isNotNull()).select(*keys, participant, "_order")
    media = of("sender", "type").where(F.col("type") != "text").select(*keys, "sender", "type", "n")
    wording = of("sender").select(*keys, participant, *PHRASES)
    return _gather(
        [
            listed(chat_stats.top_words(messages, keys=keys), "most_used_words_phrases", "rank"),
            listed(chat_stats.first_texter(messages, keys), "who_texts_first_most", "-days", "sender"),
            listed(lengths, "who_sends_longer_messages", "sender"),
            listed(chat_stats.longest_of(longest, messages, people, keys), "longest_message", "participant"),
            listed(chat_stats.reply_time(messages, people, keys=keys), "average_reply_time", "participant"),
            listed(chat_stats.with_absent(media, people, keys), "media_stats", "sender", "-n", "type"),
            listed(of("hour").where("hour IS NOT NULL").select(*keys, "hour", "n"), "most_active_chat_times", "hour"),
            listed(chat_stats.top_emojis(messages, keys=keys), "most_used_emojis", "rank"),
            listed(
                chat_stats.top_emojis_by_sender(messages, keys=keys, people=people),
                "most_used_emojis_by_sender", "sender", "rank",
            ),
            listed(
                chat_stats.zero_fill(people, wording, keys, **{kind: 0 for kind in PHRASES}), "insights", "participant"
            ),
        ],
        keys,
    )


def call_summary(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per chat with the call statistics."""
    listed = lambda stats, name, *order: _listed(stats, name, keys, order)
    facts = stored(cube.call_cube(calls, keys), "call_cube")
    of = lambda *columns: cube.slice_of(facts, keys, cube.CALL_COLUMNS, columns)
    mean = F.coalesce(F.col("seconds") / F.nullif("held", F.lit(0)), F.lit(0.0))
    missed = of("receiver", "type").where(F.col("type").isin(*MISSED_CALL_TYPES))
    mode = top_n(of("type"), 1, keys, [F.desc("n"), F.asc("type")])
    return _gather(
        [
            of().select(*keys, mean.alias("average_call_duration")),
            mode.select(*keys, F.col("type").alias("most_frequent_call_type")),
            of("date").groupBy(*keys).agg(F.avg("n").alias("average_call_frequency_per_day")),
            listed(
                missed.groupBy(*keys, "receiver").agg(F.sum("n").alias("n")), "missed_calls_per_participant", "-n", "receiver"
            ),
            listed(of("hour").select(*keys, "hour", "n"), "most_active_call_times", "-n", "hour"),
            _tagged(call_stats.longest_call(calls, keys), "longest_call_details", keys),
            listed(of("sender").select(*keys, "sender", "n"), "total_calls_per_participant", "-n", "sender"),
            listed(of("type").select(*keys, "type", "n"), "type_of_calls_count", "-n", "type"),
        ],
        keys,
    )


def deep_summary(scored: DataFrame, people: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per chat with the statistics over scored contexts."""
    listed = lambda stats, name, *order: _listed(stats, name, keys, order)
    facts = stored(cube.context_cube(scored, keys), "context_cube")
    of = lambda *columns: cube.slice_of(facts, keys, cube.CONTEXT_COLUMNS, columns)
    means = ((F.col("_sum") / F.nullif("_n", F.lit(0))).alias("_s"), (F.col("_toxic") / F.col("n")).alias("_t"))
    labels = of("sender", "sentiment").select(*keys, "sender", "sentiment", "n", "_sum", "_n")
    emotional = lambda kind: of("sender").select(*keys, F.col("sender").alias("participant"), F.col(f"_{kind}").alias("_hits"), "n")
    toxic = mood.toxicity_summary(scored, keys=keys).select(
        *keys, "rank", "sender", "receiver", "merged_content", "date", "sentiment",
        "toxicity_score", "toxicity_type",
        mood.emotions_str(F.col("emotion")).alias("emotions_str"),
    )
    return _gather(
        [
            listed(toxic, "toxicity_summary", "rank"),
            listed(mood.sender_means(labels, keys), "sentiment_summary", "sender", "sentiment"),
            listed(mood.rolling(of("date").select(*keys, "date", *means), keys=keys), "mood_trends", "date"),
            listed(mood.emotion_trend_wide(scored, keys=keys), "emotion_trend", "week"),
            listed(
                mood.binned(stored(of("week").select(*keys, "week", *means), "weeks"), keys), "mood_toxicity_heatmap", "week"
            ),
            listed(mood.emotion_score(emotional("love"), people, "love", keys), "love_score", "participant"),
            listed(mood.emotion_score(emotional("hate"), people, "hate", keys), "hate_score", "participant"),
        ],
        keys,
    )


def full_report(
    messages: DataFrame,
    people: DataFrame,
    calls: DataFrame | None = None,
    scored: DataFrame | None = None,
    dictionary: Mapping[str, str] | DataFrame | None = None,
    store: bool = True,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``keys, participants, chat_stats{overview, deep_analysis}, call_stats``.

    The overview describes the preprocessed text, as the analysis it follows does: pass the
    ``dictionary`` of abbreviations, or messages that are preprocessed already.  Inputs are read
    by many statistics; ``store`` writes them once first (leave it off for tables on disk).
    """
    keep = stored if store else (lambda rows, _: rows)
    people = keep(people, "people")
    rows = messages if dictionary is None else preprocess(messages, dictionary, keys=keys)
    rows = keep(rows, "messages")
    names = people.groupBy(*keys).agg(
        F.sort_array(F.collect_set("participant")).alias("participants")
    )
    nothing = F.lit(None).cast("string")
    parts = [names, _tagged(chat_summary(rows, people, keys), "overview", keys)]
    if scored is not None:
        deep = deep_summary(keep(scored, "scored"), people, keys)
        parts.append(_tagged(deep, "deep_analysis", keys))
    if calls is not None:
        parts.append(_tagged(call_summary(keep(calls, "calls"), keys), "call_stats", keys))
    report = _gather(parts, keys)
    for name in ("deep_analysis", "call_stats"):
        if name not in report.columns:
            report = report.withColumn(name, nothing)
    return report.select(
        *keys, "participants", F.struct("overview", "deep_analysis").alias("chat_stats"), "call_stats"
    )


#: What names an item of a section; its other fields are what is said about it (fixed values: the names
#: of sections and fields of a report).
ITEM_KEYS = {
    "most_used_words_phrases": ("rank",), "who_texts_first_most": ("sender",),
    "who_sends_longer_messages": ("sender",), "longest_message": ("participant",),
    "average_reply_time": ("participant",), "media_stats": ("sender", "type"),
    "most_active_chat_times": ("hour",), "most_used_emojis": ("rank",),
    "most_used_emojis_by_sender": ("sender", "rank"), "insights": ("participant",),
    "missed_calls_per_participant": ("receiver",), "most_active_call_times": ("hour",),
    "longest_call_details": (), "total_calls_per_participant": ("sender",),
    "type_of_calls_count": ("type",), "toxicity_summary": ("rank",),
    "sentiment_summary": ("sender", "sentiment"), "mood_trends": ("date",), "emotion_trend": ("week",),
    "mood_toxicity_heatmap": ("week",), "love_score": ("participant",), "hate_score": ("participant",),
}


def _entries(section: str, kind: T.DataType, value: Column) -> Column:
    """The entries (field, item, text, value) of a section of the report."""

    def entry(field, item, kind, value):
        number = isinstance(kind, T.NumericType)
        return F.struct(
            F.lit(field).alias("field"), item.cast("string").alias("item"),
            (F.lit(None) if number else value).cast("string").alias("text"),
            (value if number else F.lit(None)).cast("double").alias("value"),
        )

    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: entry(section, x, T.StringType(), x))
    if not isinstance(kind, (T.ArrayType, T.StructType)):
        return F.when(value.isNotNull(), F.array(entry(section, F.lit(""), kind, value)))
    keys = ITEM_KEYS[section]

    def of_record(fields, record):
        item = F.concat_ws("|", *[record[k].cast("string") for k in keys])
        return F.array(*[entry(f"{section}.{f.name}", item, f.dataType, record[f.name]) for f in fields if f.name not in keys])

    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), of_record(kind.fields, value))
    return F.flatten(F.transform(value, lambda x: of_record(kind.elementType.fields, x)))


def entries(report: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The report in long form: one row per chat, field and item with a text or a number."""
    found = [_entries("participants", report.schema["participants"].dataType, F.col("participants"))]
    for path in ("chat_stats.overview", "chat_stats.deep_analysis", "call_stats"):
        kind = report.select(path).schema[0].dataType
        if isinstance(kind, T.StructType):
            found += [_entries(f.name, f.dataType, F.col(path)[f.name]) for f in kind.fields]
    every = F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return report.select(*keys, F.explode(every).alias("e")).select(*keys, "e.*")


def save_report(report: DataFrame, path: str, by_chat: bool = False) -> None:
    """JSON lines, replacing an earlier report.  ``by_chat`` writes a folder per chat, which suits
    few chats only."""
    write_json(report, path, ["chat_id"] if by_chat else [])
