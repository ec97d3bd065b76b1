"""The whole analysis of a folder of exports, as one Spark job's worth of steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from parlance.operators import contexts, participants, parse, preprocess, report, scoring
from parlance.plans.blocks import tail
from parlance.plans.stored import stored
from parlance.schema import KEYS
from parlance.sources import exports


def analyze(
    spark: SparkSession,
    path: str,
    platform: str,
    *,
    abbreviations: Mapping[str, str] | DataFrame,
    load_model: scoring.Loader | None,
    chat_id: Column | None = None,
    spelling: DataFrame | None = None,
    sample_size: int | None = None,
    batch_size: int = scoring.BATCH,
    threshold: int = 60,
    context_column: str = "translated",
    detect: Callable[[DataFrame], DataFrame] | None = None,
    translation: Column | Mapping[str, str] | DataFrame | None = None,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Report per chat of the ``.txt`` and ``.zip`` exports under a file, folder or glob.

    A chat is named by its file unless ``chat_id`` says otherwise (text exports only).
    ``abbreviations`` is the dictionary to expand with (``sources.dictionaries`` reads a JSON file).
    ``sample_size`` keeps the last messages and calls of chats with more messages than that.
    ``load_model`` adds scored contexts; None means a report without them, there is no default model.
    Their text is cleaned: language (``detect``), spelling (only with a dictionary to correct by),
    translation, stop words.  Contexts over ``threshold`` minutes are made of ``context_column`` of
    the cleaned rows, the translated text without stop words or ``content``.
    """
    lines = stored(exports.scan(spark, path, chat_id), "lines")
    people = stored(participants.from_lines(lines, platform), "people")
    messages = parse.parse_lines(lines, platform, people)
    calls = parse.parse_calls(lines, platform, people)
    if sample_size:
        messages, calls = sample(stored(messages, "parsed"), calls, sample_size)
    messages = stored(preprocess.preprocess(messages, abbreviations), "messages")
    scored = None
    if load_model is not None:
        clean = stored(
            preprocess.clean_text(messages, spelling, detect, translation, stop_words=stop_words), "clean"
        )
        merged = stored(contexts.merge(clean, threshold, context_column), "contexts")
        scored = stored(
            scoring.score_all(merged.repartition(*KEYS, "sender", "start_ts"), load_model, batch_size=batch_size),
            "scored",
        )
    return report.full_report(
        messages, people, stored(calls, "calls"), scored, store=False
    )


def sample(messages: DataFrame, calls: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Last ``size`` messages per chat; calls are cut too, but only in chats that had more
    messages than that."""
    long = messages.groupBy(*KEYS).count().where(f"count > {int(size)}").select(*KEYS)
    cut = tail(calls, size, KEYS).join(long, list(KEYS), "left_semi")
    whole = calls.join(long, list(KEYS), "left_anti")
    return tail(messages, size, KEYS), whole.unionByName(cut)
