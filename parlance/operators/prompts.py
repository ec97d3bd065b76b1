"""Conversation-level prompts for a text-generation model (the generation itself is not built)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.blocks import BLOCK_ROWS, attach, block_of
from parlance.schema import KEYS

# Kind, text before the conversation, answer length.  {people} is the participants.
TEMPLATES = (
    ("tone", "Analyze the tone of this text: ", 50),
    ("topics", "Extract key topics from this text: ", 100),
    ("relationships", "Analyze the relationships between {people} based on this text: ", 150),
    ("language_used", "Detect the language(s) used in this text and return their ISO 639-1 codes: ", 50),
    ("humor_level", "Analyze the humor level in this text (low, medium, high): ", 50),
    ("cultural_backgrounds", "Infer the cultural backgrounds of {people} based on this text: ", 150),
    ("llm_insights", "Generate unique insights about this conversation: ", 200),
)


def combined_text(
    messages: DataFrame, keys: Sequence[str] = KEYS, part_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``keys, part, text``: all content of a chat in file order, joined by spaces.

    A chat of more than ``part_rows`` lines comes in several parts that follow one another, so no
    task and no row ever holds an unbounded chat.
    """
    pieces = F.sort_array(F.collect_list(F.struct("seq", "content")))
    return (
        messages.where(F.col("content").isNotNull())
        .groupBy(*keys, block_of(F.col("seq"), part_rows).alias("part"))
        .agg(F.array_join(F.transform(pieces, lambda p: p["content"]), " ").alias("text"))
    )


def heads(people: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, kind, head, max_length``: the instructions of every chat.

    With ``combined_text`` this is all a prompt is made of, each chat's text written once; a job that
    calls a model streams the parts of a chat after each head.
    """
    names = people.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("participant")), ", ").alias("_people")
    )
    table = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(t).alias("head"), F.lit(n).alias("max_length"))
            for k, t, n in TEMPLATES
        ]
    )
    head = F.replace(F.col("t.head"), F.lit("{people}"), F.col("_people"))
    return names.withColumn("t", F.explode(table)).select(
        *keys, F.col("t.kind").alias("kind"), head.alias("head"), F.col("t.max_length").alias("max_length")
    )


def prompts(
    messages: DataFrame,
    people: DataFrame,
    keys: Sequence[str] = KEYS,
    part_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Seven prompts per chat: ``keys, kind, part, prompt, max_length``.  Part 0 starts with the
    instruction; the parts of one kind, joined by a space, are the whole prompt.

    Every text is repeated per kind; see ``heads`` for the form without repetition.
    """
    texts = combined_text(messages, keys, part_rows)
    kinds = F.struct("kind", "head", "max_length")
    begun = heads(people, keys).groupBy(*keys).agg(F.collect_list(kinds).alias("_heads"))
    first = texts.groupBy(*keys).agg(F.min("part").alias("_first")).join(begun, list(keys))
    rows = attach(texts.withColumn("seq", F.col("part")), first, keys)
    return rows.withColumn("t", F.explode("_heads")).select(
        *keys,
        F.col("t.kind").alias("kind"),
        (F.col("part") - F.col("_first")).alias("part"),
        F.when(F.col("part") == F.col("_first"), F.concat(F.col("t.head"), F.col("text")))
        .otherwise(F.col("text"))
        .alias("prompt"),
        F.col("t.max_length").alias("max_length"),
    )


def split_topics(answer: Column) -> Column:
    """Topics of a generated answer."""
    return F.split(F.trim(answer), ", ")
