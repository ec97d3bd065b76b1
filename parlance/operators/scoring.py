"""Batch inference: a pluggable model loaded once per task, and the columns made from its logits.

``load`` is a function without arguments that returns a model: a callable from a list of texts to a
dict of (n, labels) arrays, one per head.  Only the text column travels to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import scores as S
from parlance.operators import workers
from parlance.schema import EMOTIONS, SENTIMENTS, TOXICITY_LABELS

Loader = Callable[[], Callable[[list], Mapping]]
BATCH = 32


def logits_udf(load: Loader, heads: Sequence[str], batch_size: int = BATCH):
    """Pandas UDF: text -> struct of one logits array per head (null for blank text)."""
    heads = tuple(heads)
    score = workers.score_series
    schema = T.StructType([T.StructField(h, T.ArrayType(T.DoubleType())) for h in heads])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield pd.DataFrame(score(texts, model, batch_size, heads), columns=list(heads))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def score_batch(
    rows: DataFrame, text_column: str, load: Loader, heads: Sequence[str], batch_size: int = BATCH
) -> DataFrame:
    """Add one logits array per head."""
    udf = logits_udf(load, heads, batch_size)
    scored = rows.withColumn("_scores", udf(F.col(text_column)))
    return scored.select(*rows.columns, *[F.col(f"_scores.{h}").alias(h) for h in heads])


#: The labels of the three heads of ``score_all``.
NAMES = {"sentiment": tuple(SENTIMENTS), "emotion": EMOTIONS, "toxicity": TOXICITY_LABELS}


def score_all(
    rows: DataFrame,
    load: Loader,
    text_column: str = "merged_content",
    batch_size: int = BATCH,
    names: Mapping[str, Sequence[str]] = NAMES,
) -> DataFrame:
    """Add ``sentiment``, ``emotion`` and ``toxicity`` in one pass over the text.

    ``names`` are the labels of each head in the order of the model's logits; one of the toxicity
    head is ``toxicity``.
    """
    heads = ("sentiment", "emotion", "toxicity")
    udf = logits_udf(load, heads, batch_size)
    logits = rows.withColumn("_scores", udf(F.col(text_column)))
    get = lambda head: F.col(f"_scores.{head}")
    return logits.select(
        *rows.columns,
        S.sentiment_label(get("sentiment"), names["sentiment"]).alias("sentiment"),
        S.emotion_map(get("emotion"), names=names["emotion"]).alias("emotion"),
        S.toxicity(get("toxicity"), names["toxicity"]).alias("toxicity"),
    )


def route_by_language(language: Column, text: Column, translation: Column) -> Column:
    """Translation for every language but English; null for blank text that needs one."""
    return F.when(language == "en", text).otherwise(translation)


# The prompt template of the translator and the shape of its answer.
TRANSLATION_PROMPT = "Hinglish:\n{text}\n\nEnglish:\n"
TRANSLATION_ANSWER = "(?d)^<bos>Hinglish:\n(.*)\nEnglish:\n(.*)"


def translation_prompt(text: Column) -> Column:
    before, after = TRANSLATION_PROMPT.split("{text}")
    return F.concat(F.lit(before), text, F.lit(after))


def translation_answer(output: Column) -> Column:
    """English part of a generated answer; null if it has another shape."""
    return F.when(output.rlike(TRANSLATION_ANSWER), F.regexp_extract(output, TRANSLATION_ANSWER, 2))
