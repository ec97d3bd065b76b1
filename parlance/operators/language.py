"""Language and toxicity models by counting, trained on labelled tables.

They stand where published checkpoints would plug in and do not reproduce them.  A model is a table
of exact counts, one row per feature with a count per label, and a few totals.  Scoring makes a vector
of log terms per distinct word, however often the word is written: its features meet the model once.
Rows then only sum the vectors of their words, and partial sums leave one row of them per message and
task.  A small table of words is broadcast by the optimizer, a large one joined with its skew split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scores import restrict_language
from parlance.functions.text import is_blank, tokens
from parlance.plans.stored import stored

#: Documents' worth of prior belief in a word's toxicity.
SMOOTHING = 10
#: Labels that a model may have when they are not named.
MOST_LABELS = 1_000
ROW = ("chat_id", "seq")


@dataclass
class Counts:
    """``table``: feature and n_0, n_1 ... per label; totals per label (one number each)."""

    table: DataFrame
    labels: list
    totals: list[int]
    features: int


def count_features(
    rows: DataFrame,
    label: str,
    words: Column,
    expand: Callable[[Column], Column] | None = None,
    labels: Sequence | None = None,
) -> Counts:
    """Counts of the features of ``words`` per label; labels are few (``MOST_LABELS``).

    Words are counted first, so ``expand``, which makes a word's features, sees each word once.
    """
    rows = rows.where(F.col(label).isNotNull())
    if labels is None:
        found = rows.select(label).distinct().limit(MOST_LABELS + 1).collect()
        if len(found) > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels in {label}: name those that count")
        labels = sorted(r[0] for r in found)
    labels = list(labels)
    per_label = [F.count(F.when(F.col(label) == x, 1)).alias(f"n_{i}") for i, x in enumerate(labels)]
    counted = rows.select(label, F.explode(words).alias("feature")).groupBy("feature").agg(*per_label)
    if expand is not None:
        counted = (
            counted.withColumn("feature", F.explode(expand(F.col("feature"))))
            .groupBy("feature")
            .agg(*[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(labels))])
        )
    table = stored(counted, "counts")
    sums = table.agg(F.count(F.lit(1)), *[F.sum(f"n_{i}") for i in range(len(labels))]).first()
    return Counts(table, labels, [n or 0 for n in sums[1:]], sums[0])


def _summed(rows: DataFrame, row: Sequence[str], words: Column, table: DataFrame, terms: int) -> DataFrame:
    """Per row the sums of the terms _s0, _s1 ... that ``table`` has for its words (column word)."""
    said = rows.select(*[F.col(c).alias(f"_{c}") for c in row], F.explode(words).alias("word"))
    return (
        said.join(table, "word")
        .groupBy(*[f"_{c}" for c in row])
        .agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(terms)])
    )


def _joined(rows: DataFrame, sums: DataFrame, row: Sequence[str]) -> DataFrame:
    same = F.lit(True)
    for c in row:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(sums, same, "left").drop(*[f"_{c}" for c in row])


def word_trigrams(word: Column) -> Column:
    """Character trigrams of a word, its edges marked by a space."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def train_language(documents: DataFrame, text: str = "text", label: str = "lang") -> Counts:
    """Multinomial naive Bayes on character trigrams: their counts per language."""
    return count_features(documents, label, tokens(F.lower(text)), word_trigrams)


def detect_language(
    rows: DataFrame,
    model: Counts,
    text: str = "content",
    language: str = "language",
    valid: Sequence[str] | None = None,
    row: Sequence[str] = ROW,
) -> DataFrame:
    """Add the best language among ``valid`` (all the model knows when not given); null for blank
    text.  ``row`` names the rows' unique key.

    With add-one smoothing a trigram counts ln(n + 1) - ln(total + trigrams known) for a language;
    the second part is the same for all trigrams, so unknown ones need no join.
    """
    labels = range(len(model.labels))
    spoken = tokens(F.lower(F.coalesce(F.col(text), F.lit(""))))
    words = rows.select(F.explode(spoken).alias("word")).distinct()
    parts = words.select("word", F.explode(word_trigrams(F.col("word"))).alias("feature"))
    table = (
        parts.join(model.table, "feature")
        .groupBy("word")
        .agg(*[F.sum(F.log1p(f"n_{i}")).alias(f"_s{i}") for i in labels])
    )
    sums = _summed(rows, row, spoken, stored(table, "words"), len(model.labels))
    # a word has as many trigrams as characters
    size = F.aggregate(spoken, F.lit(0), lambda n, w: n + F.length(w))
    scores = [
        F.coalesce(f"_s{i}", F.lit(0.0)) - size * F.lit(math.log(max(total, 0) + max(model.features, 1)))
        for i, total in enumerate(model.totals)
    ]
    best = restrict_language(F.array(*scores), model.labels, valid or model.labels)
    return _joined(rows, sums, row).withColumn(language, F.when(~is_blank(F.col(text)), best)).select(
        *[c for c in rows.columns if c != language], language
    )


def distinct_words(text: Column) -> Column:
    return F.array_distinct(tokens(F.lower(text)))


def train_toxicity(documents: DataFrame, text: str = "text", label: str = "toxic") -> tuple[Counts, float]:
    """Documents per word and label, and the share of toxic documents."""
    known = documents.where(F.col(label).isNotNull())
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    return count_features(known, label, distinct_words(F.col(text)), labels=[0, 1]), share


def score_toxicity(
    rows: DataFrame, model: tuple[Counts, float], text: str = "content", row: Sequence[str] = ROW
) -> DataFrame:
    """Add ``toxicity_score`` to four places; null for blank text.

    Naive Bayes over the words a text has: each moves the log odds by how much the odds of its
    documents, smoothed to those of all, differ from those of all.
    """
    counts, share = model
    share = min(max(share, 1e-6), 1 - 1e-6)
    prior = math.log(share / (1 - share))
    term = F.log((F.col("n_1") + SMOOTHING * share) / (F.col("n_0") + SMOOTHING * (1 - share))) - F.lit(prior)
    table = counts.table.select(F.col("feature").alias("word"), term.alias("_s0"))
    sums = _summed(rows, row, distinct_words(F.coalesce(F.col(text), F.lit(""))), table, 1)
    odds = F.coalesce("_s0", F.lit(0.0)) + F.lit(prior)
    score = F.round(1 / (1 + F.exp(-odds)), 4)
    return _joined(rows, sums, row).withColumn(
        "toxicity_score", F.when(~is_blank(F.col(text)), score)
    ).select(*rows.columns, "toxicity_score")
