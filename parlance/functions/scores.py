"""Model outputs (arrays of logits) to labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.schema import CHAT_LANGUAGES, EMOTIONS, LANGUAGES, SENTIMENTS, TOXICITY_LABELS


def _labels(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def label_of_max(scores: Column, names: Sequence[str]) -> Column:
    """Label of the highest score, the first of equals."""
    at = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.when(scores.isNotNull(), F.get(_labels(names), at - 1))


def _let(value: Column, use) -> Column:
    """An expression of a value that is computed once, also inside per-element functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    exps = _let(
        F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))
    )

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return _let(total, lambda t: F.transform(e, lambda x: x / t))

    return _let(exps, shares)


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))


def sentiment_label(logits: Column, names: Sequence[str] = tuple(SENTIMENTS)) -> Column:
    """Softmax keeps the order of logits, so the label is read off them directly."""
    return label_of_max(logits, names)


def top_emotions(logits: Column, n: int = 3, names: Sequence[str] = EMOTIONS) -> Column:
    """Array of the ``n`` best (emotion, score): scores to four places, equals in label order."""
    scored = F.transform(
        F.arrays_zip(softmax(logits).alias("p"), _labels(names).alias("name")),
        lambda z, i: F.struct(
            (-F.round(z["p"], 4)).alias("neg"), i.alias("at"), z["name"].alias("name")
        ),
    )
    best = F.slice(F.sort_array(scored), 1, n)
    return F.transform(best, lambda s: F.struct(s["name"].alias("emotion"), (-s["neg"]).alias("score")))


def emotion_map(logits: Column, n: int = 3, names: Sequence[str] = EMOTIONS) -> Column:
    return F.map_from_entries(top_emotions(logits, n, names))


def toxicity(logits: Column, names: Sequence[str] = TOXICITY_LABELS) -> Column:
    """``struct(score, type)``: score of the label ``toxicity``; above 0.5 the best other label."""
    at = list(names).index("toxicity")
    rounded = F.transform(sigmoid(logits), lambda p: F.round(p, 4))
    others = F.filter(rounded, lambda _, i: i != at)
    score = F.get(rounded, F.lit(at))
    kind = label_of_max(others, [n for n in names if n != "toxicity"])
    return F.when(
        logits.isNotNull(), F.struct(score.alias("score"), F.when(score > 0.5, kind).alias("type"))
    )


def restrict_language(
    logits: Column, names: Sequence[str] = LANGUAGES, valid: Sequence[str] = CHAT_LANGUAGES
) -> Column:
    """Best label among the valid ones only; null when none is valid."""
    keep = [i for i, n in enumerate(names) if n in set(valid)]
    if not keep:
        return F.lit(None).cast("string")
    chosen = F.array(*[F.get(logits, F.lit(i)) for i in keep])
    return F.when(logits.isNotNull(), label_of_max(chosen, [names[i] for i in keep]))
