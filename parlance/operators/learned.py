"""Text classifiers that are fitted by Spark and scored by any batch scorer.

A text is a bag of hashed words: counts in ``dim`` slots, scaled to length 1.  Each head is a
multinomial logistic regression over them, so one pass over a text gives the logits of all heads.
Weights are a table, one row per head and label, which may be written and read like any other;
``loader`` makes of it what ``scoring`` loads once per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from parlance.functions.text import tokens
from parlance.operators import workers
from parlance.plans.stored import stored

DIM = 1 << 14
#: Bytes of weights that may travel to the tasks.
MOST_BYTES = 64 << 20
#: Heads that are fitted at a time.
SIDE_BY_SIDE = 4
#: Logit of a label that the training rows do not have.
ABSENT = -50.0
WEIGHTS = "head string, position int, label string, intercept double, weights array<double>"


def features(rows: DataFrame, text: str, name: str = "features", dim: int = DIM) -> DataFrame:
    """``rows`` with the vector of each text; a null or blank text has no words."""
    cut = rows.withColumn("_words", tokens(F.lower(F.coalesce(F.col(text), F.lit("")))))
    counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_counts").transform(cut)
    return Normalizer(p=2.0, inputCol="_counts", outputCol=name).transform(counted).drop("_words", "_counts")


def fit(
    rows: DataFrame,
    heads: Mapping[str, Sequence],
    text: str = "text",
    dim: int = DIM,
    iterations: int = 25,
    penalty: float = 1e-5,
) -> DataFrame:
    """The weights of a head per column of ``heads``, which names its labels in order.

    A head learns from the rows that have one of its labels; a label without rows gets a low logit.
    """
    known = stored(features(rows.select(text, *heads), text, "_features", dim).drop(text), "features")
    spark = rows.sparkSession
    # heads are independent and their jobs short, so they are fitted side by side
    run = inheritable_thread_target(spark)(lambda item: _fit_head(known, item[0], item[1], dim, iterations, penalty))
    with ThreadPoolExecutor(max(1, min(len(heads), SIDE_BY_SIDE))) as pool:
        out = [row for found in pool.map(run, heads.items()) for row in found]
    return spark.createDataFrame(out, WEIGHTS)


def _fit_head(known: DataFrame, head: str, labels: Sequence, dim: int, iterations: int, penalty: float) -> list[tuple]:
    """The rows of ``WEIGHTS`` of one head."""
    labels = [str(x) for x in labels]
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(head).cast("string")) - 1
    mine = known.select("_features", place.cast("double").alias("_label")).where("_label >= 0")
    if mine.isEmpty():
        raise ValueError(f"no rows are labelled for {head}")
    model = LogisticRegression(
        featuresCol="_features", labelCol="_label", family="multinomial", maxIter=iterations,
        regParam=penalty, standardization=False,
    ).fit(mine)
    matrix, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    present = {int(r["_label"]) for r in mine.select("_label").distinct().collect()}
    out = []
    for i, label in enumerate(labels):
        fitted = i in present
        weights = matrix[i] if fitted else np.zeros(dim)
        out.append((head, i, label, float(intercept[i]) if fitted else ABSENT, weights.tolist()))
    return out


def loader(weights: DataFrame, most_bytes: int = MOST_BYTES):
    """A loader for ``scoring.score_batch`` and ``score_all``.

    The size of the weights is checked before they reach the driver and the tasks.
    """
    size = weights.agg(F.sum(F.size("weights"))).first()[0] or 0
    if size * 8 > most_bytes:
        raise ValueError(f"{size * 8} bytes of weights, {most_bytes} may travel: fit with fewer slots")
    held = {}
    for r in weights.orderBy("head", "position").collect():
        held.setdefault(r["head"], []).append((r["intercept"], r["weights"]))
    packed = {h: (np.array([b for b, _ in x]), np.array([w for _, w in x]).T) for h, x in held.items()}
    sent = weights.sparkSession.sparkContext.broadcast(packed)
    model = workers.linear_model
    return lambda: model(sent.value)


def labels_of(weights: DataFrame) -> dict[str, list[str]]:
    """The labels of each head, in the order of its logits."""
    out = {}
    for r in weights.select("head", "position", "label").orderBy("head", "position").collect():
        out.setdefault(r["head"], []).append(r["label"])
    return out
