"""Classifier: projections, cosines and votes against plain loops."""

import math

import numpy as np

from parlance.llm import quality_classifier as Q


def loops(text, directions):
    rows, feature, weight = Q.sparse([text])
    out = [0.0] * directions.shape[1]
    for f, w in zip(feature.tolist(), weight.tolist()):
        for j in range(len(out)):
            out[j] += float(directions[f][j]) * w
    norm = max(math.sqrt(sum(x * x for x in out)), 1e-9)
    return [x / norm for x in out]


def test_scores_equal_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    directions, labelled, marks = Q.fit(docs, labels)
    scored = {r["doc_id"]: r for r in Q.score(docs, labels).collect()}
    assert len(scored) == docs.count() and np.allclose(np.linalg.norm(labelled, axis=1), 1, atol=1e-4)
    for doc in sorted(scored)[::20]:
        vector = loops((scored[doc]["text"] or "").encode(), directions)
        cosines = [sum(a * b for a, b in zip(vector, map(float, row))) for row in labelled]
        near = sorted(range(len(marks)), key=lambda i: -cosines[i])[: Q.NEAREST]
        weight = [max(cosines[i], 0.0) ** Q.SHARPNESS for i in near]
        vote = sum(w * marks[i] for w, i in zip(weight, near)) + 1e-9 * float(np.mean(marks))
        assert abs(vote / (sum(weight) + 1e-9) - scored[doc]["score"]) < 0.02


def test_labels_of_held_out_rows_are_never_learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    score = lambda y: {r["doc_id"]: r["score"] for r in Q.score(docs.select("doc_id", "text"), y).collect()}
    assert score(labels) == score(turned)
