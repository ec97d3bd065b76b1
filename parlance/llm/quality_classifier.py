"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is described by its hashed words and by hashed word shapes (classes of its last bytes, all
capitals, length, same word again).  A singular value decomposition of a bounded sample of labelled
texts (``SAMPLE`` rows, a fixed choice by a hash of the id) gives ``RANK`` latent directions.  The
sample's unit vectors are broadcast: SAMPLE x RANK floats, about a megabyte at any corpus size.
Every document is projected and compared with all of them in blocks (exact cosines); the ``NEAREST``
most similar vote for their label with weight max(cosine, 0) ** SHARPNESS.

Labels are learnt only from rows whose crc32(doc_id) mod 4 is not 2; the score of a text uses the
text alone.  Null and empty texts have a length feature of their own, so they get a score like any
other text.  Without labels every score is 0.5.  Repeated rows get equal scores; ids labelled both
ways count as the better label.  All columns of the input are kept; the added ones must have names
of the caller's choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import by_value, without
from parlance.llm.textscan import BASES, mix, portions, prefix, scan, span_hash, utf8

by_value(__name__)

SAMPLE = 4_096
RANK = 48
NEAREST = 15
SHARPNESS = 6
WORD_DIMS, SHAPE_DIMS = 4_096, 1_024
CUTOFF = 0.7
PORTION = 1 << 20


def byte_classes():
    """Letters by case, digits, bytes of other alphabets; punctuation is a class each."""
    c = np.arange(256, dtype=np.uint64)
    c[97:123], c[65:91], c[48:58], c[128:] = 97, 65, 48, 97
    return c


def sparse(texts):
    """(row, feature, weight) of a list of byte strings; features are unique and sorted per row."""
    buffer, starts, ends, row = scan(texts)
    dims, n = WORD_DIMS + SHAPE_DIMS, len(texts)
    base = BASES[0]
    hashes = span_hash(prefix(buffer, base), starts, ends, base)
    classes = byte_classes()[buffer]
    capitals = np.concatenate([[0], np.cumsum((buffer >= 65) & (buffer <= 90))])
    size = ends - starts
    caps = (capitals[ends] - capitals[starts]) * 2 > size
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    shape = mix(
        classes[ends - 1]
        + np.uint64(256) * classes[np.maximum(ends - 2, starts)]
        + np.uint64(1 << 16) * (caps & (size > 1)).astype(np.uint64)
        + np.uint64(1 << 17) * again.astype(np.uint64)
        + np.uint64(1 << 18) * np.minimum(size // 4, 3).astype(np.uint64)
    )
    length = np.log2(np.bincount(row, minlength=n) + 1).astype(np.int64)
    features = np.concatenate(
        [
            row * dims + (hashes % np.uint64(WORD_DIMS)).astype(np.int64),
            row * dims + WORD_DIMS + 64 + (shape % np.uint64(SHAPE_DIMS - 64)).astype(np.int64),
            np.arange(n) * dims + WORD_DIMS + length,
        ]
    )
    key, count = np.unique(features, return_counts=True)
    rows, feature = key // dims, key % dims
    weight = np.sqrt(count).astype(np.float32)
    for part in (feature < WORD_DIMS, feature >= WORD_DIMS):
        norm = np.sqrt(np.bincount(rows[part], weight[part].astype(float) ** 2, minlength=n))
        weight[part] /= np.maximum(norm, 1e-9)[rows[part]]
    return rows, feature, weight


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def project(texts, directions):
    rows, feature, weight = sparse(texts)
    out = np.zeros((len(texts), directions.shape[1]), dtype=np.float32)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    for a, b in portions(np.diff(np.append(first, len(rows))), 1 << 16):
        lo, hi = first[a], first[b] if b < len(first) else len(rows)
        parts = directions[feature[lo:hi]] * weight[lo:hi, None]
        out[rows[first[a:b]]] = np.add.reduceat(parts, first[a:b] - lo, axis=0)
    return unit(out)


def vote(vectors, labelled, labels, block=1_024):
    k = min(NEAREST, len(labels))
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), block):
        cosines = vectors[at : at + block] @ labelled.T
        near = np.argpartition(cosines, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** SHARPNESS
        out[at : at + block] = ((weight * labels[near]).sum(1) + 1e-9 * labels.mean()) / (weight.sum(1) + 1e-9)
    return np.clip(out, 0.0, 1.0)


def score_batches(batches, model, text, name):
    directions, labelled, labels = model.value if hasattr(model, "value") else model
    for batch in batches:
        texts = utf8(batch.column(text))
        scores = np.full(len(texts), 0.5)
        if len(labels):
            for a, b in portions([len(t) for t in texts], PORTION):
                scores[a:b] = vote(project(texts[a:b], directions), labelled, labels)
        yield batch.append_column(name, pa.array(scores))


def sparse_batches(batches, text):
    for batch in batches:
        texts = utf8(batch.column(text))
        got = [], []
        for a, b in portions([len(t) for t in texts], PORTION):
            rows, feature, weight = sparse(texts[a:b])
            cut = np.searchsorted(rows, np.arange(1, b - a))
            got[0].extend(x.astype(np.int16).tobytes() for x in np.split(feature, cut))
            got[1].extend(x.astype(np.float32).tobytes() for x in np.split(weight, cut))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label").cast(pa.float64()), *(pa.array(x, pa.binary()) for x in got)],
            ["label", "feature", "weight"],
        )


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(directions, labelled unit vectors, labels) from at most ``sample`` labelled documents."""
    known = (
        labels.where(F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(known, "doc_id").select("label", "text")
    found = texts.mapInArrow(
        lambda it: sparse_batches(it, "text"), "label double, feature binary, weight binary"
    )
    # repeated ids could exceed the bound; the order makes the choice the same in every run
    rows = found.orderBy("label", "feature", "weight").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
    dims = WORD_DIMS + SHAPE_DIMS
    x = np.zeros((len(rows), dims), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["feature"], dtype=np.int16)] = np.frombuffer(r["weight"], dtype=np.float32)
    idf = np.log((1 + len(rows)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x *= idf
    rank = min(RANK, *x.shape)
    start = np.random.default_rng(0).standard_normal((dims, rank + 8)).astype(np.float32)
    basis = np.linalg.qr(x @ start)[0]
    for _ in range(3):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    right = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank]
    directions = np.ascontiguousarray((right * idf).T)
    labelled = unit(x @ right.T)
    return directions, labelled, np.array([r["label"] for r in rows])


def score(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus the score, in a column called ``name`` (in place of one of
    that name)."""
    docs = without(docs, name)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_docs if labelled_docs is not None else docs, labels))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(lambda it: score_batches(it, model, "text", name), schema)


def quality_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
    )
