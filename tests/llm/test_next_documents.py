"""Who follows whom among sparse, repeated and missing ids; phrases by a plain parse."""

import collections
import random

import pytest

from parlance.llm import fingerprints as P


def phrases(text):
    """Phrases of LZ78 by the book: shortest piece not seen before."""
    seen, piece = set(), ""
    for c in text:
        piece += c
        if piece not in seen:
            seen.add(piece)
            piece = ""
    return seen


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


def test_sparse_ids(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), f"{i} text {rng.random()}") for i in range(1_000)]
    found = {r["doc_id"]: r for r in P.with_edits(table(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for (doc, text), (_, other) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        assert found[doc]["edited"] == text[: len(text) - third] + other[:third]
        # fewer than K phrases: the likeness is exact
        assert found[doc]["near_next"] == pytest.approx(jaccard(phrases(text), phrases(other)))
        assert found[doc]["near_edited"] == pytest.approx(jaccard(phrases(text), phrases(found[doc]["edited"])))


@pytest.mark.parametrize("piece", [P.COPIES, 7])
def test_rows_without_id(spark, monkeypatch, piece):
    """Ten thousand of them, most of them equal, are as many rows, in one cycle behind the others."""
    monkeypatch.setattr(P, "COPIES", piece)
    texts = ["same text here"] * 9_000 + [None] * 500 + [""] * 400 + [f"other {i} texts" for i in range(100)]
    named = [(5, "five and more"), (900, "nine hundred")]
    out = P.with_edits(table(spark, [(None, t) for t in texts] + named)).collect()
    nameless = [r for r in out if r["doc_id"] is None]
    assert len(nameless) == len(texts) and len(out) == len(texts) + 2
    assert sum(r["n_chars"] for r in nameless) == sum(len(t or "") for t in texts)
    same = collections.Counter(r["edited"] for r in nameless if r["fingerprint"] == P.hexed(P.print_of("same text here")))
    assert same["same text " + "same"] == 8_999 and sum(same.values()) == 9_000
    by_id = {r["doc_id"]: r["edited"] for r in out if r["doc_id"] is not None}
    assert by_id[900] == "nine hun" + "five"
    # the last row without id is followed by the first document of all
    assert sum(r["near_next"] == 1.0 for r in nameless) >= 9_897
