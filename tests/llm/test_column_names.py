"""Columns of the input may be called like those that an operator adds."""

import public_tokenizers
from pyspark.sql import functions as F

from parlance.llm import fingerprints, mixing, quality_classifier, simhash, token_counts
from parlance.llm.queries import RANKS

TEXTS = ["one two three four", "five six", None, "", "one two three four", "seven eight nine ten eleven"]


def docs(spark, *names):
    base = spark.createDataFrame(
        [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string"
    )
    return base.select("*", *[F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in names])


def plain(rows, names):
    return sorted(map(str, rows.select(*names).collect()))


def test_mixture(spark):
    names = [n.upper() if i % 2 else n for i, n in enumerate(mixing.OWN)] + ["target_"]
    d = docs(spark, *names)
    out, base = mixing.mixture(d), docs(spark)
    own = [c for c in d.columns if c.lower() not in ("copy_words", "position")]
    assert out.columns == [*own, "copy_words", "position"]
    shown = ["doc_id", "copy_words", "position"]
    assert plain(out, shown) == plain(mixing.mixture(base), shown) and out.count()
    assert all(r[n] == f"{n} of {r['doc_id']}" for r in out.collect() for n in own if n not in base.columns)
    assert mixing.mixture(d.limit(0)).count() == 0


def test_one_of_each(spark):
    names = ["__fp", "__ID", "__f", "__root", "__n", "__n_"]
    out = simhash.one_of_each(docs(spark, *names))
    assert out.columns == docs(spark, *names).columns
    assert plain(out, ["doc_id"]) == plain(simhash.one_of_each(docs(spark)), ["doc_id"])
    assert all(r[n] == f"{n} of {r['doc_id']}" for r in out.collect() for n in names)


def test_added_columns_take_the_place_of_others(spark):
    pattern, base = public_tokenizers.PATTERN, docs(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    for names, run in (
        (["lengths", "COUNTS", "n_tokens"], lambda d: token_counts.trees(d, RANKS, pattern)),
        (["fp"], simhash.fingerprinted),
        (["fingerprint"], fingerprints.fingerprint),
        (["Score"], lambda d: quality_classifier.score(d, labels)),
    ):
        out, want = run(docs(spark, *names, "other")), run(base)
        assert out.columns == [*base.columns, "other", *want.columns[4:]]
        assert plain(out, want.columns) == plain(want, want.columns)


def test_edits_of_states_with_edits(spark):
    state = token_counts.trees(docs(spark, "edits"), RANKS, public_tokenizers.PATTERN)
    edits = spark.createDataFrame(
        [(1, 0, 0, 4, "six")], "doc_id bigint, seq int, start bigint, length bigint, replacement string"
    )
    out = token_counts.apply_edits(token_counts.with_edits(state, edits), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["text"] for r in out.collect()}[1] == "six six"
