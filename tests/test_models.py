import math
import random

import letters
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from parlance.functions import scores as S
from parlance.operators import language, learned, scoring, workers
from parlance.schema import EMOTIONS, TOXICITY_LABELS


def logits(spark, seed, n, width):
    rng = random.Random(seed)
    data = [(i, [rng.choice([rng.gauss(0, 3), float(rng.randrange(2))]) for _ in range(width)])
            for i in range(n)]
    return data, spark.createDataFrame([*data, (n, None)], "i int, x array<double>")


def test_post_processing(spark):
    data, df = logits(spark, 1, 50, 28)
    got = {r["i"]: r for r in df.select(
        "i", S.top_emotions(F.col("x")).alias("e"), S.sentiment_label(F.slice("x", 1, 5)).alias("s"),
        S.toxicity(F.slice("x", 1, 7)).alias("t"), S.restrict_language(F.slice("x", 1, 20)).alias("l"),
    ).collect()}
    assert got[50]["s"] is None and got[50]["t"] is None and got[50]["l"] is None
    assert not got[50]["e"]
    labels = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
    for i, x in data:
        total = sum(math.exp(v - max(x)) for v in x)
        soft = {e: round(math.exp(v - max(x)) / total, 4) for e, v in zip(EMOTIONS, x)}
        best = sorted(soft, key=soft.get, reverse=True)[:3]
        assert [(e["emotion"], round(e["score"], 4)) for e in got[i]["e"]] == [(e, soft[e]) for e in best]
        assert got[i]["s"] == labels[x.index(max(x[:5]))]
        tox = {k: round(1 / (1 + math.exp(-v)), 4) for k, v in zip(TOXICITY_LABELS, x)}
        score = tox.pop("toxicity")
        assert got[i]["t"]["score"] == score
        assert got[i]["t"]["type"] == (max(tox, key=tox.get) if score > 0.5 else None)
        assert got[i]["l"] == ("hi" if x[7] > x[4] else "en")
    nothing = df.select(S.restrict_language(F.slice("x", 1, 20), valid=["xx"]).alias("l"))
    assert nothing.where("l is not null").count() == 0


def test_scorer_keeps_rows_and_skips_blanks(spark):
    texts = ["abc", None, " ", "", "bbb", *["a" * i for i in range(1, 80)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)
    seen = scoring.score_batch(df, "t", letters.letters(h=3), ["h"], batch_size=4)
    got = {r["i"]: r["h"] for r in seen.collect()}
    for i, t in enumerate(texts):
        want = [10 * t.count(c) / len(t) for c in "abc"] if t and t.strip() else None
        assert (list(got[i]) if got[i] is not None else None) == want
    empty = scoring.score_all(df.where("i in (1, 2)"), letters.letters(**letters.HEADS), "t").collect()
    assert all(r["sentiment"] is None and r["emotion"] is None and r["toxicity"] is None for r in empty)


def test_language_model_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_fold", F.col("doc_id") % 5)
    model = language.train_language(docs.where("_fold > 0"))
    held = language.detect_language(docs.where("_fold = 0"), model, "text", "guess", row=["doc_id"])
    right = held.select(F.avg((F.col("guess") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.85
    only = language.detect_language(docs.where("_fold = 0"), model, "text", "guess", valid=["fr", "de"], row=["doc_id"])
    assert {r["guess"] for r in only.select("guess").distinct().collect()} <= {"fr", "de"}


def test_toxicity_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"
    )
    model = language.train_toxicity(docs)
    scored = language.score_toxicity(docs, model, "text", ["doc_id"]).withColumn("_y", F.col("toxic").cast("double"))
    auc = BinaryClassificationEvaluator(
        rawPredictionCol="toxicity_score", labelCol="_y"
    ).evaluate(scored)
    assert auc > 0.8


HEADS = {"quality": (0, 1), "toxic": (0, 1), "lang": ("de", "en", "es", "fr")}


def labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").withColumn("_fold", F.col("doc_id") % 4)


def test_learned_model_on_held_out_documents(spark):
    """Fitted on three quarters of the documents and scored by the batch scorer on the others."""
    docs = labelled(spark, "/root/testdata/sf0.01")
    weights = learned.fit(docs.where("_fold > 0"), HEADS)
    best = {h: S.label_of_max(F.col(h), [str(x) for x in names]) for h, names in HEADS.items()}
    rows = scoring.score_batch(
        docs.where("_fold = 0").select("doc_id", "text", *[F.col(h).cast("string").alias(f"true_{h}") for h in HEADS]),
        "text", learned.loader(weights), list(HEADS),
    )
    shares = rows.select(*[F.avg((best[h] == F.col(f"true_{h}")).cast("double")).alias(h) for h in HEADS]).first()
    assert shares["lang"] > 0.94 and shares["quality"] > 0.94
    # one labelled document in nine is toxic, so the order of the scores says more than a cutoff
    odds = rows.where("true_toxic IS NOT NULL AND toxic IS NOT NULL").select(
        (F.get("toxic", F.lit(1)) - F.get("toxic", F.lit(0))).alias("odds"), F.col("true_toxic").cast("double").alias("y")
    )
    assert BinaryClassificationEvaluator(rawPredictionCol="odds", labelCol="y").evaluate(odds) > 0.85


def test_learned_logits_equal_the_fitted_model(spark, sf):
    """Slots, lengths and weights of the batch scorer against Spark's own transformation."""
    docs = labelled(spark, sf).select("doc_id", "text", "lang")
    weights = learned.fit(docs, {"lang": HEADS["lang"]}, dim=512, iterations=3)
    rows = {r["position"]: r for r in weights.collect()}
    vectors = learned.features(docs, "text", "v", 512).collect()
    found = scoring.score_batch(docs.drop("lang"), "text", learned.loader(weights), ["lang"])
    got = {r["doc_id"]: r["lang"] for r in found.select("doc_id", F.col("lang")).collect()}
    for r in vectors:
        if got[r["doc_id"]] is not None:
            want = [rows[i]["intercept"] + r["v"].dot(rows[i]["weights"]) for i in range(4)]
            assert all(abs(a - b) < 1e-9 for a, b in zip(want, got[r["doc_id"]]))


def test_murmur(spark):
    words = ["", "a", "ab", "abc", "abcd", "abcdefghij", "\u00e9\u65e5\u672c", "x" * 1001]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.array("w").alias("_words"))
    from pyspark.ml.feature import HashingTF

    for r in HashingTF(numFeatures=1 << 20, inputCol="_words", outputCol="v").transform(got).collect():
        assert r["v"].indices.tolist() == [workers.murmur(r["w"].encode()) % (1 << 20)]


def test_learned_labels(spark):
    rows = spark.createDataFrame([("good day", "a", None), ("bad day", "b", None), (None, "a", "x")], "text string, h string, g string")
    weights = learned.fit(rows, {"h": ("a", "b", "c")}, dim=64)
    assert learned.labels_of(weights) == {"h": ["a", "b", "c"]}
    out = scoring.score_batch(rows.select("text"), "text", learned.loader(weights), ["h"]).collect()
    assert all(r["h"] is None or r["h"][2] == learned.ABSENT for r in out)
    with pytest.raises(ValueError):
        learned.loader(weights, most_bytes=10)
    with pytest.raises(ValueError):
        learned.fit(rows.where("g IS NULL"), {"g": ("x",)})


def test_labels_that_are_not_named_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LABELS", 3)
    rows = spark.createDataFrame([(f"w{i}", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError):
        language.train_language(rows)
    assert language.count_features(rows, "lang", language.tokens(F.col("text")), labels=["l0"]).labels == ["l0"]
