"""From raw documents to training tokens: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of ``documents``; the last one returns token ids.  ``run`` applies them to the documents of ``sf_dir``.

1. quality classifier: documents scored below its cutoff go.
2. line dedup: blocks of lines that an earlier document has go; n_chars follows the text.  A document
   that is nothing but such blocks stays with an empty text (all empty texts are one group below).
3. SimHash near-dedup: of each group of documents whose fingerprints over three-word shingles are linked
   at three or fewer differing bits, one stays.
4. mixing sources to target weights: documents leave their source's queue as often as its target asks
   (none to two times) and are ordered by training position.  A copy that the target would cut short
   is taken whole if at least half of it is asked for.
5. SentencePiece encoding and decoding of every row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import line_dedup, mixing, quality_classifier, sentencepieces, simhash
from parlance.llm.common import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.score(docs, labels, name="__score")
    return scored.where(F.col("__score") >= quality_classifier.CUTOFF).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = mixing.size_of("text")
    return mixing.mixture(docs).where(2 * F.col("copy_words") >= size).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokens),
]

#: Scores and token ids have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
