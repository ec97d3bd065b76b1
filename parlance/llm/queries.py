"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers

from parlance.llm import collocations, fingerprints, line_dedup, merkle, mixing, pii, quality_classifier, quality_rules, sentencepieces, simhash, substring_dedup, suffix_dedup, token_counts
from parlance.llm.common import documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES = {
    "op1_substring_dedup": lambda spark, sf_dir: substring_dedup.substring_dedup(documents(spark, sf_dir)),
    "op2_simhash": lambda spark, sf_dir: simhash.simhash(documents(spark, sf_dir)),
    "op3_quality_rules": lambda spark, sf_dir: quality_rules.quality_rules(documents(spark, sf_dir)),
    "op8_quality_classifier": lambda spark, sf_dir: quality_classifier.quality_classifier(
        spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ),
    "op4_sentencepieces": lambda spark, sf_dir: sentencepieces.sentencepieces(documents(spark, sf_dir), PIECES),
    "op5_line_dedup": lambda spark, sf_dir: line_dedup.line_dedup(documents(spark, sf_dir)),
    "op6_suffix_dedup": lambda spark, sf_dir: suffix_dedup.suffix_dedup(documents(spark, sf_dir)),
    "op7_mixing": lambda spark, sf_dir: mixing.mixing(documents(spark, sf_dir)),
    "op9_token_counts": lambda spark, sf_dir: token_counts.token_counts(
        documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN
    ),
    "op10_fingerprints": lambda spark, sf_dir: fingerprints.fingerprints(documents(spark, sf_dir)),
    "op11_pii": lambda spark, sf_dir: pii.pii(documents(spark, sf_dir)),
    "op12_collocations": lambda spark, sf_dir: collocations.collocations(documents(spark, sf_dir)),
    "op13_merkle": lambda spark, sf_dir: merkle.merkle(documents(spark, sf_dir)),
}

ORACLE = {
    "op3_quality_rules": quality_rules.SQL,
    "op7_mixing": mixing.SQL,
    "op12_collocations": collocations.SQL,
    "op13_merkle": merkle.SQL,
}
