"""Mixing sources to target weights along a curriculum whose weights change over time.

1. A document's size is its number of words.  Sources share ``share`` times all words by weight;
   no source gives more than ``most`` times its own words, and what it can't give is shared among
   the others by weight (the level at which this comes to rest is found by sorting the sources by
   the level at which each is full).
2. Within a source, documents follow one another in the order of a hash of their id.  A source's
   demand is met by running through that order again and again until its target is reached; the
   document at the end gives only the words still missing.
3. A source's weight at training time t in [0, 1] is its mean weight times 1 + tilt * (2t - 1).  The
   integral over time is its cumulative token demand; inverting it at the middle of a document gives
   the document's training position.
4. Documents are range-sorted by position.

Running sums over a source that holds a third of all rows are made in two steps: sums per 1/4096 of
the hash range, running sums over those, and windows inside one such bucket.  The tables of sources
and of (source, bucket) are aggregates made before anything is ordered as a whole.  Only DataFrame
functions are used.

Null texts have size 0; a null source is a source of its own, the last one.  Rows with equal ids are
rows of their own.  Sources without words get target 0, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import WORD, aside, without

WEIGHTS = (3, 1, 2)
TILTS = (0.5, 0.0, -0.5)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Hex digits of the order hash that make a bucket.
DIGITS = 3


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0))


def sized(docs: DataFrame) -> DataFrame:
    """Adds _size, _group (sorts like source, null last), _key (order in the source) and _bucket."""
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")))
    return docs.withColumns(
        {
            "_size": size_of("text"),
            "_group": F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")),
            "_key": key,
            "_bucket": F.substring(key, 1, DIGITS),
        }
    )


def _pick(values, rank):
    at = F.pmod(F.col(rank) - 1, F.lit(len(values)))
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(at == i, F.lit(v)).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share=SHARE, most=MOST) -> DataFrame:
    """(_group, source_size, target, tilt): one row per source."""
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_group")))
        .withColumns({"_w": _pick(weights, "_rank"), "tilt": _pick(tilts, "_rank")})
        .withColumn("_full", most * F.col("source_size") / F.col("_w"))
    )
    earlier = Window.orderBy("_full", "_group").rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce(F.sum(most * F.col("source_size")).over(earlier), F.lit(0))
    left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    level = (share * F.sum("source_size").over(everything) - given) / left
    leveled = ranked.withColumn("_level", level)
    # the level rises while full sources drop out and falls afterwards
    found = F.max(F.expr("CASE WHEN _level <= _full THEN _level END")).over(everything)
    target = F.least(F.col("_w") * F.coalesce(found, F.lit(0.0)), most * F.col("source_size").cast("double"))
    return leveled.select("_group", "source_size", F.round(target, 6).alias("target"), "tilt")


def plan(docs: DataFrame, **how) -> DataFrame:
    """Every row of ``docs`` plus _size, source_size, target, tilt, _epochs, _rest, _before.

    A row is taken _epochs times whole, then _rest words of it once more; _before words of its
    source come before it in every epoch.
    """
    rows = sized(docs)
    buckets = rows.groupBy("_group", "_bucket").agg(F.sum("_size").alias("_words"))
    sources = targets(buckets.groupBy("_group").agg(F.sum("_words").alias("source_size")), **how)
    upto = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("_start", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
        .drop("_words")
        .join(sources, "_group")
    )
    inside = (
        Window.partitionBy("_group", "_bucket")
        .orderBy("_key", "doc_id", "_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(starts, ["_group", "_bucket"])
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .withColumn(
            "_epochs",
            F.when(F.col("source_size") > 0, F.expr("CAST(floor(target / source_size) AS BIGINT)")).otherwise(0),
        )
        .withColumn("_rest", F.expr("greatest(0L, least(_size, CAST(floor(target) AS BIGINT) - _epochs * source_size - _before))"))
        .withColumn("taken", F.expr("_epochs * _size + _rest"))
        .drop("_start", "_key", "_bucket", "_group")
    )


#: Training time at which the words before the middle of a copy have been asked for.
def _position(epoch: str, words: str) -> str:
    u = f"(({epoch} * source_size + _before + {words} / 2.0) / target)"
    root = f"sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * {u})"
    return f"round(CASE WHEN tilt = 0 THEN {u} ELSE ({root} - (1 - tilt)) / (2 * tilt) END, 9)"


#: Columns that ``plan`` and ``mixture`` add on their way.
OWN = (
    "_size", "_group", "_key", "_bucket", "_start", "_before", "_epochs", "_rest", "_epoch",
    "source_size", "target", "tilt", "taken", "copy_words", "position",
)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix: one row per copy (columns of docs, copy_words, position), range-sorted by position.

    Columns of ``docs`` may have any names; one called copy_words or position gives way to ours.
    """
    docs, kept = aside(without(docs, "copy_words", "position"), OWN)
    planned = plan(docs, **how)
    copies = planned.withColumn(
        "_epoch", F.explode(F.expr("sequence(0, CAST(_epochs + CASE WHEN _rest > 0 THEN 0 ELSE -1 END AS INT))"))
    ).where("_epoch >= 0 AND taken > 0")
    placed = copies.withColumn(
        "copy_words", F.expr("CASE WHEN _epoch < _epochs THEN _size ELSE _rest END")
    ).withColumn("position", F.expr(_position("_epoch", "copy_words")))
    return (
        placed.select(*kept, "copy_words", "position")
        .repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
    )


def mixing(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy (null: not taken)."""
    first = _position("0", "(CASE WHEN _epochs > 0 THEN _size ELSE _rest END)")
    return (
        plan(docs.select("doc_id", "source", "text"))
        .select(
            "doc_id",
            F.col("_size").alias("size"),
            "source_size",
            "target",
            "taken",
            F.expr(f"CASE WHEN taken > 0 THEN {first} END").alias("position"),
        )
        .repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"))
        .sortWithinPartitions(F.col("position").asc_nulls_last(), F.col("doc_id"))
    )


_FIRST = _position("0", "(CASE WHEN _epochs > 0 THEN size ELSE _rest END)")
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS g, md5('{SEED}:' || doc_id::VARCHAR) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT g, sum(size)::BIGINT AS source_size FROM d GROUP BY g),
r AS (SELECT *, row_number() OVER (ORDER BY g) AS n FROM s),
w AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1] AS w, [0.5::DOUBLE, 0.0, -0.5][(n - 1) % 3 + 1] AS tilt FROM r),
f AS (SELECT *, 2 * source_size / w::DOUBLE AS f FROM w),
v AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(2 * source_size) OVER e, 0)::BIGINT)
            / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER e, 0))::BIGINT AS v
  FROM f WINDOW e AS (ORDER BY f, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT g, source_size, tilt,
         round(least(w * coalesce((SELECT max(v) FROM v WHERE v <= f), 0), 2.0::DOUBLE * source_size), 6) AS target
  FROM v),
p AS (
  SELECT doc_id, size, source_size, tilt, target,
         coalesce(sum(size) OVER (PARTITION BY g ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS _before,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS _epochs
  FROM d JOIN t USING (g)),
q AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - _epochs * source_size - _before)) AS _rest FROM p)
SELECT doc_id, size, source_size, target, _epochs * size + _rest AS taken,
       CASE WHEN _epochs * size + _rest > 0 THEN {_FIRST} END AS position
FROM q"""
