"""Replacing runs of tokens by a dictionary whose entries may have several words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens
from parlance.plans.blocks import hit_of, hits_per_block, packed, salted_lookup, salts_of
from parlance.plans.once import once
from parlance.schema import KEYS


def _run(words: Column, at: Column, length: Column) -> Column:
    """The tokens from place ``at`` (from 0) on, joined by one space."""
    return F.array_join(F.slice(words, at + 1, length), " ")


def _lengths(heads: Column, words: Column, token: Column, at: Column) -> Column:
    """How long a run from here on may be, longest first: no longer than an entry with this first
    token, nor than what is left."""
    longest = hit_of(heads, token)  # null if no entry begins like this; least() would pass over it
    down = F.sequence(F.least(longest, F.size(words) - at), F.lit(1), F.lit(-1))
    return F.when(longest.isNotNull(), down).otherwise(F.array().cast("array<int>"))


def _candidates(words: Column, heads: Column) -> Column:
    """The distinct runs of a text that may be entries."""
    at_each = F.transform(
        words, lambda t, i: F.transform(_lengths(heads, words, t, i), lambda n: _run(words, i, n))
    )
    return F.array_distinct(F.flatten(at_each))


def _matches(words: Column, heads: Column, hits: Column) -> Column:
    """(at, length, phrase) of the longest entry that begins at each place, where there is one."""

    def longest(t, i):
        tried = F.transform(
            _lengths(heads, words, t, i),
            lambda n: F.struct(i.alias("at"), n.alias("length"), hit_of(hits, _run(words, i, n)).alias("phrase")),
        )
        return F.get(F.filter(tried, lambda m: m["phrase"].isNotNull()), F.lit(0))

    return F.filter(F.transform(words, longest), lambda m: m.isNotNull())


def _leftmost(matches: Column) -> Column:
    """Those that do not begin inside an earlier one that stays, with the place where that one ends."""
    kind = "struct<end:int,kept:array<struct<at:int,length:int,phrase:string,after:int>>>"
    start = F.struct(F.lit(0).alias("end"), F.array().alias("kept")).cast(kind)

    def step(seen, m):
        placed = F.struct(m["at"].alias("at"), m["length"].alias("length"), m["phrase"].alias("phrase"), seen["end"].alias("after"))
        more = F.struct((m["at"] + m["length"]).alias("end"), F.concat(seen["kept"], F.array(placed)).alias("kept"))
        return F.when(m["at"] >= seen["end"], more.cast(kind)).otherwise(seen)

    return F.aggregate(matches, start, step)


def map_runs_by_table(
    rows: DataFrame, column: str, table: DataFrame, where: Column | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Replace runs of tokens that are entries of ``table(key, phrase)``, a table of any size.

    From left to right the longest entry that begins at a token is taken and the text goes on behind
    it; entries may have any number of words (white space counts as one space).  Tokens are rejoined
    by one space.  Rows failing ``where`` and null texts stay; entries without words or phrase are
    never used; of entries that are equal but for white space the first phrase in order is.

    The dictionary is walked like a trie of two levels, for the distinct tokens of a block of rows at
    a time: first the first words of entries, each with the length of its longest entry, then only
    the runs that begin with one and are no longer than that.
    """
    wanted = F.col(column).isNotNull() if where is None else F.col(column).isNotNull() & where
    wanted = F.coalesce(wanted, F.lit(False))
    split = once(table.where(F.col("phrase").isNotNull()).select("key", "phrase"), "_words", tokens(F.col("key")))
    entries = (
        split.where(F.size("_words") > 0)
        .groupBy(F.array_join("_words", " ").alias("key"), F.get("_words", F.lit(0)).alias("head"), F.size("_words").alias("length"))
        .agg(F.min("phrase").alias("phrase"))
    )
    heads = entries.groupBy(F.col("head").alias("key")).agg(F.max("length").alias("longest"))

    blocked, blocks = packed(rows, keys, "_block")
    salts = salts_of(blocks)
    blocked = blocked.withColumn("_wanted", wanted)
    texts = blocked.where("_wanted").select("_block", F.col(column).alias("_text"))
    first = texts.select("_block", F.explode(F.array_distinct(tokens(F.col("_text")))).alias("key")).distinct()
    opened = salted_lookup(first, heads, "key", ["_block"], salts=salts, how="inner")
    begun = hits_per_block(opened, "key", "longest", blocks)
    begun = begun.withColumnRenamed("_hits", "_heads")

    live = once(texts.join(begun, "_block"), "_words", tokens(F.col("_text")))
    asked = live.select("_block", F.explode(_candidates(F.col("_words"), F.col("_heads"))).alias("key")).distinct()
    met = salted_lookup(asked, entries.select("key", "phrase"), "key", ["_block"], salts=salts, how="inner")
    hits = begun.join(hits_per_block(met, "key", "phrase", blocks), "_block")

    tagged = blocked.join(hits, "_block", "left")
    tagged = once(tagged, "_words", F.when(F.col("_wanted"), tokens(F.col(column))))
    # blocks without an entry have no tables: a null array of matches, no replacement
    found = F.coalesce(_matches(F.col("_words"), F.col("_heads"), F.col("_hits")), F.array().cast("array<struct<at:int,length:int,phrase:string>>"))
    tagged = once(tagged, "_kept", _leftmost(found))
    words = F.col("_words")
    pieces = F.transform(
        F.col("_kept.kept"),
        lambda m: F.concat(F.slice(words, m["after"] + 1, m["at"] - m["after"]), F.array(m["phrase"])),
    )
    rest = F.slice(words, F.col("_kept.end") + 1, F.size(words))
    mapped = F.array_join(F.concat(F.flatten(pieces), rest), " ")
    return tagged.withColumn(column, F.when(F.col("_wanted"), mapped).otherwise(F.col(column))).select(*rows.columns)
