"""Meeting places for repeated windows: where the indexes of two dedup operators get their input.

A window is a fixed number of consecutive symbols (words or bytes).  Every window has a seed, the
smallest hash among the grams (shorter runs of symbols) inside it, so equal windows have equal seeds
wherever they stand.  Neighbouring windows mostly share their seed; such a run of windows and all
its symbols is a segment.  Sending segments to shards by seed brings all occurrences of a window to
one shard, whose index then needs to know nothing of the rest of the corpus: work grows with the
input and not with documents x shards.

1. Documents are dealt into blocks of a few megabytes by a hash of their id.  The shuffled texts are
   read by all passes (equal exchanges of one query are reused).
2. ``seeds``: each block names its seeds and how often it has them; a seed that the whole corpus has
   once cannot belong to a repeated window.  (seed, block) pairs bound a hot seed by the blocks.
3. ``segments``: each block cuts the segments of the seeds that are left, equal ones once.
4. Segments meet by shard; equal ones of different blocks are merged, with a list of the blocks
   (one list per ``LISTS``-th of the blocks, so that none grows long); the operator's index finds
   which windows repeat.  A seed with more than ``HOT`` occurrences would make a large shard: each
   of its windows is sent on its own, to the shard of its own hash, where equal ones merge.
5. The findings go to the blocks on the list, which look their segments up by key and digest.

Everything is recomputed from the texts by set of documents, never by position in a partition, so
lost tasks repeat with the same outcome.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import block_count, by_value
from parlance.llm.textscan import BASES, mix, powers, prefix, utf8

by_value(__name__)

#: Bytes of text in a block.
BLOCK = 2 << 20
#: Occurrences of a seed beyond which its windows travel alone.
HOT = 16_384
#: Windows in a segment at most; longer runs (repetitive texts) are cut into overlapping pieces.
LONGEST = 256
#: Lists of blocks that a segment is merged to.
LISTS = 64
#: Id of documents without one: larger than all others.
NO_ID = (1 << 63) - 1


def sliding(pick, values, width):
    """np.minimum or np.maximum of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = pick(out[: len(out) - step], out[step:])
    return out


def gram_hashes(sums, gram):
    """span_hash of all runs of ``gram`` symbols."""
    down = powers(pow(BASES[0], -1, 1 << 64), len(sums) - gram)
    return mix((sums[gram:] - sums[:-gram]) * down)


def window_seeds(symbols, row, window, gram):
    """(starts of the windows inside one document each, their seeds).

    ``symbols`` are unsigned integers, ``row`` the document of each.
    """
    n = len(symbols)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = sliding(np.minimum, gram_hashes(prefix(symbols, BASES[0]), gram), window - gram + 1)
    inside = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    return inside, seeds[inside]


def ranges(first, count):
    """All numbers of the ranges that begin at ``first`` and have ``count`` members."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def places(starts, seeds, cold, hot):
    """(first window, last window, seed, is hot) of a block's segments.

    A run of neighbouring windows with one seed is a segment if the seed is cold, cut to LONGEST
    windows; of a hot seed every window is one.
    """
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    count, first, seed = np.diff(np.append(head, len(starts))), starts[head], seeds[head]
    is_cold, is_hot = np.isin(seed, cold), np.isin(seed, hot)
    parts = -(-count[is_cold] // LONGEST)
    begin = np.repeat(first[is_cold], parts) + LONGEST * ranges(np.zeros(len(parts), np.int64), parts)
    end = np.minimum(begin + LONGEST, np.repeat((first + count)[is_cold], parts)) - 1
    alone = ranges(first[is_hot], count[is_hot])
    return (
        np.concatenate([begin, alone]),
        np.concatenate([end, alone]),
        np.concatenate([np.repeat(seed[is_cold], parts), np.repeat(seed[is_hot], count[is_hot])]),
        np.concatenate([np.zeros(len(begin), bool), np.ones(len(alone), bool)]),
    )


def seed_rows(block, symbols, window, gram):
    """Seeds of a block with the number of places that have them.

    A gram is the seed of some window if the largest of the minima of the windows around it is its
    own hash.  Windows across two documents are looked at too: a seed too many does no harm.
    """
    width, n = window - gram + 1, len(symbols)
    found, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= window:
        grams = gram_hashes(prefix(symbols, BASES[0]), gram)
        none = np.zeros(width - 1, dtype=np.uint64)
        around = np.concatenate([none, sliding(np.minimum, grams, width), none])
        found, count = np.unique(grams[sliding(np.maximum, around, width) == grams], return_counts=True)
    return pa.table(
        {
            "seed": pa.array(found.view(np.int64)),
            "block": pa.array(np.full(len(found), block)),
            "n": pa.array(count.astype(np.int32)),
        }
    )


def digest(piece):
    """Tells the segments of one key apart; signed."""
    return xxhash.xxh3_64_intdigest(piece) - (1 << 63)


def block_id(table):
    return table.column("block")[0].as_py()


def sorted_docs(table):
    """(ids, texts as bytes) of a block, in an order that depends on the rows only."""
    ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
    texts = utf8(table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], dtype=np.int64), [texts[i] for i in order]


def blocked(docs: DataFrame):
    """((doc_id, text, block) rows, number of blocks)."""
    n = block_count(docs, BLOCK)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.select("doc_id", "text", F.pmod(place, F.lit(n)).alias("block")), n


def repeated(rows: DataFrame, seeds_of) -> DataFrame:
    """(block, seed, hot) of the seeds that occur more than once."""
    found = rows.groupBy("block").applyInArrow(seeds_of, "seed bigint, block bigint, n int")
    total = F.sum("n").over(Window.partitionBy("seed"))
    return found.withColumn("_all", total).where("_all > 1").select(
        F.col("block").alias("at"), "seed", (F.col("_all") > HOT).alias("hot")
    )


def split_hits(hits):
    seed = hits.column("seed").to_numpy(zero_copy_only=False) if len(hits) else np.zeros(0, np.int64)
    hot = hits.column("hot").to_numpy(zero_copy_only=False).astype(bool) if len(hits) else np.zeros(0, bool)
    seed = seed.astype(np.int64).view(np.uint64)
    return seed[~hot], seed[hot]


def covered(n, starts, window):
    """Mask of n symbols covered by the windows that begin at ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def mask_spans(mask):
    """(start, end) pairs of the true runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def segment_table(block, keys, hot, pieces, **columns):
    """The distinct segments of a block; ``columns`` are lists of their values."""
    return pa.table(
        {
            "key": pa.array(keys, pa.int64()),
            "hot": pa.array(hot, pa.bool_()),
            "segment": pa.array(pieces, pa.binary()),
            "at": pa.array(np.full(len(keys), block, dtype=np.int64)),
            **{name: pa.array(values, pa.int64()) for name, values in columns.items()},
        }
    )


def merged_segments(shard):
    """(distinct segments, number of the segment of each row) of a shard."""
    number = {}
    which = [number.setdefault(s, len(number)) for s in shard.column("segment").to_pylist()]
    return list(number), np.array(which, dtype=np.int64)


def answer_table(shard, segments, which, chosen, **columns):
    """Answers for the blocks of every row whose segment is ``chosen``; columns by segment."""
    rows = np.flatnonzero(chosen[which])
    blocks = shard.column("blocks").take(pa.array(rows)).to_pylist()
    rows = np.repeat(rows, [len(x) for x in blocks])
    digests = np.array([digest(s) if c else 0 for s, c in zip(segments, chosen)], dtype=np.int64)
    at = pa.array(rows)
    return pa.table(
        {
            "at": pa.array([b for x in blocks for b in x], pa.int64()),
            "key": shard.column("key").take(at),
            "hot": shard.column("hot").take(at),
            "digest": pa.array(digests[which[rows]]),
            **{name: pa.array(values).take(pa.array(which[rows])) for name, values in columns.items()},
        }
    )


def split_answers(rows, *names):
    """(cold keys, hot keys, (key, digest) -> answer) from the answers to a block."""
    key = rows.column("key").to_numpy(zero_copy_only=False).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    hot = rows.column("hot").to_numpy(zero_copy_only=False).astype(bool) if len(rows) else np.zeros(0, bool)
    values = zip(*(rows.column(n).to_pylist() for n in names))
    answers = dict(zip(zip(key.tolist(), rows.column("digest").to_pylist()), values))
    return np.unique(key[~hot]).view(np.uint64), np.unique(key[hot]).view(np.uint64), answers


def through_index(docs: DataFrame, *, seeds_of, segment_rows, merged, held, search, found, remove, result) -> DataFrame:
    """Run the steps of this module around an operator's index.

    ``segment_rows`` gets (documents, seeds) of a block and returns a ``segment_table`` with the
    columns ``held``, merged over blocks by ``merged``.  ``search`` gets the segments of a shard and
    returns an ``answer_table`` with the columns ``found``; ``remove`` gets the documents of a block
    and its answers.
    """
    rows, n = blocked(docs)
    hits = repeated(rows, seeds_of)
    at = rows.groupBy("block")
    segments = at.cogroup(hits.groupBy("at")).applyInArrow(
        segment_rows, f"key bigint, hot boolean, segment binary, at bigint, {held}"
    )
    shards = (
        segments.withColumn("shard", F.pmod(F.when(F.col("hot"), F.xxhash64("segment")).otherwise(F.xxhash64("key")), F.lit(n)))
        .repartition("shard")
        .groupBy("shard", "key", "hot", "segment", F.pmod("at", F.lit(LISTS)).alias("list"))
        .agg(F.collect_list("at").alias("blocks"), *merged)
    )
    answers = shards.groupBy("shard").applyInArrow(
        search, f"at bigint, key bigint, hot boolean, digest bigint, {found}"
    )
    return at.cogroup(answers.groupBy("at")).applyInArrow(remove, result)
