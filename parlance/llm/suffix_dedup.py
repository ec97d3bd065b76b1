"""Suffix-array dedup over a run-compressed Burrows-Wheeler transform.

A byte goes if a 200-byte string that covers it also starts anywhere else, in the same document or
another; strings are judged on the input and never cross documents.

Segments meet in shards by seed (see ``seeds``) with how often the corpus has them: whatever lies in
a segment that occurs twice repeats.  For the rest a shard sorts the suffixes of its distinct
segments (prefix doubling; only ties are sorted again) and takes the Burrows-Wheeler transform by
runs of equal bytes.  Only at run ends is anything sampled: the text position and the length of the
common prefix with the row on the other side of the run's border.  Between samples nothing has to be
compared, since inside a run the step to the byte before keeps neighbours together and lengthens
their common prefix by one: read in text order, a match length falls by one from position to
position until the next sample.  So the matching statistics (longest match elsewhere) of all
positions are streamed from the samples, of which repetitive texts have few, and lengths of 200 and
more are marks.

Null texts are empty.  Rows with equal ids are documents of their own.  Removing bytes may cut a
character, so what is left is binary.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_value
from parlance.llm.seeds import (
    NO_ID, answer_table, block_id, covered, digest, mask_spans, merged_segments, places,
    seed_rows, segment_table, sorted_docs, split_answers, split_hits, through_index, window_seeds,
)

by_value(__name__)

WINDOW, GRAM = 200, 48
RESULT = "doc_id bigint, n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary"


def byte_stream(texts):
    """(bytes with one byte after each text, document of each byte, of the byte after it none)."""
    data = b"\xff".join(texts) + b"\xff"
    length = np.array([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    row[np.cumsum(length) - 1] = -1 - np.arange(len(texts), dtype=np.int32)
    return data, row


def windows_of(texts):
    data, row = byte_stream(texts)
    return data, row, window_seeds(np.frombuffer(data, dtype=np.uint8), row, WINDOW, GRAM)


def seeds_of(docs):
    data, _ = byte_stream(sorted_docs(docs)[1])
    return seed_rows(block_id(docs), np.frombuffer(data, dtype=np.uint8), WINDOW, GRAM)


def pieces(docs, cold, hot):
    ids, texts = sorted_docs(docs)
    data, row, found = windows_of(texts)
    first, last, key, alone = places(*found, cold, hot)
    cut = [data[a : b + WINDOW] for a, b in zip(first.tolist(), last.tolist())]
    return ids, texts, row, first, last, key.view(np.int64).tolist(), alone.tolist(), cut


def segment_rows(docs, hits):
    once = {}
    if len(docs) and len(hits):
        *_, key, hot, found = pieces(docs, *split_hits(hits))
        for known in zip(key, hot, found):
            once[known] = once.get(known, 0) + 1
    block = block_id(docs) if once else 0
    return segment_table(block, *([x[i] for x in once] for i in range(3)), n=list(once.values()))


def settle(keys, base):
    """Ranks of keys, tied ones equal: ``base`` (of a group of neighbours in order) plus smaller keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    place = np.arange(len(keys))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), dtype=np.int64)
    if base is None:
        rank[order] = np.maximum.accumulate(np.where(new, place, 0))
        return rank
    base = base[order]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = base[1:] != base[:-1]
    within = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
    rank[order] = base + within
    return rank


def sorted_suffixes(symbols, owner):
    """(rank of every suffix, ranks by 8, 16, 32 ... symbols); borders between segments are all different.

    A rank is the number of smaller suffixes, so ties are settled inside their own range and the
    others are not touched again.
    """
    n = len(symbols)
    wide = np.concatenate([symbols, np.full(8, 0xFF, dtype=np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    ended = np.zeros(n, dtype=bool)
    for i in range(8):
        byte = wide[i : i + n]
        key = (key << np.uint64(8)) | np.where(ended, 0, byte).astype(np.uint64)
        ended |= byte == 0xFF
    rank = settle(key, None)
    # suffixes that reach their border within 8 bytes differ by segment
    short = np.flatnonzero(ended)
    rank[short] = settle((rank[short] << 32) | owner[short], rank[short])
    ranks, step = [], 8
    tied = np.arange(n)
    while True:
        tied = tied[np.bincount(rank, minlength=n)[rank[tied]] > 1]
        ranks.append(rank.astype(np.int32))
        if not len(tied):
            return rank, ranks
        after = rank[np.minimum(tied + step, n - 1)]
        rank[tied] = settle((rank[tied] << 32) | after, rank[tied])
        step *= 2


def common_prefix(symbols, ranks, a, b):
    """Length of the common prefix of suffix pairs, from the ranks by halving lengths and single bytes."""
    n = len(symbols)
    length = np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[level], 8 << level
        equal = rank[np.minimum(a + length, n - 1)] == rank[np.minimum(b + length, n - 1)]
        length += step * equal
    open_ = np.ones(len(a), dtype=bool)
    for _ in range(8):
        x, y = symbols[np.minimum(a + length, n - 1)], symbols[np.minimum(b + length, n - 1)]
        open_ &= (x == y) & (x != 0xFF)
        length += open_
    return length


def matching_statistics(symbols, owner, least=0):
    """Longest match of every suffix with another one, streamed from the samples at run ends; matches
    shorter than ``least`` may be given as shorter ones."""
    n = len(symbols)
    rank, ranks = sorted_suffixes(symbols, owner)
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    before = symbols[suffix - 1]
    border = before[1:] != before[:-1]
    border |= before[1:] == 0xFF  # borders are different symbols
    run_starts = np.flatnonzero(np.concatenate([[True], border]))
    run_ends = np.append(run_starts[1:] - 1, n - 1)
    best = np.zeros(n, dtype=np.int64)
    for rows, side in ((run_starts, -1), (run_ends, 1)):
        inside = np.flatnonzero((rows + side >= 0) & (rows + side < n))
        for level, by in enumerate(ranks):  # a sample that is too short is one by any length
            if 8 << level <= least:
                inside = inside[by[suffix[rows[inside]]] == by[suffix[rows[inside] + side]]]
        at, other = suffix[rows[inside]], suffix[rows[inside] + side]
        length = np.zeros(len(rows), dtype=np.int64)
        length[inside] = common_prefix(symbols, ranks, at, other)
        sampled = suffix[rows]
        order = np.argsort(sampled)
        sampled, length = sampled[order], length[order]
        which = np.searchsorted(sampled, np.arange(n), side="right") - 1
        streamed = np.where(which >= 0, length[which] - (np.arange(n) - sampled[which]), 0)
        best = np.maximum(best, streamed)
    return best


def search_shard(shard):
    """The windows that repeat, for every segment that has some."""
    segments, which = merged_segments(shard)
    often = np.bincount(which, shard.column("n").to_numpy(zero_copy_only=False)) > 1
    lengths = np.array([len(s) for s in segments])
    symbols = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    marks = matching_statistics(symbols, owner, WINDOW) >= WINDOW
    marks |= often[owner]
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    mine = [marks[first[i] : first[i] + n - WINDOW + 1] for i, n in enumerate(lengths.tolist())]
    chosen = np.array([m.any() for m in mine])
    return answer_table(shard, segments, which, chosen, bits=[np.packbits(m).tobytes() if c else b"" for m, c in zip(mine, chosen)])


def remove(docs, hits):
    """The documents of a block without their repeated bytes."""
    cold, hot, answers = split_answers(hits, "bits")
    ids, texts, row, first, last, key, _, found = pieces(docs, cold, hot)
    gone = []
    for a, b, k, piece in zip(first.tolist(), last.tolist(), key, found):
        answer = answers.get((k, digest(piece)))
        if answer is not None:
            gone.append(a + np.flatnonzero(np.unpackbits(np.frombuffer(answer[0], np.uint8), count=b - a + 1)))
    mask = covered(len(row), np.concatenate(gone), WINDOW) if gone else np.zeros(len(row), dtype=bool)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).tolist()
    spans, kept = [], []
    for a, b, text in zip(bounds[:-1], bounds[1:], texts):
        starts, ends = mask_spans(mask[a : b - 1])
        spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
        kept.append(b"".join(text[s:e] for s, e in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])))
    return pa.table(
        {
            "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes) and kept (the other bytes) of every row."""
    return through_index(
        docs,
        seeds_of=seeds_of,
        segment_rows=segment_rows,
        merged=[F.sum("n").alias("n")],
        held="n bigint",
        search=search_shard,
        found="bits binary",
        remove=remove,
        result=RESULT,
    )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return dedup(docs).select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
