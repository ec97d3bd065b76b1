"""Substring dedup with one compressed FM-index per shard.

A window is 13 consecutive words of one document.  A word goes if a window that covers it also
starts in a document with a smaller id; windows are judged on the input.

Segments meet in shards by seed (see ``seeds``).  A shard numbers its words, concatenates its
distinct segments and builds an FM-index of them: the Burrows-Wheeler transform of the word numbers,
kept as a wavelet tree (one bit vector per bit of the numbers, packed 64 to a word with a running
count).  All segments are streamed through it from right to left, together: each step prepends a word
by two rank queries.  The match length, cut at 13, is the matching statistic; an interval of rows at
length 13 is a report, and before the next word the interval is widened to that of the first 12 words.
The smallest document id among the suffixes of the interval decides.

Null texts have no words.  Rows with equal ids don't dedup one another (neither id is smaller); rows
without id count as larger than all.  Columns other than doc_id and text are not looked at.
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
from parlance.llm.textscan import BASES, prefix, scan, span_hash

by_value(__name__)

WINDOW, GRAM = 13, 4
RESULT = "doc_id bigint, n_words bigint, removed array<struct<start:int,end:int>>, kept string"


def word_stream(texts):
    """(words joined by spaces, word starts in it, document and hash of each word)."""
    buffer, starts, ends, row = scan(texts)
    hashes = span_hash(prefix(buffer, BASES[0]), starts, ends, BASES[0])
    keep = np.zeros(len(buffer) + 1, dtype=np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends + 1, -1)
    mask = np.cumsum(keep[:-1]) > 0  # a word and the white space after it
    joined = buffer.copy()
    joined[ends] = 0x20
    return joined[mask].tobytes(), np.concatenate([[0], np.cumsum(ends - starts + 1)]), row, hashes


def seeds_of(docs):
    _, texts = sorted_docs(docs)
    return seed_rows(block_id(docs), word_stream(texts)[3], WINDOW, GRAM)


def pieces(docs, cold, hot):
    """Segments of a block: (document ids, texts, word data, first and last window, key, hot, bytes)."""
    ids, texts = sorted_docs(docs)
    stream = joined, at, row, hashes = word_stream(texts)
    first, last, key, alone = places(*window_seeds(hashes, row, WINDOW, GRAM), cold, hot)
    ends = at[last + WINDOW] - 1
    found = [joined[a:b] for a, b in zip(at[first].tolist(), ends.tolist())]
    return ids, texts, stream, first, last, key.view(np.int64).tolist(), alone.tolist(), found


def segment_rows(docs, hits):
    if not len(docs) or not len(hits):
        return segment_table(0, [], [], [], doc=[], n=[])
    ids, _, (_, _, row, _), first, _, key, hot, found = pieces(docs, *split_hits(hits))
    once = {}
    for k, h, piece, doc in zip(key, hot, found, ids[row[first]].tolist()):
        seen = once.get((k, h, piece))
        if seen is None:
            once[k, h, piece] = [doc, 1]
        else:
            seen[0], seen[1] = min(seen[0], doc), seen[1] + 1
    docs_n = list(once.values())
    return segment_table(
        block_id(docs), *([x[i] for x in once] for i in range(3)), doc=[v[0] for v in docs_n], n=[v[1] for v in docs_n]
    )


class Wavelet:
    """Rank queries over an integer sequence: a bit vector per bit, packed, with running counts."""

    def __init__(self, values, symbols):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, n = [], len(values)
        self.starts = np.zeros(symbols, dtype=np.int64)
        numbers = np.arange(symbols)
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = n - int(bit.sum())
            self.levels.append((level, packed, ones, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
            self.starts = self._down(self.levels[-1], numbers, self.starts)

    @staticmethod
    def _down(level, symbols, at):
        shift, packed, ones, zeros = level
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        rank = ones[word] + np.bitwise_count(packed[word] & below).astype(np.int64)
        return np.where((symbols >> shift) & 1, zeros + rank, at - rank)

    def rank(self, symbols, at):
        """How many of the first ``at`` values equal ``symbols``, for arrays of both."""
        for level in self.levels:
            at = self._down(level, symbols, at)
        return at - self.starts[symbols]


def doubled(rank, step):
    """Ranks by twice as many symbols."""
    key = rank.astype(np.int64) * (int(rank.max()) + 1) + np.roll(rank, -step)
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """FM-index of segments (rows of word numbers, 1 and up), each with a document id."""

    def __init__(self, words, owner, docs):
        """``words``: numbers with a 0 after each segment; ``owner``: the segment of each."""
        self.words, n = words, len(words)
        one = words
        two = doubled(one, 1)
        four = doubled(two, 2)
        eight = doubled(four, 4)
        # 16 symbols are enough: searches are at most WINDOW long
        order = np.argsort(doubled(eight, 8), kind="stable")
        nine_to_12 = np.roll(four, -8)[order]
        head, last = eight[order], np.roll(one, -12)[order]
        twelve = np.ones(n, dtype=bool)
        twelve[1:] = (head[1:] != head[:-1]) | (nine_to_12[1:] != nine_to_12[:-1])
        thirteen = twelve.copy()
        thirteen[1:] |= last[1:] != last[:-1]
        first = np.flatnonzero(twelve)
        group = np.cumsum(twelve) - 1
        self.low, self.high = first[group], np.append(first[1:], n)[group]
        first = np.flatnonzero(thirteen)
        self.least = np.minimum.reduceat(docs[owner[order]], first)[np.cumsum(thirteen) - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(words))])
        self.tree = Wavelet(words[order - 1], int(words.max()) + 1)

    def stream(self, patterns, lengths):
        """For segments laid end to end, the smallest document of every window (NO_ID elsewhere)."""
        out = np.full(len(patterns), NO_ID, dtype=np.int64)
        ends = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[order], lengths[order]
        low = np.zeros(len(lengths), dtype=np.int64)
        high = np.full(len(lengths), len(self.words), dtype=np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths, -step, side="left"))
            at = ends[:active] - 1 - step
            word = patterns[at]
            both = self.tree.rank(np.concatenate([word, word]), np.concatenate([low[:active], high[:active]]))
            low, high = self.before[word] + both[:active], self.before[word] + both[active:]
            if step >= WINDOW - 1:
                out[at] = self.least[low]
                low, high = self.low[low], self.high[low]
        return out


def numbered(segments):
    """(word numbers from 1 with a 0 after each segment, segment of each, plain numbers, lengths)."""
    buffer, starts, ends, row = scan(segments)
    one, two = (span_hash(prefix(buffer, b), starts, ends, b) for b in BASES)
    values, number = np.unique(one, return_inverse=True)
    same = np.full(len(values), 0, dtype=np.uint64)
    same[number] = two
    if (same[number] != two).any():  # two words with one hash: tell them apart by the other
        number = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    lengths = np.bincount(row, minlength=len(segments))
    plain = number.astype(np.int64) + 1
    places = np.arange(len(plain)) + row
    words = np.zeros(len(plain) + len(segments), dtype=np.int64)
    words[places] = plain
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    return words, owner, plain, lengths


def search_shard(shard):
    """What a block must know of its segments: smallest document, and the windows found before it."""
    segments, which = merged_segments(shard)
    docs = np.full(len(segments), NO_ID, dtype=np.int64)
    np.minimum.at(docs, which, shard.column("doc").to_numpy(zero_copy_only=False))
    often = np.bincount(which, shard.column("n").to_numpy(zero_copy_only=False))
    words, owner, plain, lengths = numbered(segments)
    found = FMIndex(words, owner, docs).stream(plain, lengths)
    earlier = found < np.repeat(docs, lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    chosen = (often > 1) | (np.add.reduceat(earlier.astype(np.int64), first[:-1]) > 0)
    bits = [
        np.packbits(earlier[first[i] : first[i + 1] - WINDOW + 1]).tobytes() if c else b"" for i, c in enumerate(chosen)
    ]
    return answer_table(shard, segments, which, chosen, first=docs, bits=bits)


def remove(docs, hits):
    """The documents of a block without their repeated words."""
    cold, hot, answers = split_answers(hits, "first", "bits")
    ids, texts, (joined, at, row, _), first, last, key, _, found = pieces(docs, cold, hot)
    gone = []
    for a, b, k, piece in zip(first.tolist(), last.tolist(), key, found):
        answer = answers.get((k, digest(piece)))
        if answer is None:
            continue
        smallest, bits = answer
        if ids[row[a]] > smallest:
            gone.append(np.arange(a, b + 1))
        else:
            gone.append(a + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a + 1)))
    mask = covered(len(row), np.concatenate(gone), WINDOW) if gone else np.zeros(len(row), dtype=bool)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    spans, kept = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        starts, ends = mask_spans(mask[a:b])
        spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
        left = zip([0, *ends.tolist()], [*starts.tolist(), b - a])
        kept.append(b" ".join(joined[at[a + s] : at[a + e] - 1] for s, e in left if e > s).decode())
    return pa.table(
        {
            "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
            "n_words": pa.array(np.diff(bounds)),
            "removed": pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))),
            "kept": pa.array(kept, pa.string()),
        }
    )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, removed (spans of words) and kept (the other words) of every row."""
    return through_index(
        docs,
        seeds_of=seeds_of,
        segment_rows=segment_rows,
        merged=[F.min("doc").alias("doc"), F.sum("n").alias("n")],
        held="doc bigint, n bigint",
        search=search_shard,
        found="first bigint, bits binary",
        remove=remove,
        result=RESULT,
    )


def substring_dedup(docs: DataFrame) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return dedup(docs).select(
        "doc_id", "n_words", length.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
