"""Token counts that follow edits.

A document's state is a tree over its pre-tokens, the pieces that the tokenizer's pattern cuts a text
into and byte-pair merges never leave.  Leaves hold up to ``LEAF`` pre-tokens with their lengths and
token counts, inner nodes the sums of characters and tokens below them.

An edit (start, length, replacement, in characters of the text as it is by then) finds its place by
descending the sums.  The pattern looks at most ``CONTEXT`` characters beyond the end of a match and
never behind its start, so pre-tokens that end that far before the edit stay; matching goes on from
there through the replacement until a match ends, behind the edit, where an old pre-token ended.
Everything after that stays too.  Only the pre-tokens in between are encoded, and only the sums
above the touched leaves change.  A leaf that has grown too large has its tree built again.

A state travels as the lengths and counts of the pre-tokens.  Null texts count as empty.  Edits of a
null list change nothing; positions beyond the end mean the end.  Rows with equal ids are documents
of their own.  Each row is handled by itself, so there is nothing to shuffle; ``with_edits`` joins a
table of edits, those of one document in order in one row.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_value, without
from parlance.llm.textscan import slices

by_value(__name__)

LEAF = 64
CONTEXT = 2
#: Pre-tokens a task remembers the counts of.
CACHE = 200_000
#: Bytes of text in a slice.
PORTION = 4 << 20
EDIT = "struct<start:bigint,length:bigint,replacement:string>"


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks_path, pattern):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known = {}

    def count(self, piece):
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > CACHE:
                self.known.clear()
            n = self.known[piece] = 1 if piece.encode() in self.ranks else len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    def __init__(self, lengths, counts):
        self.build(lengths, counts)

    def build(self, lengths, counts):
        cuts = range(0, max(len(lengths), 1), LEAF)
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in cuts]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros((2, 2 * self.size), dtype=np.int64)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2

    def find(self, at):
        """(leaf, its first character) of a character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def refresh(self, leaf):
        node = self.size + leaf
        self.chars[node], self.tokens[node] = (sum(x) for x in self.leaves[leaf])
        while node > 1:
            node //= 2
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def flat(self):
        return tuple([x for leaf in self.leaves for x in leaf[side]] for side in (0, 1))

    @property
    def total(self):
        return int(self.tokens[1])


def split(text, counter):
    pieces = counter.pattern.findall(text)
    return list(map(len, pieces)), [counter.count(p) for p in pieces]


def edit(tree, text, start, length, replacement, counter):
    """Apply one edit; returns (new text, pre-tokens encoded)."""
    start = min(max(start, 0), len(text))
    length = min(max(length, 0), len(text) - start)
    new = text[:start] + replacement + text[start + length :]
    shift, safe = len(replacement) - length, start + len(replacement)
    keep = max(start - CONTEXT, 0)
    leaf, at = (0, 0) if not text else tree.find(min(keep, len(text) - 1))
    lengths, counts = tree.leaves[leaf]
    first = 0
    while first < len(lengths) and at + lengths[first] <= keep:
        at += lengths[first]
        first += 1
    # walk old ends and new matches side by side until they meet behind the edit
    old, i, old_end, fresh, met = leaf, first, at, [], False
    for match in counter.pattern.finditer(new, at):
        fresh.append(match.group())
        end = match.end()
        while old < len(tree.leaves) and old_end + shift < end:
            if i == len(tree.leaves[old][0]):
                old, i = old + 1, 0
                continue
            old_end += tree.leaves[old][0][i]
            i += 1
        if end >= safe and old_end + shift == end and old_end >= start + length:
            met = True
            break
    added = list(map(len, fresh)), [counter.count(p) for p in fresh]
    head = lengths[:first], counts[:first]
    if not met:
        old, i = len(tree.leaves) - 1, len(tree.leaves[-1][0])
    tail = tree.leaves[old] if old < len(tree.leaves) else ([], [])
    old = min(old, len(tree.leaves) - 1)
    joined = tuple(h + a for h, a in zip(head, added))
    if old == leaf:
        tree.leaves[leaf] = tuple(j + t[i:] for j, t in zip(joined, tail))
    else:
        tree.leaves[leaf] = joined
        for k in range(leaf + 1, old):
            tree.leaves[k] = ([], [])
        tree.leaves[old] = tuple(t[i:] for t in tail)
    if len(tree.leaves[leaf][0]) > 8 * LEAF:
        tree.build(*tree.flat())
    else:
        for k in range(leaf, old + 1):
            tree.refresh(k)
    return new, len(fresh)


def packed(values):
    return np.array(values, dtype="<u4").tobytes()


def unpacked(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def build_batches(batches, ranks_path, pattern, names):
    counter = Counter(ranks_path, pattern)
    for batch in slices(batches, "text", PORTION):
        lengths, counts, totals = [], [], []
        for text in batch.column("text").to_pylist():
            a, b = split(text or "", counter)
            lengths.append(packed(a))
            counts.append(packed(b))
            totals.append(sum(b))
        new = pa.array(lengths, pa.binary()), pa.array(counts, pa.binary()), pa.array(totals, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], [*names, "lengths", "counts", "n_tokens"])


def edit_batches(batches, ranks_path, pattern):
    counter = Counter(ranks_path, pattern)
    for batch in slices(batches, "text", PORTION):
        out = []
        for doc, text, a, b, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lengths", "counts", "edits"))):
            tree, done, text = Tree(unpacked(a), unpacked(b)), 0, text or ""
            before = tree.total
            for e in edits or []:
                text, n = edit(tree, text, e["start"], e["length"], e["replacement"] or "", counter)
                done += n
            lengths, counts = tree.flat()
            out.append((doc, text, packed(lengths), packed(counts), before, tree.total, done))
        names = ["doc_id", "text", "lengths", "counts", "n_tokens_before", "n_tokens", "n_encoded"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 3]
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` and the state: lengths, counts (of pre-tokens) and n_tokens (in place of
    columns of these names)."""
    docs = without(docs, "lengths", "counts", "n_tokens")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(
        lambda it: build_batches(it, ranks_path, pattern, names),
        f"{schema}, lengths binary, counts binary, n_tokens bigint",
    )


def with_edits(states: DataFrame, edits: DataFrame) -> DataFrame:
    """Join edits (doc_id, seq, start, length, replacement) to states, in the order of seq."""
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    lists = lists.withColumn("edits", F.expr("transform(edits, e -> struct(e.start, e.length, e.replacement))"))
    return without(states, "edits").join(lists, "doc_id", "left")


def apply_edits(states: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The new text and state of each row (doc_id, text, lengths, counts, edits), counts before and
    after, and how many pre-tokens had to be encoded."""
    rows = states.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lengths", "counts", "edits")
    return rows.mapInArrow(
        lambda it: edit_batches(it, ranks_path, pattern),
        "doc_id bigint, text string, lengths binary, counts binary, n_tokens_before bigint, n_tokens bigint, n_encoded bigint",
    )


#: Three edits of every document: cut 20 characters a third in, repeat the beginning in the middle,
#: replace 10 characters near the start.
SAMPLE_EDITS = f"""CAST(array(
  named_struct('start', n div 3, 'length', 20L, 'replacement', ''),
  named_struct('start', n div 2, 'length', 0L, 'replacement', substring(text, 1, 40)),
  named_struct('start', n div 5, 'length', 10L, 'replacement', ' 2026, it''s\\n\\n  new')
) AS array<{EDIT}>)"""


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.length("text").cast("bigint")).withColumn("edits", F.expr(SAMPLE_EDITS)).drop("n")
    return apply_edits(trees(rows, ranks_path, pattern), ranks_path, pattern).select(
        "doc_id",
        F.col("n_tokens_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        "n_encoded",
        F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"),
    )
