"""Line dedup by pairwise alignment.

1. Lines with a word are hashed (128 bits), and so are runs of lines: the shortest ones that begin at a
   line and the shortest ones that end at it with ``MIN_WORDS`` words or more.  Counting the documents of
   every line and run names those that two or more have and each one's first holder, the smallest id.
2. A document is paired with the first holder of every line and run it shares with an earlier document,
   however many have it.  Every block that could be deleted is made of such runs, so each of its lines
   has a partner that holds it within a long enough run.  A document has at most three partners per
   line, and thousands of copies make thousands of pairs with their first member, not millions.
3. A pair is one row with both documents' line hashes and is aligned by patience diff: equal beginnings
   and ends, then lines that are unique on both sides, in their longest common order, then the same
   between them.  Frequent lines take part here.
4. Runs of consecutive aligned lines with ``MIN_WORDS`` words or more are deleted from the later
   document, the others and lines without words stay.  All alignments are judged on the input.

A null text has no lines and stays null; a text that loses all its lines becomes empty; a document
is one row, texts of any length included.  Rows with equal ids don't dedup one another (no id is
earlier), each is judged by its own text; rows without id count as later than all others.  Other
columns pass through; names beginning with two underscores are used inside.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_value, stored
from parlance.llm.textscan import utf8

by_value(__name__)

MIN_WORDS = 10
NO_ID = (1 << 63) - 1


def line_batches(batches):
    """Per document: hashes (16 bytes each), word counts and numbers of its lines with words."""
    for batch in batches:
        hashes, words, numbers = [], [], []
        for text in utf8(batch.column("text")):
            found = [(i, line) for i, line in enumerate(text.split(b"\n")) if line and not line.isspace()]
            hashes.append(b"".join(xxhash.xxh3_128_digest(x) for _, x in found))
            words.append(np.array([len(x.split()) for _, x in found], dtype=np.int32).tobytes())
            numbers.append(np.array([i for i, _ in found], dtype=np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__t"), *(pa.array(x, pa.binary()) for x in (hashes, words, numbers))],
            ["__id", "__t", "hashes", "words", "numbers"],
        )


def cut(data):
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def runs(lines, words, least):
    """Hashes of the shortest runs of two lines or more that begin or end at each line."""
    upto, spans, end, first = np.concatenate([[0], np.cumsum(words)]).tolist(), set(), 0, 0
    for i in range(len(lines)):
        while end < len(lines) and upto[end] - upto[i] < least:
            end += 1
        if upto[end] - upto[i] >= least:
            spans.add((i, end))
        while upto[i + 1] - upto[first + 1] >= least:
            first += 1
        if upto[i + 1] - upto[first] >= least:
            spans.add((first, i + 1))
    return [xxhash.xxh3_128_digest(b"".join(lines[a:b])) for a, b in spans if b - a > 1]


def holder_batches(batches, least):
    """One row for each document and distinct line or run."""
    for batch in batches:
        found = []
        for hashes, words in zip(batch.column("hashes").to_pylist(), batch.column("words").to_pylist()):
            lines = cut(hashes)
            found.append(list(dict.fromkeys(lines + runs(lines, np.frombuffer(words, dtype=np.int32), least))))
        which = np.repeat(np.arange(len(found)), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x for doc in found for x in doc], pa.binary()),
                batch.column("__id").take(pa.array(which)),
                batch.column("__t").take(pa.array(which)),
            ],
            ["line", "__id", "__t"],
        )


def increasing(values):
    """Positions of a longest increasing subsequence."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a, b):
    """Aligned positions (i, j) of two sequences."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one, two = {}, {}
        for seen, side, lo, hi in ((one, a, a0, a1), (two, b, b0, b1)):
            for i in range(lo, hi):
                seen[side[i]] = -1 if side[i] in seen else i
        both = [(i, two[x]) for x, i in one.items() if i >= 0 and two.get(x, -1) >= 0]
        chain = [both[k] for k in increasing([j for _, j in both])]
        if not chain:
            continue
        found.extend(chain)
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m)
    return sorted(found)


def common_blocks(a, b, words, least):
    """(first, end) of the blocks of ``b`` to delete."""
    out, run = [], []
    for pair in [*patience(a, b), None]:
        if run and (pair is None or pair != (run[-1][0] + 1, run[-1][1] + 1)):
            first, end = run[0][1], run[-1][1] + 1
            if sum(words[first:end]) >= least:
                out.append((first, end))
            run = []
        if pair:
            run.append(pair)
    return out


def align_batches(batches, least):
    for batch in batches:
        out = []
        for early, late, words, numbers in zip(
            *(batch.column(c).to_pylist() for c in ("early", "hashes", "words", "numbers"))
        ):
            counts = np.frombuffer(words, dtype=np.int32).tolist()
            lines = np.frombuffer(numbers, dtype=np.int32).tolist()
            blocks = common_blocks(cut(early), cut(late), counts, least)
            out.append([lines[i] for a, b in blocks for i in range(a, b)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__t"), pa.array(out, pa.list_(pa.int32()))], ["__id", "__t", "lines"]
        )


def delete_batches(batches, names):
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("__lines").to_pylist()):
            if gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                text = text if text.encode().split() else ""
            texts.append(text)
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        yield batch.select(names)


def removals(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(__id, __t, __lines): numbers of the lines to delete, for documents that lose some."""
    lines = docs.select("__id", "__t", "text").mapInArrow(
        line_batches, "__id bigint, __t bigint, hashes binary, words binary, numbers binary"
    )
    # equal rows count once
    lines = lines.groupBy("__id", "__t").agg(*(F.first(c).alias(c) for c in ("hashes", "words", "numbers")))
    lines = stored(lines, "lines")
    holders = lines.select("__id", "__t", "hashes", "words").mapInArrow(
        lambda it: holder_batches(it, least), "line binary, __id bigint, __t bigint"
    )
    # stored, so that the join has an exchange on both sides and a line of many documents is split
    counted = stored(
        holders.groupBy("line").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("docs"))
        .where("docs > 1").withColumnRenamed("line", "known"),
        "held",
    )
    shared = holders.join(counted, holders["line"] == counted["known"]).where("first < __id")
    pairs = shared.select("__id", "__t", "first").distinct()
    early = lines.select(F.col("__id").alias("__early"), F.col("hashes").alias("early"))
    aligned = (
        pairs.join(lines, ["__id", "__t"])
        .join(early, F.col("first") == F.col("__early"))
        .select("__id", "__t", "early", "hashes", "words", "numbers")
        .mapInArrow(lambda it: align_batches(it, least), "__id bigint, __t bigint, lines array<int>")
    )
    return (
        aligned.where(F.size("lines") > 0)
        .groupBy(F.col("__id").alias("__i"), F.col("__t").alias("__h"))
        .agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("__lines"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "__t": F.xxhash64("text")}
    )


def dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; text without the repeated blocks."""
    rows = _keyed(docs)
    gone = removals(rows)
    joined = rows.join(gone, (rows["__id"] == gone["__i"]) & (rows["__t"] == gone["__h"]), "left")
    names = docs.columns
    return joined.drop("__id", "__t", "__i", "__h").mapInArrow(lambda it: delete_batches(it, names), docs.schema)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, lines with words before and after, and the text left, per row."""
    worded = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint")
    before = docs.select("doc_id", "text", worded(F.col("text")).alias("n_lines"))
    return dedup(before).select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - worded(F.col("text"))).alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
