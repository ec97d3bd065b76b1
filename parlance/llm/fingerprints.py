"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: a phrase is the shortest piece not seen as a phrase before.  The set
of phrases stands for what a compressor would learn from the text; its ``K`` smallest hashes are the
fingerprint (hex digits, smallest first; empty for texts without phrases).  The likeness of two
fingerprints is the share of the K smallest hashes of their union that both hold, an estimate of the
Jaccard similarity of the phrase sets and exact for texts with fewer than K phrases.

``with_edits`` compares every document with an edited self (its last third replaced by the beginning
of the next document) and with that next document.  The parse of the part that both versions share
is done once.  "Next" needs an order of all documents: ids are cut into runs of 64, texts are
shuffled once by run, and the first document of a run goes as an extra row to the run before it.
Which run that is comes from a range sort of the runs, so no task orders them all, however sparse
the ids are (of sparse ids each makes a run of its own).

Null texts count as empty; two empty texts have likeness 1, an empty and another text 0.  Rows
with equal ids follow one another in the order of their texts; rows without id come last, ordered
by the hash of their text, a run for each hash, equal ones counted before they are shuffled.  A
single row is followed by itself, an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import by_value, numbered, without
from parlance.llm.textscan import BASES, prefix, span_hash

by_value(__name__)

K = 64
RUN_BITS = 6
#: A run: rows without id (0) come after those with one (1) in descending order.
RUN = ["kind", "run"]
#: Equal rows are written out in pieces of this many.
COPIES = 1 << 16
EDITS = (
    "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def parse(text, seen, start, end):
    """Go on parsing text[start:] from position ``end``; returns the ends of the new phrases."""
    ends = []
    add, found = seen.add, ends.append
    for end in range(end + 1, len(text) + 1):
        piece = text[start:end]
        if piece not in seen:
            add(piece)
            found(end)
            start = end
    return ends


def hashes(text, ends, start=0):
    """Hash of the phrases of ``text`` that end at ``ends``, the first beginning at ``start``."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.array(ends, dtype=np.int64)
    return span_hash(prefix(codes, BASES[0]), np.concatenate([[start], ends[:-1]])[: len(ends)], ends, BASES[0])


def smallest(values):
    if len(values) > 4 * K:
        values = np.partition(values, 2 * K)[: 2 * K]  # phrases are distinct, so are their hashes
    return np.unique(values)[:K]


def print_of(text):
    return smallest(hashes(text, parse(text, set(), 0, 0)))


def pair_prints(text, edited, cut):
    """Fingerprints of two texts that agree up to ``cut``."""
    if cut == len(text) and text == edited:
        both = print_of(text)
        return both, both
    seen = set()
    shared = parse(text[:cut], seen, 0, 0)
    start = shared[-1] if shared else 0
    common = hashes(text[:cut], shared)
    out = []
    for version in (text[start:], edited[start:]):
        ends = parse(version, seen, 0, cut - start)
        out.append(smallest(np.concatenate([common, hashes(version, ends)])))
        seen.difference_update(version[a:b] for a, b in zip([0, *ends], ends))
    return out


def likeness_of(a, b):
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:K]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def hexed(values):
    return values.astype(">u8").tobytes().hex()


def print_batches(batches, text, name):
    for batch in batches:
        prints = [hexed(print_of(t or "")) for t in batch.column(text).to_pylist()]
        yield batch.append_column(name, pa.array(prints, pa.string()))


def descending(rows):
    """(doc_id, text, copies) of a run in the order that documents follow one another."""
    docs = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "copies"))), key=lambda r: r[1] or "")
    docs.sort(key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    return docs


def first_of_run(rows):
    head = pa.array([descending(rows)[0][1]], pa.string())
    return pa.table({"kind": rows.column("kind").slice(0, 1), "run": rows.column("run").slice(0, 1), "head": head})


def edit_run(rows, following):
    """One run, descending; ``following`` has the first row of the run after it."""
    docs = descending(rows)
    texts = [t or "" for _, t, _ in docs]
    after = following.column("head").to_pylist()[0] or ""
    out, held = [], None
    for i, (doc, _, copies) in enumerate(docs):
        text = texts[i]
        third = len(text) // 3
        cut = len(text) - third

        def entry(other, near_next, copies):
            edited = text[:cut] + other[:third]
            mine, theirs = pair_prints(text, edited, cut)
            found = [doc, len(text), edited, hexed(mine), hexed(theirs), likeness_of(mine, theirs), near_next, copies]
            return mine, found

        if copies > 1:  # all but the last of equal rows are followed by one of them
            out.append(entry(text, 1.0, copies - 1)[1])
        mine, found = entry(texts[i + 1] if i + 1 < len(texts) else after, None, 1)
        if held is not None:
            held[1][6] = likeness_of(held[0], mine)
        held = mine, found
        out.append(found)
    held[1][6] = likeness_of(held[0], print_of(after))
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of a text column (in place of a column called ``name``)."""
    docs = without(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    return docs.mapInArrow(lambda it: print_batches(it, text, name), schema)


def _runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, copies and the run of each; rows without id count once per text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.lit(1).cast("bigint").alias("copies"), F.lit(1).alias("kind"),
        F.shiftright("doc_id", RUN_BITS).alias("run"),
    )
    nameless = rows.where(F.col("doc_id").isNull()).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return named.unionByName(
        nameless.select(
            F.lit(None).cast("bigint").alias("doc_id"), "text", "copies", F.lit(0).alias("kind"),
            F.xxhash64("text").alias("run"),
        )
    )


def with_edits(docs: DataFrame) -> DataFrame:
    rows = _runs(docs)
    order = numbered(rows.select(*RUN).distinct(), RUN, label="runs")
    # grouped as below, so that Spark reuses the shuffled texts instead of dealing them out again
    firsts = rows.groupBy(*RUN).applyInArrow(first_of_run, "kind int, run bigint, head string")
    follows = firsts.join(order, RUN).select(F.expr("(pos + 1) % count").alias("pos"), "head")
    heads = order.join(follows, "pos").select(*RUN, "head")
    found = rows.groupBy(*RUN).cogroup(heads.groupBy(*RUN)).applyInArrow(edit_run, f"{EDITS}, copies bigint")
    names = [c for c in found.columns if c != "copies"]
    pieces = found.withColumn("_at", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    each = F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - _at))"))
    return pieces.select(*names, each.alias("_copy")).select(*names)


def fingerprints(docs: DataFrame) -> DataFrame:
    return with_edits(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
