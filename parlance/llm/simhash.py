"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it.  Texts are
linked at ``RADIUS`` = 3 or fewer differing bits; a component is what links reach.

Links are found among distinct fingerprints, so exact copies count once.  A fingerprint has two
segments of 32 bits.  Of three differing bits at most one lies in one of the two, so every
fingerprint is filed under the value of each segment and asks for all values in the ball of radius 1
around its own (33 per segment).  A bucket is what meets at one value; it is kept if it holds a
filed fingerprint and anything else.  Members of a bucket are compared over all 64 bits.

A bucket does not emit its pairs: it emits, for each group its links connect, one row per member
(member, smallest member), found by a breadth-first search over blocks of comparisons.  Buckets of
more than ``CROWD`` members are cut further by the same argument over the other segment's quarters:
filed under both 16-bit values, asked for within radius 1.  In such a cell 48 bits are fixed for what
is filed, so it holds at most 65,536 of them, whatever the corpus; questions are streamed against
them.  Components come from these rows by ``components``.  Nothing is capped.

Null and wordless texts have fingerprint zero and are linked like others.  Rows with equal ids get
rows of their own; null ids don't count as smallest unless a component has nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import aside, by_value, stored, without
from parlance.llm.components import components
from parlance.llm.textscan import utf8

by_value(__name__)

SHINGLE = 3
RADIUS = 3
SEED = 42
CROWD = 4_096
#: Questions that are compared at a time with what is filed.
ASKED = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text, shingle):
    """Hashes of the runs of ``shingle`` lower-cased words; of the whole text if it has no more."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        pieces = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        pieces = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in pieces), dtype="<u8", count=len(pieces))


def fingerprint(text, shingle=SHINGLE):
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def print_batches(batches, text, name):
    for batch in batches:
        prints = [fingerprint(t) for t in utf8(batch.column(text))]
        yield batch.append_column(name, pa.array(prints, pa.int64()))


def connect(filed, asked):
    """(member, smallest member) of the groups that links between ``filed`` and ``asked`` connect.

    ``filed`` are fingerprints, ``asked`` all members (filed ones too), both distinct unsigned.
    """
    left, out = np.ones(len(filed), dtype=bool), []
    open_ = np.ones(len(asked), dtype=bool)
    for start in range(len(filed)):
        if not left[start]:
            continue
        left[start] = False
        front, group = filed[start : start + 1], [filed[start : start + 1]]
        while len(front):
            rest = np.flatnonzero(open_)
            near = np.zeros(len(rest), dtype=bool)
            for one in front:
                near |= np.bitwise_count(asked[rest] ^ one) <= RADIUS
            new = asked[rest[near]]
            open_[rest[near]] = False
            group.append(new)
            rest = np.flatnonzero(left)
            near = np.zeros(len(rest), dtype=bool)
            for one in new:
                if not len(rest):
                    break
                near |= np.bitwise_count(filed[rest] ^ one) <= RADIUS
            front = filed[rest[near]]
            left[rest[near]] = False
            group.append(front)
        members = np.unique(np.concatenate(group))
        if len(members) > 1:
            out.append((members[1:], np.repeat(members[:1], len(members) - 1)))
    return out


class Streamed:
    """A bucket or cell that may go on in the next batch: what is filed is kept, what asks is not."""

    def __init__(self, key):
        self.key, self.filed, self.label = key, np.zeros(0, dtype=np.uint64), None

    def settle(self):
        """The links among what is filed, all of which has come, and the group each belongs to."""
        if self.label is not None:
            return []
        self.label, out = self.filed.copy(), connect(self.filed, self.filed)
        for members, smallest in out:
            self.label[np.searchsorted(self.filed, members)] = smallest[0]
        return out

    def add(self, fp, filed):
        """The links of some more rows; filed ones come before all others."""
        self.filed = np.unique(np.concatenate([self.filed, fp[filed]]))
        asked = np.unique(fp[~filed])
        if not len(asked) or not len(self.filed):
            return []
        out = self.settle()
        for at in range(0, len(asked), ASKED):
            some = asked[at : at + ASKED]
            who, near = np.nonzero(np.bitwise_count(some[:, None] ^ self.filed[None, :]) <= RADIUS)
            pairs = np.unique(np.stack([some[who], self.label[near]], axis=1), axis=0)
            out.append((pairs[:, 0], pairs[:, 1]))
        return out


def link_batches(batches, keys):
    """Links of the buckets in a stream that is sorted by ``keys`` and then has filed rows first (fp, filed
    are the other columns).  A bucket inside a batch is linked at once, the last one of a batch is
    streamed; no more than what is filed in one bucket stays in memory."""
    last = None
    schema = pa.schema({"a": pa.int64(), "b": pa.int64()})

    def rows(found):
        a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    for batch in batches:
        table = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*keys, "fp", "filed")}
        fp, filed = table["fp"].view(np.uint64), table["filed"].astype(bool)
        if not len(fp):
            continue
        change = np.zeros(len(fp), dtype=bool)
        change[0] = True
        for k in keys:
            change[1:] |= table[k][1:] != table[k][:-1]
        first = np.append(np.flatnonzero(change), len(fp))
        found = []
        for a, b in zip(first[:-1], first[1:]):
            key = tuple(table[k][a] for k in keys)
            if last is not None and last.key != key:
                found.extend(last.settle())
                last = None
            if last is None and b < len(fp):
                mine = np.unique(fp[a:b][filed[a:b]])
                if b - a > 1 and len(mine):
                    found.extend(connect(mine, np.unique(fp[a:b])))
                continue
            last = last or Streamed(key)
            found.extend(last.add(fp[a:b], filed[a:b]))
        yield rows(found)
    if last is not None:
        yield rows(last.settle())


def fingerprinted(docs: DataFrame, name: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed 64-bit integer (in place of a column
    of that name)."""
    docs = without(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.mapInArrow(lambda it: print_batches(it, "text", name), schema)


def _ball(value, bits: int):
    """All values within one bit of ``value``, with whether it is the value itself."""
    flips = [F.struct(F.lit(0).cast("bigint").alias("flip"), F.lit(True).alias("filed"))]
    flips += [F.struct(F.lit(1 << i).cast("bigint").alias("flip"), F.lit(False).alias("filed")) for i in range(bits)]
    return F.transform(
        F.array(*flips), lambda x: F.struct(value.bitwiseXOR(x["flip"]).alias("value"), x["filed"].alias("filed"))
    )


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within RADIUS."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    members = (
        fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg"))
        .select("seg", "fp", F.explode(_ball(F.when(F.col("seg") == 0, low).otherwise(high), 32)).alias("m"))
        .select("seg", F.col("m.value").alias("value"), "fp", F.col("m.filed").alias("filed"))
    )
    bucket = Window.partitionBy("seg", "value")
    buckets = (
        members.withColumns({"_n": F.count(F.lit(1)).over(bucket), "_f": F.max("filed").over(bucket)})
        .where("_n > 1 AND _f")
        .drop("_f")
    )
    buckets = stored(buckets, "buckets")
    keys = ["seg", "value"]
    small = (
        buckets.where(F.col("_n") <= CROWD).repartition(*keys).sortWithinPartitions(*keys, F.desc("filed"))
        .mapInArrow(lambda it: link_batches(it, ["seg", "value"]), "a bigint, b bigint")
    )
    other = F.when(F.col("seg") == 0, high).otherwise(low)
    quarter = F.when(F.col("quarter") == 0, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16))
    cells = (
        buckets.where(F.col("_n") > CROWD)
        .withColumn("quarter", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("m", F.explode(_ball(quarter, 16)))
        .select("seg", "value", "quarter", F.col("m.value").alias("cell"), "fp", (F.col("filed") & F.col("m.filed")).alias("filed"))
    )
    keys = ["seg", "value", "quarter", "cell"]
    crowded = (
        cells.repartition(*keys).sortWithinPartitions(*keys, F.desc("filed"))
        .mapInArrow(lambda it: link_batches(it, ["seg", "value", "quarter", "cell"]), "a bigint, b bigint")
    )
    return small.unionByName(crowded)


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of rows (doc_id, fp): component_id is the smallest id of the group."""
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps.select("fp")), "simhash")
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root and component_id of every row."""
    prints = stored(fingerprinted(docs.select("doc_id", "text")).select("doc_id", "fp"), "prints")
    return prints.join(groups(prints), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the first row with the smallest id.

    Columns of ``docs`` may have any names; an empty table gives an empty one.
    """
    docs, columns = aside(docs, ("__fp", "__id", "__f", "__root", "__n"))
    marked = fingerprinted(docs, "__fp")
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__f"), F.col("root").alias("__root")).distinct()
    rows = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__f")))
    first = Window.partitionBy("__root").orderBy("__fp", F.xxhash64("text"))
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*columns)


def simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
