"""SentencePiece encoding and decoding with a table of distinct chunks.

The library turns spaces into a marker (U+2581) and puts one in front.  No piece of the vocabulary
has a marker after another character (``pieces_stay_inside`` checks that), so no merge crosses from
a character to a following marker, and a text falls into chunks, a run of markers and what follows
up to the next marker, that are segmented independently.

Every task keeps a table of the distinct chunks it has met.  A slice of texts becomes sequences of
chunk numbers; the chunks that are new are segmented, each once, in one call; then the ids of each
document are taken from the table by position, with begin and end ids, and decoded by the library.
The table is started again when it holds ``TABLE`` chunks, which bounds its memory for any input.

The table is one per task and not one for the corpus: a corpus-wide table needs every block's
distinct chunks and their ids to travel (see the README for what that cost), and segmenting a chunk
again in another task is cheaper than fetching its ids.  So nothing is shuffled, a lost task is
simply run again, and a frequent chunk or a hot source makes no task larger than another.

Null texts count as empty: begin and end id only.  Rows with equal doc_id stay rows of their own;
white space other than U+0020 is an ordinary character here; texts of any length are processed whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_value
from parlance.llm.textscan import slices

by_value(__name__)

#: Bytes of text in a slice.
PORTION = 1 << 20
#: Distinct chunks a task remembers.
TABLE = 200_000
MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def load(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def pieces_stay_inside(model):
    sp = load(model)
    inside = not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size()))
    return inside and sp.piece_to_id(MARK) != sp.unk_id()


class ChunkTable:
    """Distinct chunks, numbered, with their ids laid end to end."""

    def __init__(self, sp):
        self.sp = sp
        self.start()

    def start(self):
        self.number, self.firsts, self.ids = {}, np.zeros(1, np.int64), np.zeros(0, np.uint32)
        # one marker at the end of a text is the only chunk without a character after its first marker
        self.add([" ", MARK], [[self.sp.piece_to_id(MARK)]] * 2)

    def add(self, chunks, ids):
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))
        ends = self.firsts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.firsts = np.concatenate([self.firsts, ends])
        self.ids = np.concatenate([self.ids, *(np.array(x, dtype=np.uint32) for x in ids)])

    def learn(self, chunks):
        if len(self.number) > TABLE:
            self.start()
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if new:  # the library puts the first marker in front itself
            self.add(new, self.sp.encode([c[1:] for c in new], num_threads=1))

    def take(self, chunks):
        number = self.number
        at = np.fromiter((number[c] for c in chunks), np.int64, len(chunks))
        count = self.firsts[at + 1] - self.firsts[at]
        shift = self.firsts[at] - (np.cumsum(count) - count)
        found = self.ids[np.repeat(shift, count) + np.arange(int(count.sum()))]
        return np.concatenate([[self.sp.bos_id()], found, [self.sp.eos_id()]]).astype("<u4")


def encode_batches(batches, model):
    sp = load(model)
    table = ChunkTable(sp)
    for batch in slices(batches, "text", PORTION):
        found = [CHUNK.findall(" " + t) if t else [] for t in batch.column("text").to_pylist()]
        table.learn([c for chunks in found for c in chunks])
        ids = [table.take(chunks) for chunks in found]
        decoded = [sp.decode(x.tolist()) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array(decoded, pa.string()),
            ],
            ["doc_id", "ids", "decoded"],
        )


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every row."""
    if not pieces_stay_inside(model):
        raise ValueError("this vocabulary has pieces that cross chunks")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: encode_batches(it, model), "doc_id bigint, ids binary, decoded string")


def sentencepieces(docs: DataFrame, model: str) -> DataFrame:
    return encode(docs, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
