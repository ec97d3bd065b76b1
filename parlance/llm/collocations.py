"""Phrase collocations by Toivonen's sampling.

Phrases are runs of 2 to ``LONGEST`` words inside a piece of text (no punctuation or line break in
between), counted per language.  Only phrases that occur ``LEAST`` times or more matter, and every part
of such a phrase occurs as often, so:

1. Documents become blocks of numbered words; each block counts its own words, and the sums name the
   frequent words exactly.  A word's id is the place of its hash among those of all frequent words;
   beyond ``KNOWN`` of them, ids are the hashes, as many bits as tell the words apart.  Either is checked
   to be the word's own.  Blocks are then stored with frequent words only.
2. Every pair of frequent words is counted exactly: the pairs are the negative border of the words.
3. A sample of the documents (one of ``SHARE``, by a hash of id and text) proposes longer phrases, length
   by length: those whose parts, the phrase without its last word and the phrase without its first, are
   frequent pairs or proposed and that occur ``PROPOSE`` times in it.  That is less than the share of
   ``LEAST``, so few are missed.
4. A full pass counts exactly every longer phrase that occurs and whose two parts are frequent pairs or
   proposed: the proposals and their negative border.
5. A border phrase that proves frequent is a failure of the sample: phrases that it is a part of may be
   frequent too.  Such failures trigger a pass that counts the phrases they extend to, and so on until a
   pass finds none.  Then every frequent phrase has been counted over all documents, whatever the
   sample missed.

Pairs of words are by far the most, and nearly all of them are rare.  A block sends them as stripes: one
row per bucket of first words, which holds the words, sorted, and the sorted second words of each as
small differences.  There are at least ``BUCKETS`` buckets and one for every ``STRIPE`` words of the corpus;
stripes of words that occur ``STRIPE`` times or more are cut into parts by second word.  So no group of
stripes grows with the corpus, however frequent a word.  Longer phrases travel packed too, one row per
bucket of their hashes.

What was proposed or found travels to the tasks as a Bloom filter of at most ``FILTER_BITS`` (16 MB,
however large the corpus).  A filter has no false negatives, so that a full filter only means that more
phrases are counted than needed.  Blocks add up equal phrases before anything is shuffled; phrases are
keys of word numbers, told apart exactly and never by a hash.

A frequent phrase is a candidate.  Each of its cuts gives a score, the lowest counts; candidates that a
longer one of the same count contains are dropped (one word longer suffices, as counts only fall with
length); the first rows of each language are returned.  Products are decimals of 38 digits.

Null texts are empty, a null language is ``und``.  Repeated rows count each time; texts of any length
are cut at pieces, which no phrase crosses.  An empty table gives an empty result.  Columns other than
doc_id, text and lang are not looked at; null and repeated ids are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_value, stored
from parlance.llm.textscan import mix, slices, utf8
from parlance.plans.topk import top_n

by_value(__name__)

LONGEST = 5
LEAST = 100
TOP = 2_000
SHARE = 8
PROPOSE = 5
FILTER_BITS = 1 << 27
#: Bytes of text in a block; pairs in a group of stripes, and the least number of groups.
BLOCK = 8 << 20
STRIPE = 1 << 20
BUCKETS = 1 << 12
#: Frequent words whose sorted hashes travel as they are (16 MB); beyond it a filter does.
KNOWN = 1 << 21
#: Bytes of stripes that are added up at a time.
PORTION = 2 << 20

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: No byte of UTF-8: stands for a break between pieces.
BREAK = b"\xff"
TABLE = bytes(0xFF if i in SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))


def rows_of(batch, *names):
    """The values of some columns row by row, so that one row's texts are in Python at a time."""
    columns = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def parts(text, most):
    """A translated text in parts of about ``most`` bytes, cut at breaks."""
    at = 0
    while len(text) - at > most:
        end = text.find(BREAK, at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def pack(tokens):
    return zstandard.compress(np.ascontiguousarray(tokens, dtype=np.int32).tobytes(), 1)


def unpack(data):
    return np.frombuffer(zstandard.decompress(data), dtype=np.int32)


def block_batches(batches, share, most):
    """Per block of texts of a language: word numbers (-1 at a break), how many of them are of sampled
    documents (they come first), the words and their counts."""
    names = ["lang", "tokens", "sampled", "words", "counts"]
    kinds = [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.binary()]
    cut = lambda texts: BREAK.join(texts).replace(BREAK, b" " + BREAK + b" ").split()
    for batch in slices(batches, "text", most):
        held = {}
        ids = batch.column("doc_id").to_pylist()
        for i, lang, text in zip(ids, batch.column("lang").to_pylist(), utf8(batch.column("text"))):
            chosen = xxhash.xxh64_intdigest(text, (i or 0) & 0xFFFFFFFF) % share == 0
            held.setdefault(lang, []).extend((not chosen, part) for part in parts(text.translate(TABLE), most))
        for lang, texts in held.items():
            texts.sort(key=lambda x: x[0])
            while texts:
                n, size = 0, 0
                while n < len(texts) and (not n or size + len(texts[n][1]) <= most):
                    size += len(texts[n][1])
                    n += 1
                first = [*cut([x for late, x in texts[:n] if not late]), BREAK]
                found = first + cut([x for late, x in texts[:n] if late])
                texts = texts[n:]
                coded = pa.array(found, pa.binary()).dictionary_encode()
                del found
                tokens, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                counts = np.bincount(tokens, minlength=len(words)).astype(np.int64)
                at = words.index(BREAK)
                tokens = np.where(tokens == at, -1, tokens - (tokens > at))
                words.pop(at)
                counts = np.delete(counts, at)
                if words:
                    row = [lang, pack(tokens), len(first), words, counts.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)


def word_hash(lang, words):
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def shortened(h, bits):
    """Ids of ``bits`` (63 at most) from hashes."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def keys_of(ids, width):
    """An Arrow column of phrases from a matrix of word ids, the words' bytes in order."""
    n, k = ids.shape
    data = np.ascontiguousarray(ids.astype(">i8").view(np.uint8).reshape(n, k, 8)[:, :, 8 - width :])
    return cut_at(data, np.arange(n + 1) * (k * width))


def ids_of(data, k, width):
    """The matrix of word ids of phrases of ``k`` words."""
    held = np.frombuffer(data, dtype=np.uint8).reshape(-1, k, width)
    whole = np.zeros((len(held), k, 8), dtype=np.uint8)
    whole[:, :, 8 - width :] = held
    return whole.reshape(len(held), k * 8).view(">i8").astype(np.int64)


def count_batches(batches):
    """(lang, word, n) of the words of a block."""
    for batch in batches:
        for lang, words, counts in rows_of(batch, "lang", "words", "counts"):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(np.frombuffer(counts, dtype=np.int64))],
                ["lang", "word", "n"],
            )


def hash_batches(batches):
    """(h, lang, word, n) of rows (lang, word, n)."""
    for batch in batches:
        langs, words = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
        h = np.zeros(len(words), dtype=np.uint64)
        for lang in set(langs):
            at = np.array([i for i, x in enumerate(langs) if x == lang])
            h[at] = word_hash(lang, [words[i] for i in at.tolist()])
        columns = [pa.array(h.view(np.int64)), *(batch.column(c) for c in ("lang", "word", "n"))]
        yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "word", "n"])


def numbers(h, known, bits):
    """Which words are frequent, and their ids: places in the sorted hashes of all frequent words, or with
    ``bits`` the hashes themselves, shortened, of what a filter lets pass."""
    if bits:
        at = np.flatnonzero(inside(known, h))
        return at, shortened(h[at], bits)
    place = np.searchsorted(known, h)
    at = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
    return at, place[at]


def id_batches(batches, known, bits):
    """(id, lang, word, n) of the words that have one."""
    for batch in batches:
        at, ids = numbers(batch.column("h").to_numpy().view(np.uint64), known, bits)
        columns = [pa.array(ids), *(batch.column(c).take(pa.array(at)) for c in ("lang", "word", "n"))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "n"])


def frequent_batches(batches, known, hot, bits):
    """Blocks with frequent words only: numbers into ``ids``, -1 for anything else; which of them are hot."""
    for batch in batches:
        for lang, sampled, tokens, words in rows_of(batch, "lang", "sampled", "tokens", "words"):
            codes, h = unpack(tokens), word_hash(lang, words)
            at, numbered = numbers(h, known, bits)
            to = np.full(len(words) + 1, -1, dtype=np.int32)
            to[at] = np.arange(len(at))
            codes = to[codes]  # a break, -1, meets the last place
            whole = [numbered.astype(np.int64).tobytes(), inside(hot, h[at]).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sampled], pa.int32()), pa.array([pack(codes)], pa.binary()), *(pa.array([x], pa.binary()) for x in whole)],
                ["sampled", "tokens", "ids", "hot"],
            )


def small(values):
    """Unsigned integers with seven bits a byte, the last byte of each below 128, and where each ends."""
    n = np.ones(len(values), dtype=np.int64)
    for shift in range(7, 63, 7):
        n += values >= (1 << shift)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for j in range(int(n.max(initial=0))):
        some = n > j
        out[(ends - n)[some] + j] = (values[some] >> (7 * j)) & 127 | np.where(n[some] > j + 1, 128, 0)
    return out, ends


def large(data):
    """The integers of ``small``."""
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, last + 1 - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def cut_at(data, ends):
    """A binary column of runs of bytes."""
    ends = np.ascontiguousarray(ends, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def differences(values, new):
    """Steps from one value to the next; a value where a run begins stays."""
    step = values.copy()
    step[1:] -= np.where(new[1:], 0, values[:-1])
    return step


def running(step, counts):
    """The values of ``differences``, in runs of ``counts``."""
    upto = np.concatenate([[0], np.cumsum(step)])
    return upto[1:] - np.repeat(upto[np.cumsum(counts) - counts], counts)


def integers(column):
    """All integers of a binary column of ``small``, and how many each row has."""
    rows = column.to_pylist()
    data = np.frombuffer(b"".join(rows), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
    upto = np.concatenate([[0], np.cumsum(data < 128)])
    return large(data), np.diff(upto[np.concatenate([[0], ends])])


def pair_batches(batches, buckets, parts):
    """Stripes of the pairs of frequent words: bucket and part, the first words, the number of second words
    of each, and the second words; words sorted and as differences."""
    for batch in batches:
        for tokens, ids, hot in rows_of(batch, "tokens", "ids", "hot"):
            c, ids = unpack(tokens).astype(np.int64), np.frombuffer(ids, dtype=np.int64)
            at = np.flatnonzero((c[:-1] >= 0) & (c[1:] >= 0))
            if not len(at):
                continue
            one, two = ids[c[at]], ids[c[at + 1]]
            part = np.where(np.frombuffer(hot, dtype=bool)[c[at]], two % parts, 0)
            bucket = one % buckets
            order = np.lexsort((two, one, part, bucket))
            one, two, part, bucket = one[order], two[order], part[order], bucket[order]
            row = np.ones(len(one), dtype=bool)
            row[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
            word = row.copy()
            word[1:] |= one[1:] != one[:-1]
            first, begin = np.flatnonzero(word), np.flatnonzero(row)
            words_upto = np.append(np.cumsum(word)[begin] - 1, len(first))
            columns = [pa.array(bucket[begin]), pa.array(part[begin])]
            for values, upto in (
                (differences(one[first], row[first]), words_upto),
                (np.diff(np.append(first, len(one))), words_upto),
                (differences(two, word), np.append(begin, len(one))),
            ):
                data, ends = small(values)
                columns.append(cut_at(data, np.concatenate([[0], ends])[upto]))
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "part", "firsts", "counts", "seconds"])


def stripe_batches(batches, least, width):
    """(phrase, n) of the pairs that occur ``least`` times, from stripes sorted by bucket and part."""
    held = None

    def added(bucket, part, first, second, n):
        """Equal pairs as one, sorted."""
        order = np.lexsort((second, first, part, bucket))
        bucket, part, first, second, n = (x[order] for x in (bucket, part, first, second, n))
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        return bucket[at], part[at], first[at], second[at], np.add.reduceat(n, at)

    def rows(first, second, n):
        keep = n >= least
        keys = keys_of(np.stack([first[keep], second[keep]], axis=1), width)
        return pa.RecordBatch.from_arrays([keys, pa.array(n[keep])], ["phrase", "n"])

    for batch in slices(batches, "seconds", PORTION):
        firsts, words = integers(batch.column("firsts"))
        counts, _ = integers(batch.column("counts"))
        steps, pairs = integers(batch.column("seconds"))
        both = [np.repeat(batch.column(x).to_numpy(zero_copy_only=False), pairs) for x in ("bucket", "part")]
        table = [*both, np.repeat(running(firsts, words), counts), running(steps, counts), np.ones(len(steps), dtype=np.int64)]
        if held is not None:
            table = [np.concatenate(x) for x in zip(held, table)]
        table = added(*table)
        # the last bucket and part may go on in the next batch
        last = (table[0] == table[0][-1]) & (table[1] == table[1][-1])
        held = [x[last] for x in table]
        yield rows(*(x[~last] for x in table[2:]))
    if held is not None:
        yield rows(*held[2:])


def phrase_hash(ids):
    """Hashes of phrases, one per row of a matrix of word ids."""
    h = np.full(len(ids), ids.shape[1], dtype=np.uint64)
    for column in ids.T:
        h = mix((h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def places(h, bits):
    """The two bits of a hash in a filter."""
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def inside(table, h):
    one, two = places(h, len(table) * 64)
    test = lambda at: (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return test(one) & test(two)


def packed(words, n, width, buckets):
    """Rows (size, bucket, phrases, counts) of phrases of one length."""
    size = words.shape[1]
    bucket = (phrase_hash(words) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys_of(words[order], width).buffers()[2]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    upto = np.append(begin, len(bucket))
    data, ends = small(n[order].astype(np.int64))
    phrases = cut_at(np.frombuffer(keys, dtype=np.uint8)[: len(bucket) * size * width], upto * (size * width))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(begin), size, np.int32)), pa.array(bucket[begin]), phrases, cut_at(data, np.concatenate([[0], ends])[upto])],
        ["size", "bucket", "phrases", "counts"],
    )


def added_batches(batches, least, width):
    """(phrase, n) of the phrases that occur ``least`` times, from packed rows sorted by size and bucket."""
    held = None

    def rows(words, n):
        return pa.RecordBatch.from_arrays([keys_of(words[n >= least], width), pa.array(n[n >= least])], ["phrase", "n"])

    for batch in slices(batches, "phrases", PORTION):
        sizes = batch.column("size").to_numpy()
        cuts = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
            some, size = batch.slice(a, b - a), int(sizes[a])
            phrases = some.column("phrases").to_pylist()
            words = ids_of(b"".join(phrases), size, width)
            n, _ = integers(some.column("counts"))
            bucket = np.repeat(some.column("bucket").to_numpy(), [len(x) // (size * width) for x in phrases])
            if held is not None and held[0].shape[1] != size:
                yield rows(*held[:2])
                held = None
            if held is not None:
                words, n, bucket = (np.concatenate(x) for x in zip(held, (words, n, bucket)))
            order = np.lexsort((*words.T[::-1], bucket))
            words, n, bucket = words[order], n[order], bucket[order]
            at = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
            words, n, bucket = words[at], np.add.reduceat(n, at), bucket[at]
            last = bucket == bucket[-1]  # may go on in the next batch
            held = words[last], n[last], bucket[last]
            yield rows(words[~last], n[~last])
    if held is not None:
        yield rows(*held[:2])


def phrase_batches(batches, sample, known, new, longest, width, buckets):
    """Per block and bucket the phrases, with their counts, of three words or more whose parts are both
    known, and with ``new`` only those of them that have a new part."""
    for batch in batches:
        for sampled, tokens, ids in rows_of(batch, "sampled", "tokens", "ids"):
            c, ids = unpack(tokens).astype(np.int64), np.frombuffer(ids, dtype=np.int64)
            c = c[:sampled] if sample else c
            number = c  # of the phrase that starts at a place
            good = c >= 0  # the phrase of one word less is known
            fresh = np.zeros(len(c), dtype=bool)  # and new
            for k in range(2, longest + 1):
                both = good[: len(good) - 1] & good[1:]
                at = np.flatnonzero(both)
                if not len(at):
                    break
                # a phrase is its first part's number and its last word
                code = number[at] * max(len(ids), 1) + c[at + k - 1]
                _, first, back, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
                words = ids[c[at[first][:, None] + np.arange(k)]]
                if k > 2:
                    send = slice(None) if new is None else np.flatnonzero((fresh[at] | fresh[at + 1])[first])
                    yield packed(words[send], n[send], width, buckets)
                h = phrase_hash(words)
                number = np.zeros(len(both), dtype=np.int64)
                number[at] = back
                good = np.zeros(len(both), dtype=bool)
                good[at] = inside(known, h)[back]
                fresh = np.zeros(len(both), dtype=bool)
                if new is not None:
                    fresh[at] = inside(new, h)[back] & good[at]


def bits_of(h, bits):
    """The 64-bit slots of a filter that hashes set, with their bits."""
    at = np.concatenate(places(h, bits))
    set_to = np.uint64(1) << (at & np.uint64(63))
    return pa.RecordBatch.from_arrays(
        [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(set_to.view(np.int64))], ["slot", "bits"]
    )


def bit_batches(batches, bits, width):
    for batch in batches:
        found = {}
        for phrase in batch.column("phrase").to_pylist():
            found.setdefault(len(phrase) // width, []).append(phrase)
        for k, phrases in found.items():
            yield bits_of(phrase_hash(ids_of(b"".join(phrases), k, width)), bits)


def word_bit_batches(batches, bits):
    for batch in batches:
        yield bits_of(batch.column("h").to_numpy().view(np.uint64), bits)


def bloom(rows: DataFrame, bits: int, set_bits) -> np.ndarray:
    """A Bloom filter of ``bits``: Spark combines the bits, one slot of 64 a row reaches the driver."""
    found = rows.mapInArrow(set_bits, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def phrase_filter(phrases: DataFrame, bits: int, width: int) -> np.ndarray:
    return bloom(phrases.select("phrase"), bits, lambda it: bit_batches(it, bits, width))


def word_filter(words: DataFrame) -> np.ndarray:
    bits = filter_size(words.count(), FILTER_BITS)
    return bloom(words.select("h"), bits, lambda it: word_bit_batches(it, bits))


def filter_size(n: int, most: int) -> int:
    bits = 1 << 10
    while bits < 16 * n and bits < most:
        bits *= 2
    return bits


def blocks_of(docs: DataFrame, share: int) -> DataFrame:
    """The corpus as blocks of numbered words, stored."""
    most = BLOCK
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("string"))
    cut = rows.mapInArrow(
        lambda it: block_batches(it, share, most),
        "lang string, tokens binary, sampled int, words array<binary>, counts binary",
    )
    return stored(cut, "blocks")


def frequent_words(blocks: DataFrame, least: int):
    """Frequent words (id, lang, word, n), the words of each language (lang, total), the blocks of frequent
    words, the bytes of an id, the buckets of first words and the parts of a hot word's stripes."""
    send = blocks.sparkSession.sparkContext.broadcast
    counted = blocks.select("lang", "words", "counts").mapInArrow(count_batches, "lang string, word binary, n bigint")
    sums = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = stored(sums.mapInArrow(hash_batches, "h bigint, lang string, word binary, n bigint"), "words")
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    often = sums.where(F.col("n") >= least)
    many = often.count()
    few = many <= KNOWN
    known = send(np.sort(often.select("h").toArrow().column("h").to_numpy().view(np.uint64)) if few else word_filter(often))
    hot = send(word_filter(often.where(F.col("n") >= STRIPE)))
    longest = 0 if few else 63
    named = sums.mapInArrow(lambda it: id_batches(it, known.value, longest), "id bigint, lang string, word binary, n bigint")
    named = stored(named, "named")  # a filter lets some rare words pass too
    clash = lambda id: not named.groupBy(id).count().where("count > 1").isEmpty()
    if clash(F.col("id")):
        raise ValueError("two words share a hash")
    bits = 0 if few else next(n for n in range(min(63, many.bit_length()), 64) if not clash(F.shiftright("id", 63 - n)))
    if bits:
        named = named.withColumn("id", F.shiftright("id", 63 - bits))
    width = max(1, -(-(bits or many.bit_length()) // 8))
    most, total = often.agg(F.max("n"), F.sum("n")).first()
    split = ((total or 0) // STRIPE + BUCKETS, (most or 0) // STRIPE + 1)
    coded = blocks.select("lang", "sampled", "tokens", "words").mapInArrow(
        lambda it: frequent_batches(it, known.value, hot.value, bits), "sampled int, tokens binary, ids binary, hot binary"
    )
    return named.where(F.col("n") >= least), totals, stored(coded, "coded"), width, split


def pair_counts(coded: DataFrame, least: int, width: int, split: tuple[int, int]) -> DataFrame:
    """(phrase, n) of the pairs of frequent words that occur ``least`` times."""
    stripes = coded.select("tokens", "ids", "hot").mapInArrow(
        lambda it: pair_batches(it, *split), "bucket bigint, part bigint, firsts binary, counts binary, seconds binary"
    )
    return (
        stripes.repartition("bucket", "part")
        .sortWithinPartitions("bucket", "part")
        .mapInArrow(lambda it: stripe_batches(it, least, width), "phrase binary, n bigint")
    )


def longer_counts(coded: DataFrame, sample: bool, known, new, least: int, longest: int, width: int, buckets: int) -> DataFrame:
    """Exact counts, from ``least`` up, of the longer phrases that a pass looks at."""
    spark = coded.sparkSession
    known, new = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(new)
    return (
        coded.select("sampled", "tokens", "ids")
        .mapInArrow(
            lambda it: phrase_batches(it, sample, known.value, new.value, longest, width, buckets),
            "size int, bucket bigint, phrases binary, counts binary",
        )
        .repartition("size", "bucket")
        .sortWithinPartitions("size", "bucket")
        .mapInArrow(lambda it: added_batches(it, least, width), "phrase binary, n bigint")
    )


def proposals(coded: DataFrame, pairs: DataFrame, propose: int, longest: int, width: int, buckets: int) -> DataFrame:
    """The pairs and longer phrases with ``propose`` occurrences in the sample, length by length."""
    seen = last = pairs.select("phrase")
    for k in range(3, longest + 1):
        bits = filter_size(seen.count(), FILTER_BITS)
        filters = phrase_filter(seen, bits, width), phrase_filter(last, bits, width)
        last = stored(longer_counts(coded, True, *filters, propose, k, width, buckets).select("phrase"), "proposed")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


def frequent_phrases(coded: DataFrame, least: int, propose: int, longest: int, width: int, split: tuple[int, int]) -> tuple[DataFrame, int]:
    """(phrase, n) of all phrases of two words or more that occur ``least`` times, and the number of full
    passes over longer phrases."""
    found = stored(pair_counts(coded, least, width, split), "pairs")
    seen = proposals(coded, found, propose, longest, width, split[0])
    bits = filter_size(seen.count(), FILTER_BITS)
    known, new, passes = phrase_filter(seen, bits, width), None, 0
    while True:
        counted = stored(longer_counts(coded, False, known, new, least, longest, width, split[0]), "counted")
        passes += 1
        found = found.unionByName(counted)
        failed = stored(
            counted.where(F.octet_length("phrase") < longest * width).select("phrase").join(seen, "phrase", "left_anti"),
            "failed",
        )
        if failed.isEmpty():
            # a phrase that two passes counted has the same number twice
            return found.groupBy("phrase").agg(F.max("n").alias("n")), passes
        new = phrase_filter(failed, bits, width)
        known = known | new
        seen = seen.unionByName(failed)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, propose: int = PROPOSE, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    words, totals, coded, width, split = frequent_words(blocks_of(docs, share), least)
    phrases = stored(frequent_phrases(coded, least, propose, longest, width, split)[0], "phrases")
    word_key = F.expr(f"substring(unhex(lpad(hex(id), 16, '0')), {9 - width}, {width})")
    counts = phrases.select("phrase", "n").unionByName(words.select(word_key.alias("phrase"), "n"))
    size = f"(octet_length(phrase) div {width})"
    # of the same count as a phrase one word longer that has it as a part
    held = (
        phrases.where(F.expr(f"{size} > 2"))
        .select(
            F.explode(F.array(F.expr(f"substring(phrase, 1, octet_length(phrase) - {width})"), F.expr(f"substring(phrase, {width + 1})"))).alias("_part"),
            F.col("n").alias("_n"),
        )
        .groupBy("_part")
        .agg(F.max("_n").alias("_n"))
    )
    alone = stored(
        phrases.join(held, (F.col("phrase") == F.col("_part")) & (F.col("n") <= F.col("_n")), "left_anti"), "alone"
    )
    cuts = alone.select(
        "phrase", F.col("n").alias("a"), F.explode(F.expr(f"sequence(1, cast({size} AS int) - 1)")).alias("k")
    ).withColumns({"_left": F.expr(f"substring(phrase, 1, k * {width})"), "_right": F.expr(f"substring(phrase, k * {width} + 1)")})
    side = lambda key, n: counts.select(F.col("phrase").alias(f"_{n}"), F.col("n").alias(n))
    cuts = cuts.join(side("_left", "l"), F.col("_left") == F.col("_l")).join(side("_right", "r"), F.col("_right") == F.col("_r"))
    spelled = (
        alone.select("phrase", F.explode(F.expr(f"transform(sequence(0, cast({size} AS int) - 1), i -> struct(i AS i, substring(phrase, i * {width} + 1, {width}) AS key))")).alias("x"))
        .join(words.select(word_key.alias("_key"), "lang", F.col("word").cast("string").alias("word")), F.col("x.key") == F.col("_key"))
        .groupBy("phrase")
        .agg(
            F.min("lang").alias("lang"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x.i", "word"))), lambda w: w["word"]), " ").alias("text"),
        )
        .join(totals.withColumnRenamed("total", "total_words"), "lang")
    )
    wide = lambda c: f"cast({c} AS decimal(19, 0))"
    score = F.expr(f"(1000 * ({wide('a')} * {wide('total_words')})) div ({wide('l')} * {wide('r')})")
    scored = (
        cuts.join(spelled, "phrase")
        .withColumn("score", score)
        .groupBy("phrase", "lang", "text", "a", F.col("total_words").alias("n"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # parts of a language first, so that its last ranking sees a fixed number of rows at most
    some = top_n(scored.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(16))), top, ["lang", "_part"], order)
    best = top_n(some.drop("rank", "_part"), top, ["lang"], order)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame) -> DataFrame:
    return mine(docs)


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
freq AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
held AS (
  SELECT DISTINCT f.lang, f.phrase
  FROM freq f JOIN (
    SELECT lang, array_to_string(w[1:k - 1], ' ') AS part, a FROM freq WHERE k > 2
    UNION ALL SELECT lang, array_to_string(w[2:k], ' '), a FROM freq WHERE k > 2) longer
  ON longer.lang = f.lang AND longer.part = f.phrase AND 100 * longer.a >= 100 * f.a),
cuts AS (
  SELECT f.lang, f.phrase, f.a, c.j, l.a AS l, r.a AS r, t.n,
         ((1000::HUGEINT * f.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM freq f JOIN (SELECT unnest(range(1, {LONGEST})) AS j) c ON c.j < f.k
  JOIN freq l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1:c.j], ' ')
  JOIN freq r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[c.j + 1:f.k], ' ')
  JOIN totals t ON t.lang = f.lang
  WHERE f.k > 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = f.lang AND h.phrase = f.phrase)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {TOP}"""
