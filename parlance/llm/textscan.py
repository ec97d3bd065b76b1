"""Words of many texts at once, as numpy arrays (task code)."""

from __future__ import annotations

import numpy as np

from parlance.llm.common import by_value

by_value(__name__)

#: Odd multipliers of the two polynomial hashes and a mixing constant (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xFF51AFD7ED558CCD


def space_table():
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def powers(base, n):
    """base**i for i < n, modulo 2**64."""
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def prefix(codes, base):
    """Running polynomial sums of an integer array; see span_hash."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(base, len(codes))[: len(codes)], out=sums[1:])
    return sums


def mix(h):
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def span_hash(sums, starts, ends, base):
    """Hash of codes[start:end] for many spans, the same wherever the span lies."""
    down = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def scan(texts):
    """(bytes, word starts, word ends, text number of each word) of a list of byte strings."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = space_table()[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    return buffer, starts, ends, np.searchsorted(firsts, starts, side="right") - 1


def portions(sizes, most):
    """Consecutive (from, to) ranges whose sizes add up to about ``most``."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes)


def utf8(column):
    """An Arrow string column as a list of bytes; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, column, most):
    """The rows of record batches in slices of about ``most`` bytes of a text column."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
        for a, b in portions(sizes, most):
            yield batch.slice(a, b - a)
