"""Links of buckets in batches of any size connect what direct comparison connects."""

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import simhash


def roots(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("size", [1, 2, 7, 50, 10_000])
@pytest.mark.parametrize("asked", [1, 64])
def test_streamed_links(monkeypatch, size, asked):
    monkeypatch.setattr(simhash, "ASKED", asked)
    rng = np.random.default_rng(size)
    rows = []
    for value in range(12):
        base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        n = [1, 2, 3, 40][value % 4]
        for _ in range(n):
            fp = base[rng.integers(3)]
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                fp ^= np.uint64(1) << np.uint64(bit)
            rows.append((value % 2, value, int(fp.view(np.int64)), bool(rng.integers(2))))
    rows.sort(key=lambda r: (r[0], r[1], not r[3]))
    names = ["seg", "value", "fp", "filed"]
    table = pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})
    batches = table.to_batches(max_chunksize=size)
    got = [(a, b) for out in simhash.link_batches(batches, ["seg", "value"]) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    want = []
    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and (x[3] or y[3]) and ((x[2] ^ y[2]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS:
                want.append((x[2], y[2]))
    nodes = {r[2] for r in rows}
    assert roots(nodes, got) == roots(nodes, want)
    assert len(got) <= 4 * len(rows)
