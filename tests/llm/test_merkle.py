"""The Merkle manifest against plain loops."""

import collections
import hashlib
import zlib

import pytest

from parlance.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, pos int, block int, root string, steps int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    """All levels over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels, i):
    """(siblings on the left, on the right) of node i at each level."""
    out = []
    for level in levels[:-1]:
        beside = [level[i ^ 1]] if i ^ 1 < len(level) else []
        out.append((beside if i & 1 else [], [] if i & 1 else beside))
        i >>= 1
    return out


def expected(rows):
    leaf = lambda d, t, lang, s, n: digest(*map(field, (d, s, lang, n, t)))
    groups = collections.defaultdict(list)
    for d, t, lang, s, n, *_ in rows:
        groups[lang].append((d, leaf(d, t, lang, s, n), (d, t, lang, s, n)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: up([h for _, h, _ in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for g in order}
    top = up([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (d, h, row) in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
            steps = path(trees[g], i) + path(top, k)
            seen = h
            if d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and row[4] is not None:
                seen = leaf(*row[:4], row[4] + 1)
            fold = seen
            for left, right in steps:
                fold = digest(*left, fold, *right)
            proof = digest(*[x for step in steps for side in step for x in side])
            out.append((d, h, trees[g][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return out


def same(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    found = [tuple(r[n] for n in names) for r in merkle.merkle(df).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected(rows)))


def make(n, langs, **own):
    extra = ("h", 1, 2, "r", 3)
    return [(i * 3 % (n + 1) if i % 4 else i, f"text é {i}", langs[i % len(langs)], f"s{i % 3}", i, *extra) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 10])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 67])
def test_small_blocks(spark, monkeypatch, levels, n):
    """Blocks of two and four nodes take the path of many tiers."""
    if levels == 1 and n > 17:
        pytest.skip("as many tiers as levels")
    monkeypatch.setattr(merkle, "LEVELS", levels)
    same(spark, make(n, ["en"]))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    extra = ("h", 1, 2, "r", 3)
    rows = make(45, ["en", "de", "en", None, "é", "en"])
    rows += [(None, None, None, None, None, *extra), (None, "", "en", "", 0, *extra), (7, "x" * 300_000, "en", "s", None, *extra)]
    rows += [rows[3], rows[3], rows[4], (2**62, "a\x00b", "zz", "日本", 5, *extra), (-5, "b", "en", "s", 1, *extra)]
    same(spark, rows)


def test_hot_null_ids(spark, monkeypatch):
    """Rows that no id tells apart."""
    monkeypatch.setattr(merkle, "LEVELS", 3)
    same(spark, [(None, f"t{i % 5}", "en", "s", 1, "h", 1, 2, "r", 3) for i in range(40)])


def test_empty(spark):
    out = merkle.merkle(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_verified_only_without_tampering(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in merkle.merkle(docs).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
