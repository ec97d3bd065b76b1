"""Phrase mining against plain loops."""

import collections
import random
import re

import numpy as np
import pytest

from parlance.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string, word string, block int, n int, l int, rank int"
EXTRA = ("s", 1, "p", "w", 1, 2, 3, 4)


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower)]


def counted(rows, longest):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        for w in pieces(text):
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def expected(rows, least, top, longest):
    out = []
    for lang, f in counted(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= least}
        inside = set()
        for p, c in often.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * c >= 100 * f[p[i : i + k]]:
                        inside.add(p[i : i + k])
        found = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((lang, " ".join(p), a, l, r, n, score))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, i, *rest) for i, (lang, *rest) in enumerate(found[:top], 1)]
    return sorted(out)


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    words = ["a", "é", "The", "the", "日本", "x\x00y", "z\x1cz", "b", "c", "d", "e", "f"]
    phrases = [["new", "york", "city", "hall", "park"], ["of", "the", "be"], ["b", "b", "b"]]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 25)):
            text += " ".join(rng.choice(phrases) if rng.random() < 0.2 else [rng.choice(words)])
            text += rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!\r\n"])
        rows.append((i, text, rng.choice(["en", "en", "de", "und", None]), *EXTRA))
    rows += [rows[0], rows[0], (None, None, None, *EXTRA), (None, "", "en", *EXTRA), (3, " \t,,", "en", *EXTRA), (3, "the be " * 900, "en", *EXTRA)]
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("share", "propose", "bits", "block"),
    [(2, 2, 1 << 27, 8 << 20), (3, 10**6, 1 << 27, 300), (1, 1, 64, 200), (2, 5, 1 << 12, 50)],
    ids=["good sample", "sample without proposals", "full filter", "tiny blocks"],
)
def test_exact_whatever_the_sample(spark, monkeypatch, share, propose, bits, block):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "STRIPE", block)
    monkeypatch.setattr(collocations, "PORTION", block)
    monkeypatch.setattr(collocations, "BUCKETS", 3)
    monkeypatch.setattr(collocations, "KNOWN", block // 100)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = collocations.mine(docs, least=6, top=15, share=share, propose=propose)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(out) == expected(rows, 6, 15, 5)


def test_failures_of_the_sample_are_followed(spark):
    """Without proposals a frequent phrase is reached by as many passes as it has words beyond two."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    words, _, coded, width, split = collocations.frequent_words(collocations.blocks_of(docs, 4), 6)
    out, passes = collocations.frequent_phrases(coded, 6, 10**6, 5, width, split)
    assert passes == 3
    everything = {(lang, p): c for lang, f in counted(rows, 5).items() for p, c in f.items() if c >= 6 and len(p) > 1}
    names = {r["id"]: (r["lang"], bytes(r["word"]).decode()) for r in words.collect()}
    got = {}
    for r in out.collect():
        key = bytes(r["phrase"])
        ids = [int.from_bytes(key[i : i + width], "big") for i in range(0, len(key), width)]
        got[names[ids[0]][0], tuple(names[i][1] for i in ids)] = r["n"]
    assert got == everything
    assert width == 1
    good, passes = collocations.frequent_phrases(coded, 6, 1, 5, width, split)
    assert passes <= 3 and good.count() == len(everything)


@pytest.mark.parametrize("width", [4, 5, 8])
def test_keys(width):
    h = np.random.default_rng(1).integers(0, 1 << 64, 60, dtype=np.uint64)
    ids = collocations.shortened(h, min(63, 8 * width)).reshape(20, 3)
    data = b"".join(collocations.keys_of(ids, width).to_pylist())
    assert len(data) == 60 * width and (collocations.ids_of(data, 3, width) == ids).all()


def test_small_integers():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 1 << b, 200) for b in (1, 7, 8, 14, 15, 31, 40)])
    data, ends = collocations.small(values)
    assert collocations.large(data).tolist() == values.tolist()
    assert ends[-1] == len(data) and (data[ends - 1] < 128).all()


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(docs).count() == 0
    none = spark.createDataFrame([(1, None, "en", *EXTRA), (2, "a b. c", None, *EXTRA)], SCHEMA)
    assert collocations.collocations(none).count() == 0


def test_products_beyond_64_bits(spark):
    value = spark.sql("SELECT (1000 * (cast(3000000000000 AS decimal(19,0)) * cast(90000000000000 AS decimal(19,0)))) div (cast(5000000000000 AS decimal(19,0)) * cast(4000000000000 AS decimal(19,0))) AS s")
    assert value.first()["s"] == 1000 * 3 * 10**12 * 9 * 10**13 // (5 * 10**12 * 4 * 10**12)
