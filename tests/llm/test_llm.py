"""Operators against brute force on a small fixture with the awkward cases in it."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from parlance.llm import (
    components, fingerprints, line_dedup, mixing, quality_classifier, quality_rules, seeds, sentencepieces,
    simhash, substring_dedup, suffix_dedup, token_counts,
)
from parlance.llm.queries import ORACLE, PIECES, QUERIES, RANKS

WHITE = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, block int, seed int, n int, score double"


def fixture_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéßñ日") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, common = line(60), line(12)
    texts = []
    for i in range(60):
        parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if i % 3 == 0:
            parts.insert(0, common)
        texts.append(rng.choice(["\n", "\r\n", "\n\n", " \n\t"]).join(parts))
    texts += texts[:12] + [texts[5] + " x", texts[5][:-3], "UPPER " + texts[7]]
    texts += [None, "", " ", "\n\n", "a", "a b", "To " * 300, "x" * 700, "日本" * 300, "a\x00b \x1c c", "▁ ▁x  ", "$$$ ### *** " * 9]
    texts.append("\n".join(line(20) for _ in range(400)))
    rows = [
        (i if i % 29 else i * 1000, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", None]), None, "k", 1, 2, 3, 0.5)
        for i, t in enumerate(texts)
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, equal ids with other texts, null ids."""
    long = " ".join(f"w{i}" for i in range(80))
    data = [(1, long), (1, long), (1, long + " tail"), (2, long), (None, long), (None, None), (2, ""), (3, "x y")]
    return spark.createDataFrame([(d, t, "en", "s", 0, "k", 1, 2, 3, 0.5) for d, t in data], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


LABELS = "doc_id bigint, quality int, toxic int"
RUNS = {
    1: substring_dedup.substring_dedup,
    2: simhash.simhash,
    3: quality_rules.quality_rules,
    4: lambda d: sentencepieces.sentencepieces(d, PIECES),
    5: line_dedup.line_dedup,
    6: suffix_dedup.suffix_dedup,
    7: mixing.mixing,
    8: lambda d: quality_classifier.quality_classifier(
        d.sparkSession, d, d.sparkSession.createDataFrame([(0, 1, 0), (1, 0, 0), (7, None, None), (None, 1, 1)], LABELS)
    ),
    9: lambda d: token_counts.token_counts(d, RANKS, __import__("public_tokenizers").PATTERN),
    10: fingerprints.fingerprints,
}


@pytest.mark.parametrize("n", sorted(RUNS))
def test_odd_rows_and_empty_tables(odd, n):
    """One result row per row, equal rows alike, extra columns ignored, nothing from nothing."""
    out = RUNS[n](odd).collect()
    assert len(out) == odd.count()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert RUNS[n](odd.limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(docs, rows, small, monkeypatch):
    if small:  # small limits take the paths of large inputs
        for name, value in (("HOT", 1), ("LONGEST", 2), ("BLOCK", 4_000)):
            monkeypatch.setattr(seeds, name, value)
    found = by_id(substring_dedup.substring_dedup(docs))
    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        r = found[d]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), sha(kept))


def test_substring_dedup_of_neighbours(spark):
    """Two documents of one window each, next to one another in a block."""
    text = " ".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(d).collect()} == {1: 0, 2: 13}


def test_wavelet_ranks():
    values = np.random.default_rng(0).integers(0, 37, 1000)
    tree = substring_dedup.Wavelet(values, 37)
    at = np.random.default_rng(1).integers(0, 1001, 500)
    c = np.random.default_rng(2).integers(0, 37, 500)
    assert tree.rank(c, at).tolist() == [int((values[:i] == x).sum()) for x, i in zip(c, at)]


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(docs, rows, small, monkeypatch):
    if small:
        for name, value in (("HOT", 1), ("LONGEST", 3), ("BLOCK", 4_000)):
            monkeypatch.setattr(seeds, name, value)
    found = by_id(suffix_dedup.suffix_dedup(docs))
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    count = collections.Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    for d, t in texts.items():
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = found[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), int(gone.sum()), spans)
        assert r["kept_sha256"] == sha(bytes(b for b, g in zip(t, gone) if not g))


def test_matching_statistics():
    rng = random.Random(0)
    segments = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 60))) for _ in range(20)})
    symbols = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8)
    owner = np.repeat(np.arange(len(segments)), [len(s) + 1 for s in segments])
    got, at = suffix_dedup.matching_statistics(symbols, owner), 0
    every = [(s, i) for s in segments for i in range(len(s))]

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for s in segments:
        for i in range(len(s)):
            want = max(common(s[i:], t[j:]) for t, j in every if (t, j) != (s, i))
            assert got[at + i] == want
        at += len(s) + 1


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash(spark, docs, rows, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = {}
    for d, t, *_ in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        pieces = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[b] < component[a]:
                    component[a], changed = component[b], True
    found = by_id(simhash.simhash(docs))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()} == {
        d: (f"{p:016x}", component[d]) for d, p in prints.items()
    }
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(component.values()))


def test_links_of_chosen_fingerprints(spark):
    """Neighbours at every split of three bits over the segments, none at four."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), 3)) for b in base]
    far = [b ^ sum(1 << i for i in rng.sample(range(64), 4)) for b in base]
    values = [v - (1 << 64) if v >> 63 else v for v in {*base, *near, *far}]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    unsigned = [v % (1 << 64) for v in values]
    want = {v: v for v in unsigned}
    for _ in range(6):
        for a in unsigned:
            for b in unsigned:
                if (a ^ b).bit_count() <= 3:
                    want[a] = want[b] = min(want[a], want[b])
    same = lambda g: {frozenset(k for k in g if g[k] == r) for r in g.values()}
    got = {v: roots.get(v - (1 << 64) if v >> 63 else v, v - (1 << 64) if v >> 63 else v) for v in unsigned}
    assert same(got) == same(want)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in components.components(links).collect()} == {
        **{i: 0 for i in range(41)}, 100: 100, 101: 100
    }


def test_sentencepieces(docs, rows):
    sp = sentencepieces.load(PIECES)
    found = by_id(sentencepieces.sentencepieces(docs, PIECES))
    for d, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want = len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids))
        assert (found[d]["n_tokens"], found[d]["ids_sha256"], found[d]["decoded_sha256"]) == want


def test_chunk_table_starts_again(monkeypatch):
    monkeypatch.setattr(sentencepieces, "TABLE", 3)
    sp = sentencepieces.load(PIECES)
    table = sentencepieces.ChunkTable(sp)
    for text in ("one two three four", "five  six", "one two", "a "):
        chunks = sentencepieces.CHUNK.findall(" " + text)
        table.learn(chunks)
        assert table.take(chunks).tolist() == sp.encode(text, add_bos=True, add_eos=True)


def aligned(a, b):
    """Patience diff of two lists of lines, by recursion; set of (i, j)."""
    if not a or not b:
        return set()
    if a[0] == b[0]:
        return {(0, 0)} | {(i + 1, j + 1) for i, j in aligned(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {(len(a) - 1, len(b) - 1)} | aligned(a[:-1], b[:-1])
    once = [(a.index(x), j) for j, x in enumerate(b) if b.count(x) == 1 and a.count(x) == 1]
    longest = {}  # longest chain that ends at a pair, in the order of b
    for n, (i, j) in enumerate(once):
        longest[n] = max(([*longest[m], n] for m in range(n) if once[m][0] < i), key=len, default=[n])
    top = max(map(len, longest.values()), default=0)
    if not top:
        return set()
    # of several chains the one whose last lines come first in a, and so on backwards
    chain = [once[n] for n in min((c for c in longest.values() if len(c) == top), key=lambda c: [once[n][0] for n in c][::-1])]
    out, i0, j0 = set(chain), 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out |= {(i0 + x, j0 + y) for x, y in aligned(a[i0:i], b[j0:j])}
        i0, j0 = i + 1, j + 1
    return out


def test_line_dedup(docs, rows):
    """Against plain lists: partners from all runs of lines, alignment by recursion."""
    texts = {d: t or "" for d, t, *_ in rows}
    worded = {d: [(i, x) for i, x in enumerate(t.split("\n")) if x.encode().split()] for d, t in texts.items()}
    size = lambda run: sum(len(x.encode().split()) for x in run)
    keys, first = {}, {}
    for d in sorted(worded):
        b = [x for _, x in worded[d]]
        keys[d] = {(x,) for x in b}
        for i in range(len(b)):
            ahead = next((b[i:j] for j in range(i + 1, len(b) + 1) if size(b[i:j]) >= line_dedup.MIN_WORDS), None)
            behind = next((b[j : i + 1] for j in range(i, -1, -1) if size(b[j : i + 1]) >= line_dedup.MIN_WORDS), None)
            keys[d] |= {tuple(x) for x in (ahead, behind) if x}
        for x in keys[d]:
            first.setdefault(x, d)
    found = by_id(line_dedup.line_dedup(docs))
    for d, mine in worded.items():
        gone, b = set(), [x for _, x in mine]
        for f in {first[x] for x in keys[d] if first[x] < d}:
            pairs = sorted(aligned([x for _, x in worded[f]], b))
            block = []
            for p in [*pairs, (-9, -9)]:
                if block and p != (block[-1][0] + 1, block[-1][1] + 1):
                    if size([b[j] for _, j in block]) >= line_dedup.MIN_WORDS:
                        gone |= {mine[j][0] for _, j in block}
                    block = []
                block.append(p)
        left = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
        left = left if left.encode().split() or not gone else ""
        r = found[d]
        assert (r["n_lines"], r["n_removed"], r["kept_sha256"]) == (len(mine), len(gone), sha(left))


def test_line_dedup_of_runs(spark):
    """A copy of a document whose lines stand first in two others, alone and too short there."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    texts = {1: f"{a}\nx", 2: f"{b}\ny", 3: f"{a}\n{b}", 4: f"{a}\n{b}", 5: f"{b}\n{a}"}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(d).collect()} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0}


def test_line_dedup_against_all_sharing_documents(spark, sf):
    """Recall: lines that alignment with every document sharing a line would delete."""
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    worded = {d: [x for x in t.split("\n") if x.encode().split()] for d, t in rows.items()}
    holders, wanted = collections.defaultdict(list), {}
    for d in sorted(worded):
        gone = set()
        for f in {f for x in set(worded[d]) for f in holders[x]}:
            words = [len(x.encode().split()) for x in worded[d]]
            for s, e in line_dedup.common_blocks(worded[f], worded[d], words, line_dedup.MIN_WORDS):
                gone |= set(range(s, e))
        wanted[d] = gone
        for x in set(worded[d]):
            holders[x].append(d)
    found = by_id(line_dedup.line_dedup(spark.read.parquet(f"{sf}/documents.parquet")))
    total = sum(map(len, wanted.values()))
    assert total and sum(found[d]["n_removed"] for d in wanted) >= 0.99 * total
