"""Line dedup pairs a document with the first holder of every line and run it shares, frequent ones too."""

import random

from parlance.llm import line_dedup


def test_two_frequent_passages_of_different_origin(spark):
    line = lambda name, n=12: " ".join(f"{name}{i}" for i in range(n))
    texts = {1: [line("a"), line("own1_")], 2: [line("b"), line("own2_")]}
    texts |= {d: [line("a"), line(f"own{d}_"), line("b")] for d in range(3, 23)}
    texts |= {d: [line("b"), line(f"own{d}_")] for d in range(23, 33)}  # b is in more documents than a
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert left == {d: "\n".join(texts[d]) if d < 3 else line(f"own{d}_") for d in texts}


def test_all_first_holders_by_brute_force(spark):
    rng = random.Random(11)
    lines = [" ".join(f"l{k}w{i}" for i in range(rng.randint(1, 15))) for k in range(60)]
    texts = {d: [rng.choice(lines) for _ in range(rng.randint(1, 8))] for d in range(150)}
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id bigint, text string").repartition(3)
    first, want = {}, {}
    long = lambda run: sum(len(x.split()) for x in run) >= line_dedup.MIN_WORDS
    for d, mine in texts.items():
        keys = {(x,) for x in mine}
        for i in range(len(mine)):
            keys |= {next((tuple(mine[i:j]) for j in range(i + 1, len(mine) + 1) if long(mine[i:j])), (mine[i],))}
            keys |= {next((tuple(mine[j : i + 1]) for j in range(i, -1, -1) if long(mine[j : i + 1])), (mine[i],))}
        for x in keys:
            first.setdefault(x, d)
        gone, words = set(), [len(x.split()) for x in mine]
        for f in {first[x] for x in keys} - {d}:
            for a, b in line_dedup.common_blocks(texts[f], mine, words, line_dedup.MIN_WORDS):
                gone.update(range(a, b))
        want[d] = "\n".join(x for i, x in enumerate(mine) if i not in gone)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()} == want
