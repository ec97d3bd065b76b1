"""Every fence of the quality rules follows its group and can fire."""

import random

import pytest

from parlance.llm import quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string"


def group(rng, source, letters, first, n=420):
    """Documents of about ``letters`` characters a word, some with a repeated line or a symbol."""
    rows = []
    for i in range(n):
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(letters - 2, letters + 2)))
        lines = [" ".join(word() for _ in range(30)) for _ in range(6)]
        if i == 0:
            lines.append(lines[0])
        if i % 50 == 1:
            lines[1] += " 50%"
        rows.append((first + i, "\n".join(lines), "en", source))
    return rows


def planted(rng, letters):
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    line = lambda k=letters: " ".join(word(k) for _ in range(30))
    return {
        "long words": "\n".join(line(letters * 3) for _ in range(6)),
        "short words": "\n".join(line(1) for _ in range(6)),
        "symbols": "\n".join(line() + " " + "#$%" * letters for _ in range(6)),
        "lines": "\n".join(x for _ in range(4) for x in (line(), "a b")),
        "repeats": "\n".join([*[line() for _ in range(9)], (x := " ".join(word(letters) for _ in range(20))) + " " + x + " end"]),
    }


@pytest.mark.parametrize("letters", [5, 12])
def test_planted_outliers_go_and_others_stay(spark, letters):
    rng = random.Random(letters)
    rows = group(rng, "s", letters, 0) + group(rng, "t", 17 - letters, 1_000)
    names = {}
    for k, (name, text) in enumerate(planted(rng, letters).items()):
        names[10_000 + k] = name
        rows.append((10_000 + k, text, "en", "s"))
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(found[d]["base_failed"] for d in names)
    assert not {n for d, n in names.items() if found[d]["kept"]}
    others = [r for d, r in found.items() if d not in names]
    assert sum(r["kept"] for r in others) >= 0.99 * len(others)


def test_a_group_has_its_own_fence(spark):
    """The usual word length of one source is an outlier in the other."""
    rng = random.Random(1)
    rows = group(rng, "s", 4, 0) + group(rng, "t", 12, 1_000)
    rows += [(5_000, rows[500][1], "en", "s"), (5_001, rows[3][1], "en", "t")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[500 - 420 + 1_000] and kept[3] and not kept[5_000] and not kept[5_001]
