"""Text expressions.  White space is the Unicode set Python's ``str.split`` uses, spelled out so
that Java (whose ``\\s`` is ASCII) and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
SPACE_CHARS = "".join(
    chr(c)
    for lo, hi in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(lo, hi + 1)
)

# Fixed value: the characters of a link.  `$-_` is the range U+0024..U+005F.
LINK = r"https?://[!$-_a-z]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalize(text: Column) -> Column:
    return F.lower(strip(text))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def tokens(text: Column) -> Column:
    """White-space separated tokens; none for an empty text."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def strip_first_link(text: Column) -> Column:
    """Remove every copy of the first link in the text."""
    link = F.regexp_extract(text, LINK, 0)
    return F.when(link != "", F.replace(text, link, F.lit(""))).otherwise(text)


def contains_any(text: Column, phrases) -> Column:
    """Whether the text contains any phrase as a substring.

    A phrase that contains another phrase adds nothing and is left out; the rest are tested
    literally, so a phrase may hold regex characters.  The tests form a balanced tree of ORs, which
    stays inside generated code and stops at the first hit.
    """
    unique = list(dict.fromkeys(phrases))
    tests = [
        F.contains(text, F.lit(p))
        for p in unique
        if not any(q != p and q in p for q in unique)
    ]
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1 :]
    return tests[0]
