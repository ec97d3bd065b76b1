"""Emoji as column expressions: find items, turn them into ``:name:`` and back.

An item is one flag, one keycap, or pictographs joined by U+200D, each with an optional variation
selector or skin tone.  Names come from the Unicode character names with a list of exceptions.
A skin tone adds a suffix, joined pictographs are written ``:man+woman+girl:``, flags
``:flag_in:``, so every name can be turned back.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.resources.emoji_ranges import (
    ALIASES, ASTRAL, BASIC, EMOJI_STYLE, SKIN_TONES, TEXT_STYLE,
)

SELECTOR, JOINER, KEYCAP = "️", "‍", "⃣"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FLAG_LETTERS = "".join(chr(0x1F1E6 + i) for i in range(26))
_TONES = "".join(chr(0x1F3FB + i) for i in range(5))


def _ranges(text: str) -> list[tuple[int, int]]:
    pairs = (part.split("-") for part in text.split())
    return [(int(p[0], 16), int(p[-1], 16)) for p in pairs]


def _class(text: str) -> str:
    return "".join(
        f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in _ranges(text)
    )


_PICTURE = f"[{_class(BASIC)}{_class(ASTRAL)}](?:\\x{{FE0F}}|[\\x{{1F3FB}}-\\x{{1F3FF}}])?"
_FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
_KEY = r"[0-9#*]\x{FE0F}?\x{20E3}"
_JOINED = _PICTURE + r"(?:\x{200D}" + _PICTURE + ")*"
#: One emoji item; valid for Java and RE2.
ITEM = f"(?:{_FLAG}|{_KEY}|{_JOINED})"
#: The same items for Java: a look-ahead with four ranges rejects other letters at once.
_FAST = (
    rf"(?:{_KEY}|(?=[\x{{A9}}\x{{AE}}\x{{203C}}-\x{{3299}}\x{{1F004}}-\x{{1FAFF}}])"
    rf"(?:{_FLAG}|{_JOINED}))"
)
NAME = r":[A-Za-z0-9_+#*\-]+:"


def _short_name(cp: int) -> str:
    char = chr(cp)
    return ALIASES.get(char) or unicodedata.name(char, "").lower().replace(" ", "_")


def names() -> dict[str, str]:
    """Single pictograph (with the selector it needs) to name, built from the ranges."""
    plain = {c for lo, hi in _ranges(EMOJI_STYLE) for c in range(lo, hi + 1)}
    styled = {c for lo, hi in _ranges(TEXT_STYLE) for c in range(lo, hi + 1)}
    table = {}
    for lo, hi in _ranges(BASIC) + _ranges(ASTRAL):
        for cp in range(lo, hi + 1):
            name = _short_name(cp)
            if name:
                needs = cp in styled or (cp < 0x10000 and cp not in plain)
                table[chr(cp) + (SELECTOR if needs else "")] = name
    return table


def _name_column(cp: Column) -> Column:
    """Name by code point: two literal arrays indexed by position, folded once by the optimizer."""
    by_cp = {ord(char[0]): name for char, name in names().items()}

    def block(lo: int, hi: int) -> Column:
        text = "|".join(by_cp.get(c, "") for c in range(lo, hi + 1))
        return F.get(F.split(F.lit(text), r"\|"), cp - F.lit(lo))

    return F.nullif(
        F.when(cp >= 0x1F000, block(0x1F000, 0x1FAFF)).otherwise(block(0xA0, 0x33FF)), F.lit("")
    )


def _picture_name(part: Column) -> Column:
    tone = F.instr(F.lit(_TONES), F.substring(part, 2, 1))
    suffix = F.when(
        (F.length(part) > 1) & (tone > 0),
        F.concat(
            F.lit("_"),
            F.get(F.array(*[F.lit(t) for t in SKIN_TONES]), tone - 1),
            F.lit("_skin_tone"),
        ),
    ).otherwise("")
    return F.concat(_name_column(F.ascii(part)), suffix)


def item_name(item: Column) -> Column:
    """``:name:`` of one item; the item itself when a part has no name."""
    flag = F.length(F.translate(item, _FLAG_LETTERS, "")) == 0
    keycap = F.contains(item, F.lit(KEYCAP))
    parts = F.transform(F.split(item, JOINER), _picture_name)
    picture = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "+"))
    name = (
        F.when(flag, F.concat(F.lit("flag_"), F.translate(item, _FLAG_LETTERS, _LETTERS)))
        .when(keycap, F.concat(F.lit("keycap_"), F.substring(item, 1, 1)))
        .otherwise(picture)
    )
    return F.coalesce(F.concat(F.lit(":"), name, F.lit(":")), item)


def _picture_of(name: Column) -> Column:
    table = F.str_to_map(
        F.lit("|".join(f"{name}={char}" for char, name in names().items())), F.lit(r"\|"), F.lit("=")
    )
    tone = F.regexp_extract(name, "_(light|medium-light|medium|medium-dark|dark)_skin_tone$", 1)
    base = F.when(
        tone != "", F.substring(name, F.lit(1), F.length(name) - F.length(tone) - 11)
    ).otherwise(name)
    char = F.try_element_at(table, base)
    tones = F.array(*[F.lit(t) for t in SKIN_TONES])
    toned = F.concat(
        F.replace(char, F.lit(SELECTOR), F.lit("")),
        F.substring(F.lit(_TONES), F.array_position(tones, tone).cast("int"), F.lit(1)),
    )
    return F.when(tone != "", toned).otherwise(char)


def name_item(name: Column) -> Column:
    """Emoji item of a ``:name:``; the text itself when there is no such name."""
    bare = F.btrim(name, F.lit(":"))
    parts = F.transform(F.split(bare, r"\+"), _picture_of)
    picture = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, JOINER))
    found = (
        F.when(
            bare.rlike("^flag_[a-z]{2}$"),
            F.translate(F.substring(bare, 6, 2), _LETTERS, _FLAG_LETTERS),
        )
        .when(
            bare.rlike("^keycap_[0-9#*]$"),
            F.concat(F.substring(bare, 8, 1), F.lit(SELECTOR + KEYCAP)),
        )
        .otherwise(picture)
    )
    return F.coalesce(found, name)


def _replace_each(text: Column, pattern: str, to) -> Column:
    """Replace every match of a pattern by an expression of the match."""
    between = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), to)
    pieces = F.zip_with(between, found, lambda b, f: F.concat(b, F.coalesce(f, F.lit(""))))
    return F.array_join(pieces, "")


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def demojize(text: Column) -> Column:
    has_item = _beyond_ascii(text) & text.rlike(_FAST)
    return F.when(has_item, _replace_each(text, _FAST, item_name)).otherwise(text)


def emojize(text: Column) -> Column:
    has_name = F.contains(text, F.lit(":")) & text.rlike(NAME)
    return F.when(has_name, _replace_each(text, NAME, name_item)).otherwise(text)


def items(text: Column) -> Column:
    """Every emoji item of a text, names turned back first."""
    possible = _beyond_ascii(text) | F.contains(text, F.lit(":"))
    found = F.regexp_extract_all(emojize(text), F.lit(_FAST), F.lit(0))
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def is_item(text: Column) -> Column:
    return _beyond_ascii(text) & text.rlike(f"^{_FAST}$")
