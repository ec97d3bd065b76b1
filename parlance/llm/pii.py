"""Personal data by rules and a semi-Markov conditional random field.

1. Base spans of four kinds (e-mail addresses, IP addresses, card and phone numbers) are the leftmost
   matches of fixed patterns that also pass a check (parts up to 255, the Luhn sum, the number of digits).
   A match that fails is dropped as a whole, also when it is one span run together with the next, such
   as a phone number in front of an IP address or two cards in a row.
2. What holds digits or an at sign, with its neighbours, is an island, cut into atoms: runs of digits, runs
   of letters, single other characters.  A segmentation labels spans of up to ``ATOMS`` atoms with a kind
   and every other atom as outside.  A span is scored as a whole: is it valid, what stands beside it, how
   many digits and groups it has, how it is punctuated; and by the label in front of it.
3. The weights maximise the conditional likelihood of the base spans on a sample of at most ``SAMPLE``
   islands without a match of too many digits, which may hide spans, so the base rules label the training
   data themselves; what they drop as invalid teaches what is no span.
   Forward and backward sums run over all segmentations.
4. Base spans are fixed.  Between them dynamic programming over the bounded segments finds the best
   segmentation: boundaries and kinds together.  Its spans are added to the base.

Texts are read once; islands, which are rare, are stored.  Each island is judged by itself, so nothing is
gathered per document or source.  Offsets are code points.  All scans are linear in the text, so long
texts without spaces or of digits only are fine.

Null and empty texts have no spans; repeated rows and equal or null ids are rows of their own; an empty
table gives an empty result; without an island to learn from nothing is added.  Columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_value, stored
from parlance.llm.textscan import slices

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
ATOMS = 24
SAMPLE = 4_000
#: Islands longer than this are not learnt from.
LONGEST = 300
STEPS, RATE, DECAY = 80, 0.5, 0.001

# Fixed patterns and limits of the base rules.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

HOT = re.compile(r"[0-9@]")
RUN = re.compile(r"[A-Za-z0-9._%+@()-]*")
GAP = re.compile(r"\x20{1,3}(?=[A-Za-z._%+()-]{0,64}[0-9@])")
INSIDE = LOCAL + "@()"
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
LIKE_PHONE = re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s):
    return "".join(c for c in s if "0" <= c <= "9")


def small_part(part):
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def passes(kind, s):
    """Whether a match of a kind's pattern passes its check."""
    if kind == "ip":
        return all(map(small_part, s.split(".")))
    n = digits_of(s)
    if kind == "card":
        return CARD_DIGITS[0] <= len(n) <= CARD_DIGITS[1] and luhn(n)
    return kind == "email" or PHONE_DIGITS[0] <= len(n) <= PHONE_DIGITS[1]


def overlong(kind, s):
    """Whether a match has too many digits for its kind: it may be two spans that stand together."""
    return kind in ("card", "phone") and len(digits_of(s)) > (CARD_DIGITS if kind == "card" else PHONE_DIGITS)[1]


def matches(text):
    """(kind number, start, end) of all leftmost matches, passed or not."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        before = text[last : m.start()]
        name = len(before) - len(before.rstrip(LOCAL))
        if name:
            out.append((0, m.start() - name, m.end()))
            last = m.end()
    for m in CHAIN.finditer(text):
        if m.group().count(".") > 2:
            ends, at = [], m.start()
            for part in m.group().split("."):
                ends.append((at, at + len(part)))
                at += len(part) + 1
            out.extend((1, ends[i][0], ends[i + 3][1]) for i in range(0, len(ends) - 3, 4))
    out.extend((2, m.start(), m.end()) for m in CARD.finditer(text))
    out.extend((3, m.start(), m.end()) for m in PHONE.finditer(text))
    return out


def islands(text):
    """(start, end) of the stretches around digits and at signs."""
    out, at = [], 0
    while True:
        hit = HOT.search(text, at)
        if hit is None:
            return out
        before = text[at : hit.start()]
        start = hit.start() - (len(before) - len(before.rstrip(INSIDE)))
        end = RUN.match(text, hit.start()).end()
        while gap := GAP.match(text, end):
            end = RUN.match(text, gap.end()).end()
        out.append((start, end))
        at = end


def find_batches(batches):
    """Per row its base spans and its islands with what stands beside them."""
    span = pa.list_(pa.int32())
    island = pa.struct([("at", pa.int32()), ("text", pa.string()), ("left", pa.string()), ("right", pa.string()), ("base", span), ("clean", pa.bool_())])
    for batch in slices(batches, "text", 4 << 20):
        bases, found = [], []
        for text in batch.column("text").to_pylist():
            base, held = [], []
            if text and HOT.search(text):
                raw = matches(text)
                good = [passes(KINDS[k], text[a:b]) for k, a, b in raw]
                base = sorted(m for m, g in zip(raw, good) if g)
                by_start = sorted((a, b, k, g) for (k, a, b), g in zip(raw, good) if g or overlong(KINDS[k], text[a:b]))
                first = 0
                for a, b in islands(text):
                    while first < len(by_start) and by_start[first][1] <= a:
                        first += 1
                    here, i = [], first
                    while i < len(by_start) and by_start[i][0] < b:
                        here.append(by_start[i])
                        i += 1
                    held.append(
                        {
                            "at": a, "text": text[a:b], "left": text[a - 1 : a], "right": text[b : b + 1],
                            "base": [x for s, e, k, g in here if g for x in (k, max(s, a) - a, min(e, b) - a)],
                            "clean": all(g and a <= s and e <= b for s, e, _, g in here),
                        }
                    )
            bases.append([x for m in base for x in m])
            found.append(held)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(bases, span), pa.array(found, pa.list_(island))], ["doc_id", "base", "islands"]
        )


# -- the model -------------------------------------------------------------------------------------

NAMES = (
    "bias", "valid", "invalid", "open left", "open right", "under 10 digits", "10 to 12 digits", "13 to 15 digits",
    "16 digits and more", "plus", "one group", "up to 3 groups", "up to 5 groups", "more groups", "round brackets",
    "brackets that don't close", "mixed separators", "two separators in a row", "leading zero",
)
LABELS = len(KINDS) + 1  # the last one is outside
WIDTH = len(NAMES) * len(KINDS)
WORDLIKE = re.compile(r"[^\W_]|[@+]")


def shaped(kind, s):
    """Whether a string can be of a kind at all; segments that can't are impossible."""
    if kind == 0:
        return EMAIL.fullmatch(s) is not None
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(0 < len(p) < 6 and digits_of(p) == p for p in parts)
    n = len(digits_of(s))
    if kind == 2:
        return 12 <= n <= 19 and CARD.fullmatch(s) is not None
    return 7 <= n <= 15 and LIKE_PHONE.fullmatch(s) is not None


STRICT = (re.compile(r"[A-Za-z0-9._%+-]+" + DOMAIN.pattern), re.compile(r"[0-9]+(?:\.[0-9]+){3}"), CARD, PHONE)


def features(kind, s, left, right):
    """Numbers of the features that a span has."""
    n, groups = len(digits_of(s)), len(re.findall("[0-9]+", s))
    others = set(re.sub("[0-9A-Za-z()+@]", "", s))
    valid = STRICT[kind].fullmatch(s) is not None and passes(KINDS[kind], s)
    has = {
        "bias": True, "valid": valid, "invalid": not valid,
        "open left": WORDLIKE.match(left), "open right": WORDLIKE.match(right),
        "under 10 digits": n < 10, "10 to 12 digits": 10 <= n < 13, "13 to 15 digits": 13 <= n < 16, "16 digits and more": n > 15,
        "plus": s[0] == "+", "one group": groups < 2, "up to 3 groups": 2 <= groups < 4, "up to 5 groups": 4 <= groups < 6,
        "more groups": groups > 5, "round brackets": "(" in s, "brackets that don't close": s.count("(") != s.count(")"),
        "mixed separators": len(others) > 1, "two separators in a row": re.search(r"[\x20.-]{2}", s),
        "leading zero": s.lstrip("+(")[:1] == "0",
    }
    return [kind * len(NAMES) + i for i, name in enumerate(NAMES) if has[name]]


def lattice(text, left="", right="", blocked=()):
    """(number of atoms, where they begin, [(first atom, end atom, kind, features)]) of an island.

    ``blocked`` are (start, end) that no segment may touch.
    """
    edges = [m.start() for m in ATOM.finditer(text)] + [len(text)]
    n = len(edges) - 1
    shut = np.zeros(n, dtype=bool)
    for a, b in blocked:
        shut |= (np.array(edges[:-1]) < b) & (np.array(edges[1:]) > a)
    out = []
    for i in range(n):
        if text[edges[i]] not in INSIDE:
            continue
        for j in range(i + 1, min(n, i + ATOMS) + 1):
            if shut[j - 1]:
                break
            s = text[edges[i] : edges[j]]
            for kind in range(len(KINDS)):
                if shaped(kind, s):
                    before = text[edges[i] - 1] if edges[i] else left
                    after = text[edges[j]] if j < n else right
                    out.append((i, j, kind, features(kind, s, before, after)))
    return n, edges, out


def arcs(n, segments, weights, change):
    """Per end atom the arcs (first atom, label, score); ``change`` scores a label by the one in front."""
    into = [[] for _ in range(n + 1)]
    for i in range(n):
        into[i + 1].append((i, LABELS - 1, 0.0, -1))
    for k, (i, j, kind, f) in enumerate(segments):
        into[j].append((i, kind, float(weights[f].sum()), k))
    return into


def best(n, segments, weights, change):
    """Numbers of the segments of the best segmentation, and its score."""
    into = arcs(n, segments, weights, change)
    score = np.full((n + 1, LABELS), -np.inf)
    score[0, LABELS - 1] = 0.0
    back = {}
    for j in range(1, n + 1):
        for i, label, s, k in into[j]:
            way = score[i] + change[:, label]
            before = int(way.argmax())
            if way[before] + s > score[j, label]:
                score[j, label] = way[before] + s
                back[j, label] = (i, before, k)
    at, out = (n, int(score[n].argmax())), []
    while at[0]:
        i, before, k = back[at]
        if k >= 0:
            out.append(k)
        at = (i, before)
    return out[::-1], float(score[n].max())


def add_logs(a, axis=None):
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top
    return out.item() if axis is None else out.squeeze(axis)


def expected(n, segments, weights, change):
    """(log of the sum over all segmentations, expected features, expected changes of label)."""
    into = arcs(n, segments, weights, change)
    ahead = np.full((n + 1, LABELS), -np.inf)
    ahead[0, LABELS - 1] = 0.0
    for j in range(1, n + 1):
        held = {}
        for i, label, s, _ in into[j]:
            held.setdefault(label, []).append(add_logs(ahead[i] + change[:, label]) + s)
        for label, values in held.items():
            ahead[j, label] = add_logs(np.array(values))
    total = add_logs(ahead[n])
    behind = np.full((n + 1, LABELS), -np.inf)
    behind[n] = 0.0
    f, moves = np.zeros(WIDTH), np.zeros((LABELS, LABELS))
    for j in range(n, 0, -1):
        for i, label, s, k in into[j]:
            way = change[:, label] + s + behind[j, label]
            behind[i] = np.logaddexp(behind[i], way)
            share = np.exp(ahead[i] + way - total)
            moves[:, label] += share
            if k >= 0:
                f[segments[k][3]] += share.sum()
    return total, f, moves


def observed(n, segments, chosen):
    """Features and changes of label of one segmentation."""
    f, moves, label, at = np.zeros(WIDTH), np.zeros((LABELS, LABELS)), LABELS - 1, 0
    starts = {segments[k][0]: k for k in chosen}
    while at < n:
        k = starts.get(at)
        now = segments[k][2] if k is not None else LABELS - 1
        moves[label, now] += 1
        if k is not None:
            f[segments[k][3]] += 1
        label, at = now, segments[k][1] if k is not None else at + 1
    return f, moves


def example(island):
    """(atoms, segments, chosen) of a training island, or None if its spans are no segmentation."""
    n, edges, segments = lattice(island["text"], island["left"], island["right"])
    spans = [tuple(island["base"][i : i + 3]) for i in range(0, len(island["base"]), 3)]
    number = {(edges[i], edges[j], kind): k for k, (i, j, kind, _) in enumerate(segments)}
    chosen = [number.get((a, b, k)) for k, a, b in sorted(spans, key=lambda x: x[1])]
    if None in chosen or any(segments[x][1] > segments[y][0] for x, y in zip(chosen, chosen[1:])):
        return None
    return n, segments, chosen


def fit(sample):
    """(weights, changes) from islands; those with equal lattices count once, by how many there are."""
    seen = {}
    for island in sample:
        found = example(island)
        if found is not None and found[1]:
            key = (found[0], str(found[1]), str(found[2]))
            seen.setdefault(key, [found, 0])[1] += 1
    weights, change = np.zeros(WIDTH), np.zeros((LABELS, LABELS))
    if not seen:
        weights[:: len(NAMES)] = -100.0  # nothing is known, nothing is added
        return weights, change
    gold_f, gold_m = np.zeros(WIDTH), np.zeros((LABELS, LABELS))
    held = [(n, segments, math.sqrt(count), observed(n, segments, chosen)) for (n, segments, chosen), count in seen.values()]
    for _, _, count, (f, m) in held:
        gold_f += count * f
        gold_m += count * m
    total = sum(h[2] for h in held)
    slope_f, slope_m = np.full(WIDTH, 1e-8), np.full((LABELS, LABELS), 1e-8)
    for _ in range(STEPS):
        grad_f, grad_m = gold_f - DECAY * total * weights, gold_m - DECAY * total * change
        for n, segments, count, _ in held:
            _, f, m = expected(n, segments, weights, change)
            grad_f, grad_m = grad_f - count * f, grad_m - count * m
        grad_f, grad_m = grad_f / total, grad_m / total
        grad_m[-1, -1] = 0.0  # outside after outside scores nothing, whatever the length
        slope_f, slope_m = slope_f + grad_f**2, slope_m + grad_m**2
        weights, change = weights + RATE * grad_f / np.sqrt(slope_f), change + RATE * grad_m / np.sqrt(slope_m)
    return weights, change


def decode(island, weights, change):
    """(kind, start, end) that the model adds to the base spans of an island."""
    base = [tuple(island["base"][i : i + 3]) for i in range(0, len(island["base"]), 3)]
    n, edges, segments = lattice(island["text"], island["left"], island["right"], [(a, b) for _, a, b in base])
    if not segments:
        return []
    return [(segments[k][2], edges[segments[k][0]], edges[segments[k][1]]) for k in best(n, segments, weights, change)[0]]


def add_batches(batches, model):
    span = pa.list_(pa.int32())
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            spans = []
            for island in batch.column("islands")[at].as_py():
                spans.extend((k, a + island["at"], b + island["at"]) for k, a, b in decode(island, *model))
            base = batch.column("base")[at].as_py()
            spans.extend(tuple(base[i : i + 3]) for i in range(0, len(base), 3))
            out.append([x for s in sorted(spans) for x in s])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("base"), pa.array(out, span)], ["doc_id", "base", "spans"]
        )


def training_islands(found: DataFrame, most: int = SAMPLE) -> list[dict]:
    """At most ``most`` islands without overlong matches, chosen by hash; long ones are left out."""
    rows = found.select(F.explode("islands").alias("i")).select("i.*").where(F.col("clean") & (F.length("text") <= LONGEST))
    order = [F.xxhash64("text", "left", "right"), "text"]
    return [r.asDict() for r in rows.select("text", "left", "right", "base").orderBy(*order).limit(most).collect()]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row: (kind number, start, end) one after another."""
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        find_batches,
        "doc_id bigint, base array<int>, islands array<struct<at int, text string, left string, right string, base array<int>, clean boolean>>",
    )
    found = stored(found, "islands")
    model = fit(training_islands(found))
    return found.mapInArrow(lambda it: add_batches(it, model), "doc_id bigint, base array<int>, spans array<int>")


def listed(column: str):
    """``kind:start:end`` of spans, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform(slice(sequence(0, size({column}) div 3), 1, cast(size({column}) div 3 AS int)), "
        f"i -> concat_ws(':', array({kinds})[{column}[3 * i]], {column}[3 * i + 1], {column}[3 * i + 2])), ',')"
    )


def pii(docs: DataFrame) -> DataFrame:
    count = lambda k: F.expr(f"cast(size(filter(base, (x, i) -> i % 3 = 0 AND x = {k})) AS bigint)")
    return spans(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
