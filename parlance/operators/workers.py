"""Python that runs inside tasks.  Pickled by value, so executors need no copy of the package."""

from __future__ import annotations

import io
import struct
import sys
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score_series(texts, model, batch_size, heads):
    """Logits of the non-blank texts, batch by batch; None for the rest.

    ``model`` maps a list of texts to one (n, labels) array per head.
    """
    blank = [not isinstance(t, str) or not t.strip() for t in texts]
    rows = [i for i, b in enumerate(blank) if not b]
    out = {h: [None] * len(blank) for h in heads}
    for at in range(0, len(rows), batch_size):
        chosen = rows[at : at + batch_size]
        scores = model([texts.iloc[i] for i in chosen])
        for head in heads:
            for i, values in zip(chosen, np.asarray(scores[head], dtype=float)):
                out[head][i] = values
    return out


def murmur(data, seed=42):
    """MurmurHash3 of 32 bits (signed), the hash of Spark's feature hashing."""
    rotate = lambda x, n: ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF
    scramble = lambda k: rotate(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h, whole = seed, len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (rotate(h ^ scramble(k), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


#: Words whose slots a task remembers.
REMEMBERED = 1 << 18


def linear_model(heads):
    """Logits of hashed words.  ``heads`` maps a name to (intercepts, weights by slot and label)."""
    slots = {}
    dim = len(next(iter(heads.values()))[1])

    def slot(word):
        at = slots.get(word)
        if at is None:
            if len(slots) >= REMEMBERED:
                slots.clear()
            at = slots[word] = murmur(word.encode()) % dim
        return at

    def model(texts):
        result = {head: np.zeros((len(texts), len(b))) for head, (b, _) in heads.items()}
        for i, text in enumerate(texts):
            at, n = np.unique([slot(w) for w in text.lower().split()], return_counts=True)
            share = n / np.sqrt((n * n).sum()) if len(n) else n
            for head, (b, w) in heads.items():
                result[head][i] = b + (share @ w[at.astype(np.int64)] if len(n) else 0.0)
        return result

    return model


#: What a damaged or foreign archive raises, at opening or while its member is read.
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, KeyError, RuntimeError, NotImplementedError, OSError, ValueError)


def unzip_lines(batches, member, batch_lines):
    """Lines of the chat member of each zip, a bounded batch at a time.

    Damage ends a member: lines before it are kept, what is left of a line at it is not, and
    ``unzip_errors`` names the archive.
    """
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            name = " ".join(stem.split()[3:])
            held, start = [], 0
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
                        held.append(line.rstrip("\n"))
                        if len(held) == batch_lines:
                            yield _frame(name, start, held)
                            start, held = start + len(held), []
            except DAMAGE:
                pass
            if held:
                yield _frame(name, start, held)


def unzip_errors(batches, member):
    """Why a zip has no lines or not all, for those that can't be read to the end."""
    for files in batches:
        out = []
        for path, content in zip(files["path"], files["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    while raw.read(1 << 20):
                        pass
            except DAMAGE as error:
                out.append((path, f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(out, columns=["path", "reason"])


def _frame(name, start, lines):
    return pd.DataFrame(
        {"chat_id": name, "seq": np.arange(start, start + len(lines)), "line": lines}
    )


def zip_texts(batches, member):
    """Zip each (path, content) text file on its own; used to make test exports."""
    for files in batches:
        packed = []
        for content in files["content"]:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(member, bytes(content))
            packed.append(buffer.getvalue())
        yield pd.DataFrame({"path": files["path"], "content": packed})
