"""Edit alignment with substitutions, deletions and insertions.

On equal units the diagonal is taken; else the least of (cost, insertions, deletions, substitutions).
Within a cell, cost and insertions determine deletions and substitutions; these two are packed into one integer
whose order is theirs, so a cell is a minimum of three sums.  Whole batches of rows are aligned at once: the loop
runs over antidiagonals, numpy over their cells and rows.  Sequences may have any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars as C

COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("s", "d", "i", "n")])
#: Rows, and rows times reference units, that are aligned at once.
_GROUP, _CELLS = 512, 1 << 16


def _flat(rows: list, number: dict) -> tuple[np.ndarray, np.ndarray]:
    """Units as numbers, row after row, and where each row starts; a text's units are its code points."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
    out = np.zeros(int(at[-1]), np.int64)
    for x, i, j in zip(rows, at[:-1], at[1:], strict=True):
        out[i:j] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<i4") if isinstance(x, str) else [number.setdefault(t, len(number)) for t in x]
    return out, at


def _padded(items: np.ndarray, at: np.ndarray, rows: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows as columns, filled up, and their lengths."""
    n = at[rows + 1] - at[rows]
    out = np.full((int(n.max()), len(rows)), fill, np.int32)
    column = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
    out[step, column] = items[at[rows][column] + step]
    return out, n


def _ends(r: np.ndarray, h: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and insertions of each column's alignment."""
    rows, cols = len(r), len(h)
    bits, kind = (15, np.int32) if rows + cols < 1 << 15 else (31, np.int64)
    change, insert = kind(1 << bits), kind((1 << bits) + 1)
    back = h[::-1]
    end = np.zeros(len(n), np.int64)
    # Antidiagonals by reference position: the last, the one before, and the one being filled.
    last, older, cur = (np.zeros((rows + 1, len(n)), kind) for _ in range(3))
    for d in range(1, rows + cols + 1):
        if d <= cols:
            cur[0] = d * int(insert)
        if d <= rows:
            cur[d] = d * int(change)
        lo, hi = max(1, d - cols), min(rows, d - 1)
        if lo <= hi:
            diagonal = older[lo - 1 : hi]
            best = np.minimum(diagonal, last[lo - 1 : hi]) + change
            np.minimum(best, last[lo : hi + 1] + insert, out=best)
            cur[lo : hi + 1] = np.where(r[lo - 1 : hi] == back[cols - d + lo : cols - d + hi + 1], diagonal, best)
        done = np.flatnonzero(n + m == d)
        end[done] = cur[n[done], done]
        last, older, cur = cur, last, older
    return end >> bits, end & ((1 << bits) - 1)


def align_flat(ref: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``align_rows`` of sequences of numbers (0 or more), each side row after row with where each row starts."""
    n, m = np.diff(ref[1]), np.diff(hyp[1])
    out = np.zeros((len(n), 4), np.int64)
    order = np.lexsort((m, n))[::-1]
    at = 0
    while at < len(order):
        part = order[at : at + min(_GROUP, max(1, _CELLS // (int(n[order[at]]) + 1)))]
        at += len(part)
        (r, rows), (h, cols) = _padded(*ref, part, -1), _padded(*hyp, part, -2)
        cost, inserted = _ends(r, h, rows, cols)
        deleted = inserted + rows - cols
        out[part] = np.column_stack([cost - inserted - deleted, deleted, inserted, rows])
    return out


def align_rows(refs: list, hyps: list) -> np.ndarray:
    """Substitutions, deletions, insertions and reference units of each pair of sequences."""
    number: dict = {}
    return align_flat(_flat(refs, number), _flat(hyps, number))


def _numbered(refs: pa.Array, hyps: pa.Array):
    """Slices of both sides as numbers; a null is an empty sequence, and null items are all alike."""
    if not pa.types.is_string(refs.type) and not pa.types.is_large_string(refs.type):
        for sides, _ in C.lists(refs, hyps):
            yield tuple((items + 1, at) for items, at in sides)
        return
    for a in range(0, len(refs), _GROUP):
        yield tuple(_joined([t for t, _ in C.texts(side.slice(a, _GROUP))]) for side in (refs, hyps))


def _joined(parts: list[C.Texts]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.concatenate([np.diff(t.at) for t in parts])
    return np.concatenate([t.codes.astype(np.int64) for t in parts]), np.concatenate([[0], np.cumsum(sizes)])


@F.arrow_udf(COUNTS)
def _align(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """In slices, so that a batch of rows of any length is never held as objects of Python."""
    found = np.concatenate([np.zeros((0, 4), np.int64), *(align_flat(*sides) for sides in _numbered(refs, hyps))])
    return pa.StructArray.from_arrays([C.longs(found[:, k]) for k in range(4)], names=list("sdin"))


@F.arrow_udf(COUNTS)
def _align_words(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    return _align.func(C.words(refs), C.words(hyps))


@F.arrow_udf(COUNTS)
def _align_characters(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    return _align.func(*(pc.replace_substring(x, " ", "") for x in (refs, hyps)))


def word_edit_counts(reference: Column, hypothesis: Column) -> Column:
    """``edit_counts`` of the words of two texts, blanks between them: split where they are aligned, in one pass with what made them."""
    return _align_words(reference, hypothesis)


def character_edit_counts(reference: Column, hypothesis: Column) -> Column:
    """``edit_counts`` of two texts' code points without blanks."""
    return _align_characters(reference, hypothesis)


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """struct<s,d,i,n> of two arrays, or of the code points of two texts."""
    return _align(reference, hypothesis)


def rate(s: Column, d: Column, i: Column, n: Column) -> Column:
    """Null without units and insertions, 1 without units; else errors over units."""
    return F.when((n == 0) & (i == 0), F.lit(None).cast("double")).when(n == 0, 1.0).otherwise((s + d + i) / n)


def ratio(matched: Column, reference: Column) -> Column:
    return F.when(reference > 0, matched / reference)
