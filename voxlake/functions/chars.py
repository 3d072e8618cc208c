"""Character work over Arrow batches: whole slices of texts as arrays of code points, classes by table look-up.

Regular expressions test each range of a class for each character; a look-up costs the same for any class.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import unicode as U

SPACE, MARK, ARABIC, DIGIT, LATIN, UNSTABLE = (1 << k for k in range(6))
#: Bytes of text, and items of lists, that are worked on at once; a longer row is a slice of its own.
_BYTES, _ITEMS = 1 << 20, 1 << 18


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for bit, ranges in (
        (SPACE, U.SPACE_RANGES), (MARK, (*U.MARK_RANGES, (U.TATWEEL, U.TATWEEL))), (ARABIC, U.arabic_ranges()), (DIGIT, U.digit_ranges()),
        (LATIN, ((0x41, 0x5A), (0x61, 0x7A))), (UNSTABLE, U.UNSTABLE_RANGES),
    ):
        for a, b in ranges:
            out[a : b + 1] |= bit
    return out


# PyArrow's own conversions import pandas, which is a third of a worker's memory.
def _packed(x: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(x, bitorder="little").tobytes())


def longs(x: np.ndarray, valid: np.ndarray | None = None) -> pa.Int64Array:
    nulls = None if valid is None or valid.all() else _packed(valid)
    return pa.Array.from_buffers(pa.int64(), len(x), [nulls, pa.py_buffer(x.astype(np.int64).tobytes())])


def flags(x: np.ndarray, valid: np.ndarray | None = None) -> pa.BooleanArray:
    nulls = None if valid is None or valid.all() else _packed(valid)
    return pa.Array.from_buffers(pa.bool_(), len(x), [nulls, _packed(x)])


def ints(x: np.ndarray) -> pa.Int32Array:
    return pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x.astype(np.int32).tobytes())])


def _valid(column: pa.Array) -> np.ndarray:
    bits = column.buffers()[0]
    if not column.null_count or bits is None:
        return np.ones(len(column), bool)
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[column.offset : column.offset + len(column)].astype(bool)


class Texts:
    """Some rows' texts: code points in a row after the other, and where each row starts (one entry more than rows)."""

    def __init__(self, codes: np.ndarray, at: np.ndarray) -> None:
        self.codes, self.at = codes, at

    @staticmethod
    def of(rows: list[str]) -> Texts:
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        return Texts(np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4"), at)

    def strings(self) -> list[str]:
        whole = self.codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    def bits(self) -> np.ndarray:
        return _classes()[self.codes]

    def starts(self) -> np.ndarray:
        """Is a character its row's first."""
        out = np.zeros(len(self.codes), bool)
        out[self.at[:-1][self.at[:-1] < self.at[1:]]] = True
        return out

    def count(self, which: np.ndarray) -> np.ndarray:
        """Characters that are ``which``, by row."""
        return np.concatenate([[0], np.cumsum(which, dtype=np.int64)])[self.at]

    def per_row(self, which: np.ndarray) -> np.ndarray:
        return np.diff(self.count(which))

    def keep(self, which: np.ndarray) -> Texts:
        return Texts(self.codes[which], self.count(which))

    def arrow(self, valid: np.ndarray) -> pa.StringArray:
        c = self.codes
        if c.dtype == np.uint8 or not len(c) or c.max() < 0x80:
            data, at = c.astype(np.uint8).tobytes(), self.at
        else:
            data = c.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
            width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width)])[self.at]
        nulls = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data), nulls)


def _slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_list(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)


def texts(column: pa.Array) -> Iterator[tuple[Texts, np.ndarray]]:
    """Slices of a column of texts, and which of their rows are not null; a null row is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    valid = _valid(column)
    if not valid.all():
        column = column.fill_null("")
    at, buffer = _offsets(column), column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    for a, b in _slices(at, _BYTES):
        raw, cuts = data[at[a] : at[b]], at[a : b + 1] - at[a]
        if not len(raw) or raw.max() < 0x80:
            yield Texts(raw, cuts), valid[a:b]
            continue
        try:
            codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
            yield Texts(codes, first[cuts]), valid[a:b]
        except UnicodeDecodeError:
            yield Texts.of([raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]), valid[a:b]


def mapped(column: pa.Array, fn: Callable[[Texts, np.ndarray], pa.Array], kind: pa.DataType) -> pa.Array:
    """``fn`` of each slice, as one array."""
    parts = [fn(t, valid) for t, valid in texts(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def nfkc(t: Texts) -> Texts:
    odd = t.per_row((t.bits() & UNSTABLE) != 0) > 0
    if not odd.any():
        return t
    return Texts.of([unicodedata.normalize("NFKC", s) if o else s for s, o in zip(t.strings(), odd.tolist(), strict=True)])


def _collapsed(t: Texts, kept: np.ndarray, codes: np.ndarray) -> Texts:
    """``codes`` of the kept characters; a run of others becomes a blank inside a row and nothing at its ends."""
    after = np.concatenate([[False], kept[:-1]])[: len(kept)]
    after[t.starts()] = False
    out = Texts(np.where(kept, codes, 32).astype(t.codes.dtype, copy=False), t.at).keep(kept | after)
    last = out.at[1:][out.at[1:] > out.at[:-1]] - 1
    blank = last[out.codes[last] == 32]
    if not len(blank):
        return out
    stays = np.ones(len(out.codes), bool)
    stays[blank] = False
    return out.keep(stays)


def normalize_raw(t: Texts) -> Texts:
    return _collapsed(t, (t.bits() & SPACE) == 0, t.codes)


def fold(t: Texts) -> Texts:
    """``text.fold``: marks go, letters and digits stay, all else collapses to blanks; ASCII letters in lower case."""
    bits = t.bits()
    if (bits & MARK).any():
        t = t.keep((bits & MARK) == 0)
        bits = t.bits()
    upper = (t.codes >= 0x41) & (t.codes <= 0x5A)
    return _collapsed(t, (bits & (LATIN | DIGIT | ARABIC)) != 0, np.where(upper, t.codes | 32, t.codes))


def character_counts(t: Texts) -> dict[str, np.ndarray]:
    bits = t.bits()
    return {
        "arabic": t.per_row((bits & ARABIC) != 0), "english": t.per_row((bits & LATIN) != 0), "digits": t.per_row((bits & DIGIT) != 0),
        "symbols": t.per_row((bits & (ARABIC | LATIN | DIGIT | SPACE)) == 0),
    }


def token_stats(t: Texts) -> dict[str, np.ndarray]:
    rows, part = len(t.at) - 1, t.codes != 32
    first = part & (t.starts() | ~np.concatenate([[False], part[:-1]])[: len(part)])
    at = np.flatnonzero(first)
    if not len(at):
        return {name: np.zeros(rows, np.int64) for name in ("token_count", "ar_only", "en_only", "mixed", "other", "en_only_meaningful")}
    has = np.bitwise_or.reduceat(np.where(part, t.bits() & (ARABIC | LATIN), 0).astype(np.uint8), at)
    arabic, latin = (has & ARABIC) != 0, (has & LATIN) != 0
    long = np.add.reduceat(part.astype(np.int64), at) > 1
    row = np.searchsorted(t.at, at, "right") - 1
    count = lambda which: np.bincount(row[which], minlength=rows)
    return {
        "token_count": np.bincount(row, minlength=rows), "ar_only": count(arabic & ~latin), "en_only": count(latin & ~arabic), "mixed": count(arabic & latin),
        "other": count(~arabic & ~latin), "en_only_meaningful": count(latin & ~arabic & long),
    }


def struct(counts: dict[str, np.ndarray], valid: np.ndarray) -> pa.StructArray:
    """Counts of each row as longs, null where the text is null."""
    mask = None if valid.all() else flags(~valid)
    return pa.StructArray.from_arrays([longs(v, valid) for v in counts.values()], names=list(counts), mask=mask)


def bigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct adjacent pairs of each row as numbers (first code times 2**21 plus second), and where each row starts."""
    rows = len(t.at) - 1
    if len(t.codes) < 2:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    c = t.codes.astype(np.int64)
    inside = ~t.starts()[1:]
    row = np.repeat(np.arange(rows), np.diff(t.at))[1:][inside]
    pair = ((c[:-1] << 21) | c[1:])[inside]
    kinds, of = np.unique(pair, return_inverse=True)
    both = np.unique(row * len(kinds) + of)
    return kinds[both % max(len(kinds), 1)], np.searchsorted(both, np.arange(rows + 1) * max(len(kinds), 1))


def words(column: pa.Array) -> pa.Array:
    """The words of texts, blanks between them; none of a null."""
    parts = pc.split_pattern(column.fill_null("") if column.null_count else column, " ")
    at = _offsets(parts)
    values = parts.values.slice(at[0], at[-1] - at[0])
    full = np.diff(_offsets(values)) > 0 if len(values) else np.zeros(0, bool)
    cuts = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[at - at[0]]
    return pa.ListArray.from_arrays(ints(cuts), values.filter(flags(full)))


def lists(*columns: pa.Array) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]]:
    """Slices of columns of lists: items as numbers that are alike across columns (-1: null) with where each row starts, and which rows are not null."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    if not len(columns[0]):
        return
    valid = [_valid(c) for c in columns]
    columns = [c if v.all() else c.fill_null([]) for c, v in zip(columns, valid, strict=True)]
    ats = [_offsets(c) for c in columns]
    for a, b in _slices(sum(ats), _ITEMS):
        parts = [c.values.slice(at[a], at[b] - at[a]) for c, at in zip(columns, ats, strict=True)]
        found = pa.concat_arrays(parts).dictionary_encode().indices
        found = found.fill_null(-1) if found.null_count else found
        numbers = np.frombuffer(found.buffers()[1], np.int32, len(found), 4 * found.offset).astype(np.int64)
        cuts = np.cumsum([0] + [len(p) for p in parts])
        yield [(numbers[i:j], at[a : b + 1] - at[a]) for i, j, at in zip(cuts[:-1], cuts[1:], ats, strict=True)], [v[a:b] for v in valid]


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By row: size of the multiset intersection, and whether a holds an item more often than b."""
    rows, span = len(a[1]) - 1, int(max(a[0].max(initial=0), b[0].max(initial=0))) + 1

    def counted(items, at):
        row = np.repeat(np.arange(rows), np.diff(at))[items >= 0]
        return np.unique(row * span + items[items >= 0], return_counts=True)

    (ka, na), (kb, nb) = counted(*a), counted(*b)
    place = np.searchsorted(kb, ka)
    there = np.zeros(len(ka), np.int64)
    hit = place < len(kb)
    hit[hit] = kb[place[hit]] == ka[hit]
    there[hit] = nb[place[hit]]
    return np.bincount(ka // span, np.minimum(na, there), rows).astype(np.int64), np.bincount(ka[na > there] // span, minlength=rows) > 0


def thrice(items: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """By row: are three equal phrases of 1 to ``most`` items in a row."""
    rows, n = len(at) - 1, len(items)
    end = np.repeat(at[1:], np.diff(at))
    row = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros(rows, bool)
    for w in range(1, most + 1):
        if n < 3 * w:
            break
        run = np.concatenate([[0], np.cumsum(items[:-w] == items[w:])])
        whole = run[2 * w :] - run[: -2 * w] == 2 * w  # from here on, 2 * w items equal those w further on
        k = np.arange(len(whole))
        out[row[k[whole & (k + 3 * w <= end[: len(whole)])]]] = True
    return out
