"""Vectorised text primitives over Arrow string batches.

Everything works on the UTF-8 bytes of many documents at once.  White space is ASCII only, so byte
offsets of words are exact in UTF-8.  Hashes are 64-bit chains of a non-linear mixer over blocks of
eight bytes; equal words get equal hashes in every batch and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, starting at 0) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, raw_offsets, raw = column.buffers()
    if n == 0 or raw_offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw_offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if raw is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text: bounds the memory of numpy temporaries."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    n, at = batch.num_rows, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


#: Spans longer than this go to BLAKE2b one by one.
LONG_SPAN = 256


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start..end of each span, the same wherever the span lies.

    A chain of the non-linear mixer over blocks of eight bytes, so that no regular pattern of bytes cancels
    out as it would in a polynomial; long spans by BLAKE2b.
    """
    start, size = start.astype(np.int64), (end - start).astype(np.int64)
    out = mix64(size.astype(U64) * U64(0xA0761D6478BD642F) + U64(0x8EBC6AF09C88C6E3))
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left = size[live] - at
        block = blocks[start[live] + at].astype(U64)
        short = left < 8
        block[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[live] = mix64(out[live] * U64(0x9E3779B97F4A7C15) ^ block)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        span = data[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of a batch: byte spans, hashes and, by document, where its words begin (rows + 1)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True in ``inside`` that don't cross documents: start, end, first-by-document."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, first = spans(data, offsets, ~_SPACE[data])
    return Words(start, end, span_hash(data, start, end), first)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside documents, and the index of each window's first word."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(total - n + 1, dtype=U64)
    for i in range(n):
        out = out * U64(0x9FB21C651E98DF25) + w.hash[i : total - n + 1 + i]
    left = np.repeat(w.first[1:], w.counts)[: total - n + 1] - np.arange(total - n + 1)
    at = np.flatnonzero(left >= n)
    return mix64(out[at]), at


def seeded(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one document."""
    return mix64(h ^ (doc.astype(U64) * U64(0x8EBC6AF09C88C6E3)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each row's place among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    k = keys[order]
    new = np.empty(len(k), dtype=bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    return k[new], order[new], back


def repeats(keys: np.ndarray) -> np.ndarray:
    """For each key: does it occur twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it an occurrence after the first."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    later = np.zeros(n, dtype=bool)
    later[1:] = same
    any_ = later.copy()
    any_[:-1] |= same
    many, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    many[order], after[order] = any_, later
    return many, after


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80
