"""Token counts and ids of whole texts, exact, at a fraction of the library's own cost.

A text falls into *chunks* (a blank and what follows, up to the next one) that no token of the
vocabulary crosses; each chunk's result is independent of its neighbours.  A batch's chunks are
hashed in numpy and only those not met before go to the library.  Texts in which a chunk might not
be independent (a literal special token, a literal piece separator) are given to it whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from . import textops as X

#: Chunks whose result a worker remembers; beyond that it starts afresh (a speed setting only).
REMEMBERED = 3_000_000

_PLAIN = re.compile("[\\x09\\x0a\\x0d\\x20-\\x7eÀ-ɏ¡-¿]*")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_version(path: str) -> str:
    """SHA-256 of a vocabulary file: the tokenizer's version in cache keys."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Known:
    """Remembered results: sorted chunk hashes with counts, and ids where they are wanted."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.count = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(keys), dtype=bool)
        i = np.minimum(np.searchsorted(self.hash, keys), len(self.hash) - 1)
        return self.hash[i] != keys

    def add(self, keys: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Sorted new keys; ``flat`` holds their ids one after another (empty for counts alone)."""
        i = np.searchsorted(self.hash, keys)
        at = len(self.flat) + np.cumsum(count) - count
        self.hash, self.count, self.at = np.insert(self.hash, i, keys), np.insert(self.count, i, count), np.insert(self.at, i, at)
        self.flat = np.concatenate([self.flat, flat])

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hash, keys)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of many spans, one after another."""
    n = end - start
    to = np.cumsum(n)
    return data[np.repeat(start - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)].tobytes()


class _Chunked:
    """Base of the two tokenizers: chunk, look up, encode what is new."""

    keeps_ids = False

    def __init__(self) -> None:
        self.known = _Known()

    def chunks(self, data, offsets):
        """Byte spans of chunks in order, and where each document's chunks begin (rows + 1)."""
        raise NotImplementedError

    def encode(self, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of spans, and their ids one after another."""
        raise NotImplementedError

    def look_up(self, data: np.ndarray, offsets: np.ndarray):
        """Places in ``known`` of every chunk, and the documents' first chunks."""
        start, end, first = self.chunks(data, offsets)
        keys, one, back = X.distinct(X.span_hash(data, start, end))
        if len(self.known.hash) > REMEMBERED:
            self.known.clear()
        new = self.known.missing(keys)
        if new.any():
            one = one[new]
            count, flat = self.encode(data, start[one], end[one])
            self.known.add(keys[new], count, flat if self.keeps_ids else self.known.flat[:0])
        return self.known.find(keys)[back], first

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, first = self.look_up(data, offsets)
        return X.sum_by(self.known.count[at], first)


def _cut(offsets: np.ndarray, extra: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that begin at the documents' starts and at ``extra``; none inside ``whole`` documents."""
    if whole.any():
        extra = extra[~whole[np.searchsorted(offsets, extra, side="right") - 1]]
    full = np.flatnonzero(np.diff(offsets) > 0)
    mark = np.zeros(int(offsets[-1]), dtype=bool)
    mark[offsets[full]] = True
    mark[extra] = True
    start = np.flatnonzero(mark)
    end = np.concatenate([start[1:], offsets[-1:]])[: len(start)]
    return start, end, np.searchsorted(start, offsets)


def _holding(data: np.ndarray, offsets: np.ndarray, needle: bytes) -> np.ndarray:
    """Documents that hold a byte string."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    raw, i = data.tobytes(), -1
    while (i := raw.find(needle, i + 1)) >= 0:
        d = int(np.searchsorted(offsets, i, side="right")) - 1
        out[d] |= i + len(needle) <= offsets[d + 1]
    return out


class PieceCounter(_Chunked):
    """sentencepiece models.  Chunks: a run of blanks and what follows, less the first blank, which
    is what the library puts before a text by itself."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [self.sp.encode(t, out_type=str) for t in ("a  b", " a", "a ")] == [["▁a", "▁", "▁b"], ["▁", "▁a"], ["▁a", "▁"]]
        self.independent = plain and b"\n\x08identity" in self.sp.serialized_model_proto()[-400:] and not any(re.search("[^▁]▁", p) for p in pieces)

    def chunks(self, data, offsets):
        if not self.independent:
            return _cut(offsets, np.zeros(0, np.int64), np.zeros(len(offsets) - 1, bool))
        start, end, first = X.spans(data, offsets, data == 0x20)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        inner = (end < offsets[doc + 1]) & (start > offsets[doc])
        start, end, first = _cut(offsets, start[inner], _holding(data, offsets, "▁".encode()))
        mid = np.ones(len(start), dtype=bool)
        mid[first[:-1][np.diff(first) > 0]] = False
        return start + mid, end, first

    def encode(self, data, start, end):
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        count = np.fromiter((len(x) for x in self.sp.encode(texts, num_threads=1)), np.int64, len(texts))
        return count, np.zeros(0, np.uint32)


class ByteIds(_Chunked):
    """Byte-level BPE files of the tokenizers library.

    Its own merges are given to a faster encoder for chunks of characters whose class no Unicode
    version disputes; other chunks, and texts that hold the special token, go to the library itself.
    """

    keeps_ids = True
    #: Fixed value: the split pattern of byte-level BPE.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        model = spec["model"]
        self.independent = (
            spec.get("normalizer") is None and spec.get("post_processor") is None and model["type"] == "BPE"
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.fast = self._fast(model) if self.independent else None

    def _fast(self, model: dict):
        """The same merges as ranks, if ids are in merge order."""
        import tiktoken

        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = set(self.special)
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(ranks) != 256 + len(merges):
            return None
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.width[i] = len(piece)
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chunks(self, data, offsets):
        whole = np.zeros(len(offsets) - 1, dtype=bool)
        for token in self.special:
            whole |= _holding(data, offsets, token.encode())
        if not self.independent:
            whole[:] = True
        n = len(data)
        follows = np.zeros(n, dtype=bool)
        if n:
            nxt = data[1:]
            follows[:-1] = (data[:-1] == 0x20) & (nxt > 0x20) & (nxt != 0xC2) & ((nxt < 0xE1) | (nxt > 0xE3))
            last = offsets[1:][np.diff(offsets) > 0] - 1
            follows[last] = False
        return _cut(offsets, np.flatnonzero(follows), whole)

    def encode(self, data, start, end):
        count = np.zeros(len(start), np.int64)
        joined = np.zeros(len(start), dtype=bool)
        if self.fast is not None:
            head = (data[start] == 0x20) & (end - start > 1) & (data[np.minimum(start + 1, len(data) - 1)] > 0x20)
            lead = data[np.minimum(start + 1, len(data) - 1)]
            joined = head & (lead != 0xC2) & ((lead < 0xE1) | (lead > 0xE3))
        ids: dict[int, list[int]] = {}
        flat_joined = np.zeros(0, np.uint32)
        if joined.any():
            text = _gather(data, start[joined], end[joined]).decode("utf-8", "replace")
            if not _PLAIN.fullmatch(text) or any(t in text for t in self.special):
                rows = np.flatnonzero(joined)
                ok = np.fromiter((self._is_plain(data[a:b].tobytes()) for a, b in zip(start[rows].tolist(), end[rows].tolist(), strict=True)), bool, len(rows))
                joined[rows[~ok]] = False
                text = _gather(data, start[joined], end[joined]).decode("utf-8", "replace") if joined.any() else ""
            flat_joined = np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
            ends = np.cumsum((end - start)[joined])
            token_ends = np.cumsum(self.width[flat_joined]) if len(flat_joined) else np.zeros(0, np.int64)
            upto = np.searchsorted(token_ends, ends, side="right")
            count[joined] = np.diff(upto, prepend=0)
        rest = np.flatnonzero(~joined)
        raw = [data[a:b].tobytes() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        slow = [(i, r) for i, r in zip(rest.tolist(), raw, strict=True) if self.fast is None or not self._is_plain(r)]
        if slow:
            for (i, _), e in zip(slow, self.library.encode_batch([r.decode("utf-8", "replace") for _, r in slow], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        for i, r in zip(rest.tolist(), raw, strict=True):
            if i not in ids:
                ids[i] = self.fast.encode_ordinary(r.decode("utf-8"))
            count[i] = len(ids[i])
        flat = np.zeros(int(count.sum()), np.uint32)
        at = np.cumsum(count) - count
        if len(flat_joined):
            n = count[joined]
            to = np.cumsum(n)
            flat[np.repeat(at[joined] - (to - n), n) + np.arange(len(flat_joined))] = flat_joined
        for i, x in ids.items():
            flat[at[i] : at[i] + len(x)] = x
        return count, flat

    def _is_plain(self, raw: bytes) -> bool:
        text = raw.decode("utf-8", "replace")
        return _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.special)

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids one after another, each closed by ``end_id``; first-by-document."""
        at, first = self.look_up(data, offsets)
        n = self.known.count[at]
        total = X.sum_by(n, first)
        to = np.cumsum(n)
        source = np.repeat(self.known.at[at] - (to - n), n) + np.arange(int(n.sum()))
        got = self.known.flat[source]
        closing = 0 if end_id is None else 1
        out_first = np.zeros(len(total) + 1, np.int64)
        np.cumsum(total + closing, out=out_first[1:])
        if not closing:
            return got, out_first
        out = np.full(int(out_first[-1]), end_id, dtype=np.uint32)
        doc = np.repeat(np.arange(len(total)), total)
        out[np.arange(len(got)) + doc] = got
        return out, out_first


class LibraryCounter(ByteIds):
    """Any other file of the tokenizers library: whole texts."""


@lru_cache(maxsize=4)
def counter(path: str) -> _Chunked:
    """By file type; one for each worker process."""
    return PieceCounter(path) if path.endswith(".model") else ByteIds(path)
