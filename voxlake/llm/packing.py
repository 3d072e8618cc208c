"""Best-fit packing by exact-complement hashing.

Texts are tokenised in place; only piece lengths are planned.  The histogram of lengths has at most
``capacity`` entries whatever the number of documents.  For each length, longest first, single, pair
and triple length sums that fill the gap exactly are consumed as often as the availability counts
allow; what is left goes best-fit into the smallest gap that holds it.  The plan is a list of slot
runs (its size depends on ``capacity`` alone), so it travels with the tasks; a piece finds its slot
by its rank among pieces of its length, taken in buckets so that no length lands in one task.

Defined cases: a null text is empty (a lone closing id); repeated rows and null ids are packed like
any other; extra columns are ignored; an empty table gives an empty result.  Documents longer than
the capacity are cut into full pieces after a shorter first one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from . import tokens
from .common import map_arrow, written

CAPACITY = 2048


def tokenized_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit): id, piece, start, length, ids."""
    path = tokenizer_path or tokens.default_path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary"

    def run(batch):
        coder = tokens.counter(path)
        for part in X.slices(batch, "text"):
            ids, first = coder.ids(*X.buffers(part.column(1)), end_id)
            n = np.diff(first)
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            head = n - (k - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            bounds = (np.append(first[doc] + start, first[-1]) * 4).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary],
                names=["id", "piece", "start", "length", "ids"],
            )

    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and how many sequences follow each; a pattern is a list of (length, times)."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        free[length] += n
    done: list[tuple[list[int], int]] = []
    if free[capacity]:
        done.append(([capacity], int(free[capacity])))
        free[capacity] = 0
    open_bins: list[list] = []  # pattern, sequences, gap
    for length in range(capacity - 1, 0, -1):
        while free[length]:
            parts = _complement(free, length, capacity - length)
            if parts is None:
                break
            use, n = np.unique([length, *parts], return_counts=True)
            times = int(min(free[use] // n))
            free[use] -= n * times
            done.append(([length, *parts], times))
    out = [(_runs(p), n) for p, n in done]
    open_bins = _best_fit(free, capacity)
    return out + [(p, n) for p, n, _ in open_bins]


def _runs(lengths: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted(lengths, reverse=True):
        if out and out[-1][0] == x:
            out[-1] = (x, out[-1][1] + 1)
        else:
            out.append((x, 1))
    return out


def _complement(free: np.ndarray, length: int, gap: int) -> list[int] | None:
    """One, two or three available lengths that fill the gap; one of ``length`` is already taken."""
    have = free[: gap + 1].copy()
    if length <= gap:
        have[length] -= 1
    if have[gap] > 0:
        return [gap]
    ok = have > 0
    ok[0] = False
    if pair := _pair(have, ok, gap):
        return pair
    for c in np.flatnonzero(ok)[::-1].tolist():
        if 3 * c < gap:
            break
        rest = gap - c
        if rest < 2:
            continue
        have[c] -= 1
        was, ok[c] = ok[c], have[c] > 0
        pair = _pair(have, ok, rest)
        have[c] += 1
        ok[c] = was
        if pair:
            return [c, *pair]
    return None


def _pair(have: np.ndarray, ok: np.ndarray, gap: int) -> list[int] | None:
    half = gap // 2
    if gap < 2:
        return None
    low = np.flatnonzero(ok[1 : half + 1] & ok[gap - 1 : gap - half - 1 : -1]) + 1
    for a in low.tolist():
        if a * 2 != gap or have[a] >= 2:
            return [gap - a, a]
    return None


def _best_fit(free: np.ndarray, capacity: int) -> list[list]:
    """Best-fit decreasing over counts: each step fills many equal sequences at once."""
    bins: dict[int, list[list]] = {}  # gap -> [pattern, sequences]
    closed: list[list] = []

    def put(pattern, n, gap):
        (bins.setdefault(gap, []) if gap else closed).append([pattern, n, gap])

    for length in range(capacity, 0, -1):
        left = int(free[length])
        while left:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put([(length, per)], full, capacity - per * length)
                if rest:
                    put([(length, rest)], 1, capacity - rest * length)
                left = 0
                break
            pattern, n, _ = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            per = gap // length
            full = min(n, left // per)
            if full:
                put([*pattern, (length, per)], full, gap - per * length)
                left -= full * per
                n -= full
            if n and left and left < per:
                put([*pattern, (length, left)], 1, gap - left * length)
                left, n = 0, n - 1
            if n:
                put(pattern, n, gap)
    return closed + [b for group in bins.values() for b in group]


def slot_runs(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """By length and first rank: where ranks of that length go."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, base, times, offset))
            taken[length] = rank + n * times
            offset += length * times
        base += n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "times", "offset"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 1 to capacity) with sequence_id and offset.

    ``pieces`` should be a stored table: it is read twice.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = slot_runs(plan(counts, capacity))
    total = sum(counts.values())
    per_bucket = max(256, math.isqrt(total))
    split = {k: -(-n // per_bucket) for k, n in counts.items() if n > per_bucket}
    ways = F.lit(1)
    if split:
        ways = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.col("length").cast("int")), F.lit(1))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), ways.cast("long")))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order))
    ranked = keyed.withColumn("_row", within).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    step = 1 << 40
    starts = runs["length"] * step + runs["rank"]

    def place(batch):
        length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        i = np.searchsorted(starts, length * step + rank, side="right") - 1
        at = rank - runs["rank"][i]
        sequence = runs["base"][i] + at // runs["times"][i]
        offset = runs["offset"][i] + at % runs["times"][i] * length
        cols = [batch.column(j) for j in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return map_arrow(ranked, place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise and pack, keeping each piece's ids."""
    return pack(written(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
