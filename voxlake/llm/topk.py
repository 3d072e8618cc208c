"""Exact top-k inner products by multi-resolution segment statistics.

A vector's segments have means and deviations; by Cauchy-Schwarz the inner product of two vectors is
at most the sum over segments of ``n * mean * mean' + dev * dev'``, an upper bound of the score (a
lower bound of the distance) that tightens as segments get shorter.  Blocks of queries meet blocks of
rows; within a pair of blocks the best rows by the coarsest bound set each query's threshold, bounds
go coarse to fine over the survivors, and survivors of the finest get their exact integer score.
Each pair keeps its k best per query; those are merged by query.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; only vectors of equal length are compared; a candidate with the query's id is the
query's own row; repeated candidates are ranked each by itself; scores beyond 64 bits are clamped;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

ROW_BLOCK, QUERY_BLOCK = 8192, 512
LEVELS = (1, 4, 16)
#: Most tasks in which blocks meet.
TASKS = 4096
SCALE = 256
_BLOB = "dim int, block long, ids binary, vectors binary"


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products are the bounds: sqrt(n) * mean and deviation of every segment."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1) if b > a else np.zeros(len(x))
        out += [np.sqrt(b - a) * mean, np.sqrt(np.maximum(((part - mean[:, None]) ** 2).sum(axis=1), 0))]
    return np.column_stack(out) if out else np.zeros((len(x), 1))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products (rows of q by rows of x)."""
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if largest < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape).T
    return np.vectorize(lambda v: max(min(v, 2**63 - 1), -(2**63)), otypes=[np.int64])(exact) if exact.size else np.zeros(exact.shape, np.int64)


def best_of_block(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, x: np.ndarray, k: int, levels=LEVELS, known: list[np.ndarray] | None = None):
    """Query places, row ids and scores of each query's k best rows of the block, its own row left out.

    ``known``: the rows' segment statistics by level, where the caller has them.
    """
    n = len(rid)
    own = qid[:, None] == rid[None, :]
    slack = 1e-9 * (1 + np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1))
    stats = list(zip([segment_statistics(q, s) for s in levels], known or [segment_statistics(x, s) for s in levels], strict=True))
    bound = stats[0][0] @ stats[0][1].T
    bound[own] = -np.inf
    # Thresholds: the k-th best exact score among the rows that the coarsest bound likes best.
    m = min(4 * k, n)
    top = np.argpartition(-bound, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (len(qid), 1))
    least = np.full(len(qid), -np.inf)
    for i in range(len(qid)):
        rows = top[i][~own[i][top[i]]]
        if len(rows) >= k:
            least[i] = np.sort(exact_scores(q[i : i + 1], x[rows])[0])[-k]
    alive = (bound >= least[:, None] - slack) & ~own
    for a, b in stats[1:]:
        if alive.mean() > 0.1:
            alive &= a @ b.T >= least[:, None] - slack
        else:
            i, j = np.nonzero(alive)
            keep = np.einsum("ij,ij->i", a[i], b[j]) >= least[i] - slack
            alive[i[~keep], j[~keep]] = False
    dense = exact_scores(q, x) if alive.mean() > 0.1 else None
    places, ids, scores = [], [], []
    for i in range(len(qid)):
        rows = np.flatnonzero(alive[i])
        s = dense[i][rows] if dense is not None else exact_scores(q[i : i + 1], x[rows])[0]
        order = np.lexsort((rid[rows], ~s))[:k]  # ~s falls as s rises, without overflow
        places.append(np.full(len(order), i))
        ids.append(rid[rows][order])
        scores.append(s[order])
    return np.concatenate(places), np.concatenate(ids), np.concatenate(scores)


def packed(vectors: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes that holds them all."""
    largest = np.abs(vectors).max(initial=0)
    return vectors.astype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8").tobytes()


def unpacked(blob: bytes, rows: int, dim: int) -> np.ndarray:
    width = len(blob) // max(rows * dim, 1)
    return np.frombuffer(blob, {2: "<i2", 4: "<i4"}.get(width, "<f8")).reshape(rows, dim).astype(np.float64)


def _blobs(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows by hash, ids and integer components packed; how many blocks."""
    n = rows.count()
    blocks = max(1, -(-n // size))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype("<i8")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([packed(np.floor(SCALE * flat))], pa.binary())})

    placed = rows.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks).cast("long")).alias("block"), "id", "v")
    return placed.groupBy("dim", "block").applyInArrow(pack, _BLOB), blocks


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows other than its own."""

    def clean(df):
        v = F.col("v")
        fine = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine).withColumn("dim", F.size("v"))

    left, n_blocks = _blobs(clean(rows), ROW_BLOCK)
    right, _ = _blobs(clean(queries).dropDuplicates(["id", "v"]), QUERY_BLOCK)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    sides = left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("block", every).withColumn("asks", F.lit(True)))
    # A block of rows is followed by all blocks of queries.  A join of the two could be made by broadcast, which takes all these copies to the driver.
    met = sides.repartition(min(4 * n_blocks, TASKS), "dim", "block").sortWithinPartitions("dim", "block", "asks")

    def run(batches):
        place, rid, x, known = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, block, ids, vectors, asks = (batch.column(j)[i].as_py() for j in range(5))
                of = np.frombuffer(ids, "<i8")
                v = unpacked(vectors, len(of), dim)
                if not asks:
                    place, rid, x, known = (dim, block), of, v, [segment_statistics(v, s) for s in LEVELS]
                elif place == (dim, block):
                    at, best, score = best_of_block(of, v, rid, x, k, known=known)
                    key = np.array([zlib.crc32(r.tobytes()) for r in v], dtype=np.int64)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(key, pa.int64()), pa.array(best), pa.array(score)], names=["query_id", "key", "vec_id", "score"])

    found = map_batches(met.select("dim", "block", "ids", "vectors", "asks"), run, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
