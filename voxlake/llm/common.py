"""Shared plumbing: Arrow batch helpers and table readers.

Cutting lineage always goes through a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir`` (``written``); executors that are lost later cost nothing but the stage they ran.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.storage import bounded_batches, bucketed, discard, scratch_path, settled, shared_dir, written

__all__ = ["SPACE_CLASS", "WORD_PATTERN", "bucketed", "content_digest", "discard", "documents", "keyed", "map_arrow", "map_batches", "scratch_path", "settled", "shared_dir", "table", "unused", "whole_runs", "written"]

#: Fixed value: the white space that separates words, as a Java/DuckDB-compatible class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

def returned() -> None:
    """Give freed memory back: a worker lives on after its task, and the next stage's workers need the room."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over bounded batches."""
    bounded_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            returned()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` over single record batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return map_batches(df, run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that none ends inside a run of equal values of a column (rows sorted by it)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        values = one.column(column).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(values, values[-1])) if values[0] <= values[-1] else 0
        if last:
            yield one.slice(0, last)
            one = one.slice(last)
        held, rows = [one], one.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many marks as it takes to differ from all ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str, bool]:
    """``docs`` with a key of each row (a long column of an unused name), that name, and whether no key repeats.

    The key is the id where ids are there and differ; otherwise, for rows without an id or with a repeated one, a hash
    of the whole row.  So rows share a key only if they are equal.
    """
    name = unused(docs.columns, "_row")
    key = F.col(id_col).cast("long")
    ids = docs.select(key.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id")
    if ids.isEmpty():
        return docs.withColumn(name, key), name, True
    ids = written(ids, "ids").select("id", F.lit(True).alias("odd"))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    odd = unused([*docs.columns, name], "_odd")
    rows = docs.withColumn(name, key).join(ids.select(F.col("id").alias(f"{name}id"), F.col("odd").alias(odd)), F.col(name).eqNullSafe(F.col(f"{name}id")), "left")
    return rows.withColumn(name, F.when(F.col(odd), whole).otherwise(F.col(name))).select(*[f"`{c}`" for c in docs.columns], name), name, False


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_digest(text):
    """SHA-256 of the UTF-8 text (null counts as empty) as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
