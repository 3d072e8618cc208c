"""Bookkeeping of resumable batch inference: what is done, what is left, and the run's identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_ids(predictions: DataFrame) -> DataFrame:
    return predictions.select("sample_id").where(F.col("sample_id").isNotNull()).distinct()


def manifest_prefix(manifest: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a manifest in its order (index, sample_id)."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    ordered = manifest.orderBy("index", "sample_id")
    return manifest if limit is None else ordered.limit(limit)


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    return manifest.join(completed_ids(done), "sample_id", "left_anti")


def select_examples(examples: DataFrame, manifest: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of a dataset whose index a manifest names, under the manifest's sample_id; sorted by a column of the
    manifest that holds its order, where one is named."""
    wanted = manifest.select("index", F.col("sample_id").alias("_id"), *([F.col(order).alias("_order")] if order else []))
    out = examples.drop("sample_id").join(wanted, "index").withColumnRenamed("_id", "sample_id")
    return out.orderBy("_order", "index").drop("_order") if order else out


def missing_ids(required: DataFrame, have: DataFrame, key: str = "sample_id") -> DataFrame:
    """Required IDs that aren't there; none if the requirement is met."""
    return required.select(key).distinct().join(have.select(key), key, "left_anti")


def run_inference(pending_rows: DataFrame, model: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Apply a caller's model (an iterator of pandas frames to one of pandas frames) to the pending rows."""
    return pending_rows.mapInPandas(model, schema)


def file_sha256(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def ensure_sidecar(output: str | Path, identity: Mapping) -> None:
    """Create the run's identity beside its output, or require that it hasn't changed.

    Output without an identity, or with another one, is an error.
    """
    output = Path(output)
    sidecar = output.with_suffix(output.suffix + ".meta.json")
    if sidecar.exists():
        if json.loads(sidecar.read_text(encoding="utf-8")) != json.loads(json.dumps(identity)):
            raise ValueError(f"{sidecar} belongs to another run")
        return
    if output.exists() and (any(output.iterdir()) if output.is_dir() else output.stat().st_size):
        raise ValueError(f"{output} has rows but no identity")
    sidecar.parent.mkdir(parents=True, exist_ok=True)
    sidecar.write_text(json.dumps(identity, sort_keys=True, indent=2) + "\n", encoding="utf-8")
