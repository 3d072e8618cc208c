"""JSON-lines sources and sinks: predictions, manifests, reported pairs, registries."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.split import SPLITS, split_metadata, verify_leakage
from voxlake.storage import exists, write_text

PREDICTION_SCHEMA = "sample_id string, reference string, hypothesis string, audio_seconds double, processing_seconds double, silent boolean"
MANIFEST_SCHEMA = "sample_id string, index long, transcript_sha256 string, audio_sha256 string, language_category string, dedupe_group_sha256 string"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions; malformed lines and unknown fields are errors, blank lines are skipped."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    known = F.array(*map(F.lit, _names(PREDICTION_SCHEMA)))
    bad = lines.where(keys.isNull() | (F.size(F.array_except(keys, known)) > 0)).orderBy("file").first()
    if bad:
        where = _line_of(spark, bad["file"], bad["value"])
        raise ValueError(f"{bad['file']}, line {where}: not a prediction, or one with unknown fields: {bad['value'][:80]}")
    rows = lines.select(F.from_json("value", PREDICTION_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.withColumn("silent", F.coalesce("silent", F.lit(False)))


def _line_of(spark: SparkSession, file: str, value: str) -> int:
    """The number of the first line of a file that reads so: lines before it, by block and place in the block."""
    lines = spark.read.text(file).select("value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    first = lines.where(F.col("value") == value).agg(F.min("at").alias("first"))
    return lines.join(F.broadcast(first), F.col("at") <= F.col("first")).count()


def append_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def write_manifests(assigned: DataFrame, path: str) -> None:
    """One folder of JSON lines per split; keys sorted, nulls kept, no text."""
    fields = sorted(c for c in _names(MANIFEST_SCHEMA) if c in assigned.columns)
    lines = assigned.select("split", "index", "sample_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    ordered = lines.repartition("split").sortWithinPartitions("split", "index", "sample_id")
    ordered.select("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def write_splits(assigned: DataFrame, path: str, pairs: DataFrame | None = None, about: Mapping | None = None, dedupe: Mapping | None = None) -> dict:
    """Manifests and metadata.json of checked splits: nothing is written where IDs, hashes or linked pairs leak.

    ``about``: what identifies the splits (dataset, revision, seed, ratios); ``dedupe``: counters of the step before.
    """
    leakage = verify_leakage(assigned, pairs)
    counts: dict[str, dict] = {s: {"count": 0, "language_categories": {}} for s in SPLITS}
    for r in split_metadata(assigned).orderBy("split", "language_category").collect():  # splits times categories
        counts[r["split"]]["count"] += r["n"]
        counts[r["split"]]["language_categories"][r["language_category"]] = r["n"]
    metadata = {"schema_version": 1, **(about or {}), "deduplication": dict(dedupe or {}), "splits": counts, "leakage_check": leakage}
    write_manifests(assigned, path)
    write_text(assigned.sparkSession, f"{path}/metadata.json", json.dumps(metadata, indent=2, sort_keys=True) + "\n")
    return metadata


def read_reported_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Near-duplicate pairs of an audit report: id_a, id_b, similarity; none where there is no report."""
    schema = "id_a string, id_b string, similarity double"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    report = spark.read.option("multiLine", True).json(path)
    pairs = F.col("measured.transcript_duplicates.near_duplicate_pairs_reported")
    return report.select(F.explode(pairs).alias("p")).select(F.col("p.id_a").alias("id_a"), F.col("p.id_b").alias("id_b"), F.col("p.similarity").cast("double").alias("similarity"))


def read_registry(path: str | Path) -> list[dict]:
    """Dataset registry of a YAML or JSON file; empty where there is none."""
    path = Path(path)
    if not path.exists():
        return []
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    return list((data or {}).get("datasets") or [])


def registry_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [(e["id"], e.get("role"), e.get("revision"), e.get("row_count"), bool(e.get("pseudo_labelled")), list(e.get("allowed_use") or []), json.dumps(e.get("license"), sort_keys=True)) for e in entries]
    return spark.createDataFrame(rows, "id string, role string, revision string, row_count long, pseudo_labelled boolean, allowed_use array<string>, license string")
