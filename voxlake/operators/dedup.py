"""Exact dedup by connected components over shared text or audio hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """Each row linked to the first row of its key: as many edges as rows, whatever a key's size."""
    known = rows.where(F.col(key).isNotNull()).select(key, "sample_id")
    first = known.groupBy(key).agg(F.min("sample_id").alias("b"), F.max("sample_id").alias("_most")).where("b < _most").select(key, "b")
    return known.join(first, key).select(F.col("sample_id").alias("a"), "b")


def with_groups(rows: DataFrame, keys: tuple[str, ...] = ("transcript_sha256", "audio_sha256")) -> DataFrame:
    """Adds group: the smallest sample_id of the row's duplicate component.

    With one key a component is a key's group, so a window-free join on the key's minimum is enough.
    """
    keys = tuple(k for k in keys if k in rows.columns)
    if len(keys) == 1:
        labels = _stars(rows, keys[0]).select(F.col("a").alias("sample_id"), F.col("b").alias("_group"))
    else:
        edges = _stars(rows, keys[0])
        for k in keys[1:]:
            edges = edges.unionByName(_stars(rows, k))
        labels = connected_components(edges).select(F.col("node").alias("sample_id"), F.col("label").alias("_group"))
    return rows.join(labels, "sample_id", "left").withColumn("group", F.coalesce("_group", "sample_id")).drop("_group")


def canonical(grouped: DataFrame) -> DataFrame:
    """One row per group: the one with the smallest (index, sample_id), the group's size and its digest."""
    fields = [c for c in grouped.columns if c not in ("index", "sample_id", "group")]
    best = F.min(F.struct("index", "sample_id", *fields)).alias("r")
    members = F.sha2(F.array_join(F.array_sort(F.collect_list("sample_id")), "\n"), 256).alias("dedupe_group_sha256")
    return grouped.groupBy("group").agg(best, F.count("*").alias("group_size"), members).select("r.*", "group_size", "dedupe_group_sha256")


def counters(grouped: DataFrame, keys: tuple[str, ...] = ("transcript_sha256", "audio_sha256")) -> DataFrame:
    """One row: input and removed rows, groups of more than one, colliding hashes of each key."""
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    for k in keys:
        if k in grouped.columns:
            hits = grouped.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias(k.removesuffix("_sha256") + "_collisions"))
            out = out.crossJoin(hits)  # one row each
    return out


def exact_groups(rows: DataFrame, key: str) -> DataFrame:
    """One row: keys that occur more than once, and their surplus rows; empty keys don't count."""
    sizes = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))
