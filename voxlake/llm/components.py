"""Classes that grow round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.graph import connected_components
from voxlake.storage import written

__all__ = ["connected_components", "relabel"]


def relabel(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further edges between labels (``more``: a, b)."""
    step = connected_components(more).select(F.col("node").alias("label"), F.col("label").alias("next"))
    return written(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
