"""The additive audit counters over an unbounded source of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import text as X


def running_audit(examples: DataFrame) -> DataFrame:
    """Counters by language category, for complete or update mode.  ``examples``: transcript."""
    rows = examples.select(X.normalize_raw(F.coalesce("transcript", F.lit(""))).alias("clean"))
    rows = rows.withColumn("norm", X.fold(F.col("clean")))
    return rows.groupBy(X.category(X.token_stats(F.col("norm"))).alias("language_category")).agg(
        F.count("*").alias("examples"), F.count_if(F.col("clean") == "").alias("empty_transcripts"), F.count_if(X.is_unusually_long(F.col("clean"), F.col("norm"))).alias("unusually_long"),
        F.sum(X.count_arabic_letters(F.col("clean"))).alias("arabic_letters"), F.sum(X.count_english_letters(F.col("clean"))).alias("latin_letters"),
    )


def windowed_audit(events: DataFrame, time: str = "ts", late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """The same by time window with a watermark, for append mode."""
    rows = events.withWatermark(time, late).withColumn("norm", X.fold(F.coalesce("transcript", F.lit(""))))
    return rows.groupBy(F.window(time, every), X.category(X.token_stats(F.col("norm"))).alias("language_category")).agg(F.count("*").alias("examples"))
