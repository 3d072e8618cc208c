"""Stand-in inputs of the registered queries, derived from the test tables.

The tables hold no Arabic text, no waveforms with defects and no predictions; these are made in the query,
the same way in Spark and in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import text as X

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: an Arabic letter for each Latin one.
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنه"
REPO, REVISION, SPLIT = "corpus/documents", "0123456789abcdef", "train"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arabic(text):
    return F.translate(F.lower(text), LATIN, ARABIC)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, index, sample_id, transcript: every fourth text Arabic, every fourth code-switched."""
    words = F.transform(F.split("text", " "), lambda w, i: F.when(i % 3 == 0, _arabic(w)).otherwise(w))
    text = F.when(F.col("doc_id") % 4 == 1, _arabic(F.col("text"))).when(F.col("doc_id") % 4 == 2, F.array_join(words, " ")).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("index"), F.col("doc_id").cast("string").alias("sample_id"), "lang", text.alias("transcript"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, index, transcript, duration."""
    rows = read(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    return rows.select(key.cast("string").alias("sample_id"), key.alias("index"), F.col("text").alias("transcript"), (F.length("text") / F.when(key % 9 == 0, 40.0).otherwise(15.0)).alias("duration"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References: all words of an utterance; hypotheses: a fixed edit of them."""
    key = F.col("conv_id") * 100 + F.col("turn")
    words = X.tokens(X.fold(F.col("text")))
    switched = F.transform(words, lambda w, i: F.when((F.col("key") % 3 == 1) & (i % 3 == 0), _arabic(w)).otherwise(w))
    rows = read(spark, sf_dir, "conversations").select(key.alias("key"), F.length("text").alias("n"), "text").withColumn("ref", switched)
    kept = F.filter("ref", lambda w, i: (i + F.col("key")) % 5 != 0)
    heard = F.transform(kept, lambda w, i: F.when((i + F.col("key")) % 7 == 0, F.lit("sub7")).otherwise(w))
    again = F.when((F.col("key") % 11 == 0) & (F.size("ref") > 0), F.array_repeat(F.element_at("ref", 1), 3)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.col("key").cast("string").alias("sample_id"), F.col("key").alias("index"), F.array_join("ref", " ").alias("reference"), F.array_join(F.concat(heard, again), " ").alias("hypothesis"),
        (F.col("n") / 15.0).alias("audio_seconds"), (F.col("n") / 50.0).alias("processing_seconds"), (F.col("key") % 13 == 0).alias("silent"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, samples, sampling_rate: embeddings as waveforms, by turns silent, clipped, corrupted and plain."""
    x = F.col("embedding").cast("array<double>")
    kind = F.col("vec_id") % 5
    samples = (
        F.when(kind == 0, F.transform(x, lambda v: v * 0))
        .when(kind == 2, F.transform(x, lambda v: F.least(F.greatest(v * 20, F.lit(-1.0)), F.lit(1.0))))
        .when(kind == 3, F.transform(x, lambda v, i: F.when(i == 0, float("nan")).otherwise(v)))
        .otherwise(x)
    )
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("sample_id"), samples.alias("samples"), F.lit(16000).alias("sampling_rate"))
