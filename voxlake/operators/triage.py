"""Error triage: labels of each wrong row, their counts, and a hash-ordered review sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import align as E
from voxlake.functions import text as X
from voxlake.storage import written

from .evaluate import prediction_facts

LABELS = ("english_term_error", "number_error", "hallucination_candidate", "repetition", "short_utterance_failure", "long_utterance_failure", "other_word_error")
SHORT_SECONDS, LONG_SECONDS = 1.0, 15.0


def error_labels(predictions: DataFrame) -> DataFrame:
    """sample_id, normalized_wer and labels of rows with a word error; never their text."""
    sides = (F.length("_reference").alias("r"), F.length("_hypothesis").alias("h"), X.repeats_phrase(F.col("_hypothesis_tokens"), 1).alias("repeats"))
    facts = prediction_facts(predictions, ("wer_normalized",), sides).select("sample_id", "wer_normalized", "english_term_recall", "number_accuracy", "r", "h", "repeats", "audio_seconds")
    # Stored: a filter on what Python returns, or an explode of it, makes Spark compute it once more for the filter, in workers of its own.
    facts = written(facts, "facts")
    c = F.col("wer_normalized")
    rows = facts.withColumn("normalized_wer", E.rate(c["s"], c["d"], c["i"], c["n"])).where("normalized_wer > 0")
    short = lambda m: (F.col(m)["reference"] > 0) & (F.col(m)["matched"] < F.col(m)["reference"])
    tests = (
        short("english_term_recall"), short("number_accuracy"), ((F.col("r") == 0) & (F.col("h") > 0)) | (F.col("h") > F.greatest(F.lit(20), 3 * F.col("r"))),
        F.col("repeats"), F.coalesce(F.col("audio_seconds") < SHORT_SECONDS, F.lit(False)), F.coalesce(F.col("audio_seconds") > LONG_SECONDS, F.lit(False)),
    )
    found = F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, LABELS, strict=False)]), lambda x: x.isNotNull())
    return rows.withColumn("_l", found).select("sample_id", "normalized_wer", F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.array(F.lit(LABELS[-1]))).alias("labels"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """All labels with their counts, zeros included."""
    every = labelled.sparkSession.createDataFrame([(name,) for name in LABELS], "label string")
    counts = labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def review_sample(labelled: DataFrame, most: int = 20) -> DataFrame:
    """By label, the first rows in order of SHA-256 of label and ID."""
    rows = labelled.select("sample_id", "normalized_wer", F.explode("labels").alias("label"))
    order = Window.partitionBy("label").orderBy(F.sha2(F.concat_ws(":", "label", "sample_id"), 256), "sample_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
