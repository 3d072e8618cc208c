"""Corpus audit: facts of each example, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import audio as A
from voxlake.functions import text as X

QUANTILES = (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))


def audit_facts(examples: DataFrame) -> DataFrame:
    """``examples``: sample_id, index, transcript, and where there are such, duration, sampling_rate, samples.

    One row per example.  Without waveforms the audio flags are null: unavailable, not false.
    """
    has = set(examples.columns)
    rows = examples.withColumn("_clean", X.clean_transcript(F.coalesce("transcript", F.lit(""))))
    rows = rows.withColumn("_norm", X.fold(F.col("_clean"))).withColumn("_stats", X.token_stats(F.col("_norm")))
    rate = F.col("sampling_rate") if "sampling_rate" in has else F.lit(None).cast("int")
    given = F.col("duration").cast("double") if "duration" in has else F.lit(None).cast("double")
    if "samples" in has:
        flags, print_ = A.audio_flags(F.col("samples")), A.audio_fingerprint(rate, F.col("samples"))
        seconds = A.duration_seconds(F.col("samples"), rate, given)
    else:
        flags = F.lit(None).cast("struct<silent:boolean,clipped:boolean,corrupted:boolean>")
        print_, seconds = F.lit(None).cast("string"), given
    stats = F.col("_stats")
    return rows.withColumn("_seconds", seconds).select(
        "sample_id", "index", F.col("_clean").alias("transcript_raw"), F.col("_seconds").alias("duration_seconds"), rate.alias("sample_rate"),
        flags["silent"].alias("silent"), flags["clipped"].alias("clipped"), flags["corrupted"].alias("corrupted"), print_.alias("audio_fingerprint"),
        X.category(stats).alias("language_category"), F.col("_norm").alias("normalized"), F.length("_clean").cast("long").alias("char_count"),
        stats["token_count"].alias("token_count"), stats["ar_only"].alias("ar_only_tokens"), stats["en_only"].alias("en_only_tokens"),
        stats["mixed"].alias("mixed_tokens"), stats["other"].alias("other_tokens"), stats["en_only_meaningful"].alias("en_meaningful_tokens"),
        X.code_switched(stats).alias("code_switched"), X.is_unusually_long(F.col("_clean"), F.col("_norm")).alias("unusual_long"),
        X.is_duration_mismatch(F.col("_clean"), F.col("_seconds")).alias("mismatch"), (F.col("_clean") == "").alias("empty_transcript"),
    )


def duration_stats(rows: DataFrame, column: str = "duration_seconds") -> DataFrame:
    """One row: count, total, min, quantiles by linear interpolation, max, over durations of 0 or more."""
    d = F.col(column)
    out = rows.where(d.isNotNull() & (d >= 0)).agg(
        F.count("*").alias("n"), F.sum(d).alias("total_seconds"), F.min(d).alias("min_seconds"),
        *(F.percentile(d, q).alias(name) for name, q in QUANTILES), F.max(d).alias("max_seconds"),
    )
    return out


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def number_histogram(rows: DataFrame, text: str = "transcript_raw") -> DataFrame:
    """Structural buckets only; the numbers themselves are never kept."""
    found = rows.select(F.explode(X.number_tokens(F.col(text))).alias("t"))
    return found.select(X.number_bucket(F.col("t")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def symbol_histogram(rows: DataFrame, text: str = "transcript_raw", most: int = 50) -> DataFrame:
    found = rows.select(F.explode(X.symbols(F.col(text))).alias("symbol"))
    return found.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(most)


def letter_counts(rows: DataFrame, text: str = "transcript_raw") -> DataFrame:
    """One row: letters by script and their ratios (0 where there are none)."""
    out = rows.agg(F.coalesce(F.sum(X.count_arabic_letters(F.col(text))), F.lit(0)).alias("arabic_letters"), F.coalesce(F.sum(X.count_english_letters(F.col(text))), F.lit(0)).alias("latin_letters"))
    total = F.col("arabic_letters") + F.col("latin_letters")
    ratio = lambda c: F.when(total == 0, 0.0).otherwise(F.col(c) / total)
    return out.select("*", ratio("arabic_letters").alias("arabic_letter_ratio"), ratio("latin_letters").alias("latin_letter_ratio"))


def audit_summary(facts: DataFrame) -> DataFrame:
    """One row of counters; ``facts`` is read once."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    known = F.when(F.col("duration_seconds") >= 0, F.col("duration_seconds"))
    by_language = [F.count_if(F.col("language_category") == c).alias("n_" + c.lower()) for c in X.CATEGORIES]
    letters = [F.coalesce(F.sum(f(F.col("transcript_raw"))), F.lit(0)).alias(name) for name, f in (("arabic_letters", X.count_arabic_letters), ("latin_letters", X.count_english_letters))]
    return facts.agg(
        F.count("*").alias("examples"), F.count("sample_rate").alias("audio_examples"), yes("empty_transcript"), yes("silent"), yes("clipped"), yes("corrupted"),
        yes("mismatch"), yes("unusual_long"), *by_language, *letters, F.sum("token_count").alias("tokens"), F.count(known).alias("durations"),
        F.min(known).alias("min_seconds"), F.percentile(known, 0.5).alias("median_seconds"), F.max(known).alias("max_seconds"),
    )
