"""Recognition metrics of predictions: facts of each row, micro-averaged summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import align as E
from voxlake.functions import text as X
from voxlake.storage import bounded_batches, written

#: The error metrics, each a struct<s,d,i,n> of a row.
ERROR_METRICS = ("wer_raw", "wer_normalized", "cer_raw", "cer_normalized", "arabic_token_wer", "english_token_wer")
REASONS = ("silent_speech", "repeated_phrase", "invented_english", "excessive_output")


def normalized(predictions: DataFrame) -> DataFrame:
    """Adds the raw and normalised forms and tokens that all metrics share."""
    out = predictions
    for side in ("reference", "hypothesis"):
        text = F.coalesce(F.col(side), F.lit(""))
        out = out.withColumn(f"_{side}_raw", X.normalize_raw(text)).withColumn(f"_{side}", X.audit_normalize(text))
        out = out.withColumn(f"_{side}_tokens", X.tokens(F.col(f"_{side}")))
    return out


def language_tokens(tokens: Column, kind: str) -> Column:
    return F.filter(tokens, lambda t: X.classify_token(t) == kind)


def prediction_facts(predictions: DataFrame, metrics: tuple[str, ...] = ERROR_METRICS, more: tuple[Column, ...] = ()) -> DataFrame:
    """``predictions``: sample_id, reference, hypothesis, audio_seconds, processing_seconds, silent.  One row each.

    ``more``: further columns, of those of ``normalized``.
    """
    bounded_batches(predictions.sparkSession)
    rows = normalized(predictions)
    ref, hyp = F.col("_reference"), F.col("_hypothesis")
    rt, ht = F.col("_reference_tokens"), F.col("_hypothesis_tokens")
    raw = (F.col("_reference_raw"), F.col("_hypothesis_raw"))
    tokens_of = lambda kind: (language_tokens(rt, kind), language_tokens(ht, kind))
    counts = {
        "wer_raw": E.word_edit_counts(*raw), "wer_normalized": E.word_edit_counts(ref, hyp), "cer_raw": E.character_edit_counts(*raw), "cer_normalized": E.character_edit_counts(ref, hyp),
        "arabic_token_wer": E.edit_counts(*tokens_of(X.AR_ONLY)), "english_token_wer": E.edit_counts(*tokens_of(X.EN_ONLY)),
    }
    english_ref, english_hyp = X.english_terms(ref), X.english_terms(hyp)
    numbers_ref, numbers_hyp = X.canonical_numbers(F.coalesce("reference", F.lit(""))), X.canonical_numbers(F.coalesce("hypothesis", F.lit("")))
    rows = rows.withColumns({"_er": english_ref, "_eh": english_hyp, "_nr": numbers_ref, "_nh": numbers_hyp, "_stats": X.token_stats(ref)})
    return rows.select(
        "sample_id", "audio_seconds", "processing_seconds", *(counts[m].alias(m) for m in metrics), X.category(F.col("_stats")).alias("category"),
        F.struct(X.common_count(F.col("_er"), F.col("_eh")).alias("matched"), F.size("_er").cast("long").alias("reference")).alias("english_term_recall"),
        F.struct(X.common_count(F.col("_nr"), F.col("_nh")).alias("matched"), F.size("_nr").cast("long").alias("reference")).alias("number_accuracy"),
        _reasons(ref, hyp, ht).alias("reasons"), *more,
    )


def _reasons(ref: Column, hyp: Column, tokens: Column) -> Column:
    many = F.size(tokens) >= 10
    excess = (many & (F.length(hyp) > F.greatest(F.lit(20), 3 * F.length(ref)))) | (F.coalesce(F.col("audio_seconds") < 1.0, F.lit(False)) & many)
    tests = (F.coalesce(F.col("silent"), F.lit(False)) & (hyp != ""), X.repeats_phrase(tokens), X.has_surplus(F.col("_eh"), F.col("_er")), excess)
    return F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, REASONS, strict=True)]), lambda x: x.isNotNull())


def merged(metric: str, keep: Column | None = None) -> Column:
    """Micro-average: counts are summed first, then the rate is taken."""
    part = lambda f: F.coalesce(F.sum(F.when(keep, F.col(metric)[f]) if keep is not None else F.col(metric)[f]), F.lit(0))
    s, d, i, n = (part(f) for f in "sdin")
    return F.struct(s.alias("s"), d.alias("d"), i.alias("i"), n.alias("n"), E.rate(s, d, i, n).alias("rate"))


def merged_value(metric: str) -> Column:
    m, r = (F.coalesce(F.sum(F.col(metric)[f]), F.lit(0)) for f in ("matched", "reference"))
    return F.struct(m.alias("matched"), r.alias("reference"), E.ratio(m, r).alias("value"))


def summary_columns() -> list[Column]:
    timed = F.col("processing_seconds").isNotNull() & F.col("audio_seconds").isNotNull()
    audio = F.sum(F.when(timed, F.col("audio_seconds")))
    flagged = F.count_if(F.size("reasons") > 0)
    return [
        F.count("*").alias("examples"), *(merged(m).alias(m) for m in ERROR_METRICS), merged("wer_normalized", F.col("category") == X.CODE_SWITCHED).alias("code_switched_wer"),
        merged_value("english_term_recall").alias("english_term_recall"), merged_value("number_accuracy").alias("number_accuracy"),
        F.try_divide(flagged, F.count("*")).alias("hallucination_rate"), flagged.alias("hallucination_flagged"),
        F.when(audio > 0, F.sum(F.when(timed, F.col("processing_seconds"))) / audio).alias("rtf"), F.count_if(timed).alias("rtf_timed_examples"),
    ]


def benchmark_summary(facts: DataFrame) -> DataFrame:
    """One row; null rates where there is nothing to divide by."""
    return facts.agg(*summary_columns())


def category_buckets(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.count("*").alias("examples"), merged("wer_normalized").alias("wer_normalized"))


def reason_histogram(facts: DataFrame) -> DataFrame:
    reasons = written(facts.select("reasons"), "reasons")  # an explode of what Python returns would compute it twice
    return reasons.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def check_timings(predictions: DataFrame) -> None:
    """ValueError where both timings are there and one is negative."""
    both = F.col("processing_seconds").isNotNull() & F.col("audio_seconds").isNotNull()
    bad = predictions.where(both & ((F.col("processing_seconds") < 0) | (F.col("audio_seconds") < 0))).select("sample_id").first()
    if bad:
        raise ValueError(f"negative duration for sample {bad[0]}")


def real_time_factor(processing: float, audio: float) -> float | None:
    if min(processing, audio) < 0:
        raise ValueError("durations must be non-negative")
    return processing / audio if audio else None


def compute_wer(facts: DataFrame) -> DataFrame:
    """wer and english_term_recall of an evaluation step; NaN, not null, where there is nothing."""
    nan = F.lit(float("nan"))
    return benchmark_summary(facts).select(F.coalesce("wer_normalized.rate", nan).alias("wer"), F.coalesce("english_term_recall.value", nan).alias("english_term_recall"))


def metric_delta(clean: DataFrame, degraded: DataFrame, metric: str = "wer_normalized") -> DataFrame:
    """Clean and degraded micro-averages over the same IDs, and their difference."""
    pair = clean.select("sample_id", F.col(metric).alias("a")).join(degraded.select("sample_id", F.col(metric).alias("b")), "sample_id")
    both = pair.agg(F.count("*").alias("examples"), merged("a")["rate"].alias("clean"), merged("b")["rate"].alias("degraded"))
    return both.withColumn("delta", F.col("degraded") - F.col("clean"))
