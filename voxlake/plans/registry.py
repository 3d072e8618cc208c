"""All registered queries of the library; ``oracles`` has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import align as E
from voxlake.functions import audio as A
from voxlake.functions import text as X
from voxlake.operators import audit, dedup, evaluate, resume, split, training, triage
from voxlake.operators.neardup import NearDuplicates
from voxlake.sources import loaders
from voxlake.storage import written

from . import inputs as I
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RATIOS = {"train": 90, "validation": 5, "test": 5}
AUGMENTATION = {
    "enabled": True, "seed": 42, "apply_probability": 0.35, "telephone_bandpass_probability": 0.3, "narrowband_resample_probability": 0.3, "mulaw_alaw_probability": 0.15,
    "gain_variation_probability": 0.2, "clipping_probability": 0.1, "noise_probability": 0.15, "speed_perturbation_probability": 0.1, "speed_rate_range": [0.95, 1.05],
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Text functions


@query
def normalize_raw(spark, d):
    return I.transcripts(spark, d).select("doc_id", X.normalize_raw(F.col("transcript")).alias("out"))


@query
def audit_normalize(spark, d):
    return I.transcripts(spark, d).select("doc_id", X.audit_normalize(F.col("transcript")).alias("out"))


@query
def clean_transcript(spark, d):
    return I.transcripts(spark, d).select("doc_id", X.clean_transcript(F.col("transcript")).alias("out"))


@query
def character_counts(spark, d):
    return I.transcripts(spark, d).select("doc_id", X.character_counts(F.col("transcript")).alias("c")).select("doc_id", "c.*")


@query
def token_stats(spark, d):
    rows = I.transcripts(spark, d).withColumn("n", X.audit_normalize(F.col("transcript")))
    return rows.select("doc_id", X.token_stats(F.col("n")).alias("s")).select("doc_id", "s.*")


@query
def language_categories(spark, d):
    rows = I.transcripts(spark, d).withColumn("n", X.audit_normalize(F.col("transcript"))).withColumn("s", X.token_stats(F.col("n")))
    return rows.groupBy(X.category(F.col("s")).alias("category")).agg(F.count("*").alias("n"))


@query
def letter_ratio(spark, d):
    return audit.letter_counts(I.transcripts(spark, d), "transcript")


@query
def unusually_long(spark, d):
    rows = I.transcripts(spark, d).withColumn("c", X.clean_transcript(F.col("transcript"))).withColumn("n", X.fold(F.col("c")))
    return rows.select("doc_id", X.is_unusually_long(F.col("c"), F.col("n")).alias("unusual_long"), (F.col("c") == "").alias("empty_transcript"))


@query
def duration_mismatch(spark, d):
    rows = I.utterances(spark, d).withColumn("c", X.normalize_raw(F.col("transcript")))
    return rows.select("sample_id", X.chars_per_second(F.col("c"), F.col("duration")).alias("cps"), X.is_duration_mismatch(F.col("c"), F.col("duration")).alias("mismatch"))


@query
def number_buckets(spark, d):
    return audit.number_histogram(I.read(spark, d, "documents"), "text")


@query
def symbol_frequency(spark, d):
    return audit.symbol_histogram(I.read(spark, d, "documents"), "text")


@query
def duration_quantiles(spark, d):
    return audit.duration_stats(I.utterances(spark, d), "duration")


@query
def stable_sample_id(spark, d):
    docs = I.read(spark, d, "documents").select("doc_id", "text")
    return loaders.load_primary(spark, docs, I.REPO, I.REVISION, I.SPLIT, index_col="doc_id").select(F.col("index").alias("doc_id"), "sample_id")


@query
def load_primary(spark, d):
    docs = I.read(spark, d, "documents").select("doc_id", "text")
    return loaders.load_primary(spark, docs, I.REPO, I.REVISION, I.SPLIT, index_col="doc_id").select("sample_id", "repo_id", "revision", "split", "index", "transcript", "is_pseudo_labelled")


@query
def load_pseudo_labelled(spark, d):
    docs = I.read(spark, d, "documents").select("doc_id", F.col("text").alias("transcription"))
    return loaders.load_pseudo_labelled(spark, docs, I.REPO, I.REVISION, I.SPLIT, index_col="doc_id").select("sample_id", "index", "transcript", "is_pseudo_labelled", "audio_allowed")


@query
def load_external(spark, d):
    rows = I.utterances(spark, d).select("index", "transcript", "duration")
    return loaders.load_external(spark, rows, I.REPO, I.REVISION, "validation").select("sample_id", "index", "transcript", "duration", "role")


@query
def transcript_fingerprint(spark, d):
    return I.transcripts(spark, d).select("doc_id", X.fingerprint(X.audit_normalize(F.col("transcript"))).alias("sha"))


@query
def canonical_numbers(spark, d):
    return I.read(spark, d, "documents").select("doc_id", F.array_join(X.canonical_numbers(F.col("text")), " ").alias("numbers"))


# Audit


def _facts(spark, d):
    return audit.audit_facts(I.utterances(spark, d).withColumn("sampling_rate", F.lit(16000)))


@query
def audit_facts(spark, d):
    return _facts(spark, d).select(
        "sample_id", "index", "duration_seconds", "language_category", "normalized", "char_count", "token_count", "ar_only_tokens", "en_only_tokens", "mixed_tokens", "other_tokens",
        "en_meaningful_tokens", "code_switched", "unusual_long", "mismatch", "empty_transcript",
    )


@query
def audit_summary(spark, d):
    return audit.audit_summary(_facts(spark, d))


# Dedup, near-duplicates, splits


def _records(spark, d):
    rows = I.transcripts(spark, d).withColumn("n", X.audit_normalize(F.col("transcript")))
    return written(rows.select(
        "sample_id", "index", X.fingerprint(F.col("n")).alias("transcript_sha256"), F.when(F.length("transcript") % 7 == 0, F.sha2(F.substring("transcript", 1, 20), 256)).alias("audio_sha256"),
        X.category(X.token_stats(F.col("n"))).alias("language_category"),
    ), "records")


@query
def exact_duplicate_groups(spark, d):
    return dedup.exact_groups(_records(spark, d), "transcript_sha256")


@query
def dedup_canonical(spark, d):
    grouped = dedup.with_groups(_records(spark, d).drop("audio_sha256"))
    return dedup.canonical(grouped).select("sample_id", "index", "transcript_sha256", "group_size", "dedupe_group_sha256")


@query
def dedup_components(spark, d):
    return dedup.canonical(dedup.with_groups(_records(spark, d))).select("sample_id", "index", "group_size", "dedupe_group_sha256")


@query
def dedup_counters(spark, d):
    return dedup.counters(dedup.with_groups(_records(spark, d)))


def _near(spark, d):
    rows = I.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id").alias("index"), X.audit_normalize(F.col("text")).alias("normalized"))
    return NearDuplicates(rows)


@query
def near_duplicate_pairs(spark, d):
    return _near(spark, d).reported()


@query
def near_duplicate_summary(spark, d):
    return _near(spark, d).summary()


def _assigned(spark, d):
    rows = dedup.canonical(dedup.with_groups(_records(spark, d).drop("audio_sha256"))).select("sample_id", "index", "transcript_sha256", "language_category")
    return split.assign(rows, RATIOS)


@query
def split_apportion(spark, d):
    goal = split.targets(_records(spark, d), RATIOS)
    return spark.createDataFrame([(c, s, n) for c, by in goal.items() if c is not None for s, n in by.items()], "language_category string, split string, target long")


@query
def split_assign(spark, d):
    return _assigned(spark, d).select("sample_id", "split")


@query
def split_metadata(spark, d):
    return split.split_metadata(_assigned(spark, d))


@query
def leakage_check(spark, d):
    rows = _records(spark, d).withColumn("split", F.when(F.col("index") % 10 < 8, "train").when(F.col("index") % 10 == 8, "validation").otherwise("test"))
    pairs = rows.select(F.col("sample_id").alias("id_a"), (F.col("index") + 3).cast("string").alias("id_b")).where(F.col("index") % 50 == 0)
    return split.leakage_counts(rows, pairs)


# Evaluation and triage


def _prediction_facts(spark, d):
    return evaluate.prediction_facts(I.predictions(spark, d))


@query
def wer_rows(spark, d):
    rows = _prediction_facts(spark, d)
    c = F.col("wer_normalized")
    return rows.select("sample_id", c["s"].alias("s"), c["d"].alias("d"), c["i"].alias("i"), c["n"].alias("n"), E.rate(c["s"], c["d"], c["i"], c["n"]).alias("rate"))


@query
def cer_rows(spark, d):
    c = F.col("cer_normalized")
    return _prediction_facts(spark, d).select("sample_id", (c["s"] + c["d"] + c["i"]).alias("errors"), c["n"].alias("n"))


@query
def wer_summary(spark, d):
    facts = _prediction_facts(spark, d)
    return facts.agg(evaluate.merged("wer_raw").alias("raw"), evaluate.merged("wer_normalized").alias("x")).select("x.*", F.col("raw.rate").alias("raw_rate"))


@query
def language_wer(spark, d):
    facts = _prediction_facts(spark, d)
    return facts.agg(evaluate.merged("arabic_token_wer").alias("a"), evaluate.merged("english_token_wer").alias("e")).select(
        *(F.col(f"a.{f}").alias(f"arabic_{f}") for f in ("s", "d", "i", "n", "rate")), *(F.col(f"e.{f}").alias(f"english_{f}") for f in ("s", "d", "i", "n", "rate"))
    )


@query
def wer_buckets(spark, d):
    return evaluate.category_buckets(_prediction_facts(spark, d)).select("category", "examples", "wer_normalized.*")


@query
def english_term_recall(spark, d):
    return _prediction_facts(spark, d).agg(evaluate.merged_value("english_term_recall").alias("x")).select("x.*")


@query
def number_accuracy(spark, d):
    return _prediction_facts(spark, d).agg(evaluate.merged_value("number_accuracy").alias("x")).select("x.*")


@query
def benchmark_summary(spark, d):
    out = evaluate.benchmark_summary(_prediction_facts(spark, d))
    return out.select("examples", F.col("code_switched_wer.rate").alias("code_switched_wer"), "hallucination_rate", "hallucination_flagged", F.round("rtf", 9).alias("rtf"), "rtf_timed_examples")


@query
def training_metrics(spark, d):
    return evaluate.compute_wer(_prediction_facts(spark, d))


@query
def hallucination_reasons(spark, d):
    return evaluate.reason_histogram(_prediction_facts(spark, d))


@query
def telephone_delta(spark, d):
    facts = written(_prediction_facts(spark, d).select("sample_id", "audio_seconds", "wer_normalized"), "facts")
    worse = facts.withColumn("wer_normalized", F.when(F.col("audio_seconds") > 4, F.struct(*[(F.col("wer_normalized")[f] + (1 if f == "i" else 0)).alias(f) for f in "sdin"])).otherwise(F.col("wer_normalized")))
    return evaluate.metric_delta(facts, worse)


@query
def error_categories(spark, d):
    return triage.label_counts(triage.error_labels(I.predictions(spark, d)))


@query
def error_review_sample(spark, d):
    return triage.review_sample(triage.error_labels(I.predictions(spark, d)), 5).select("label", "place", "sample_id", "normalized_wer")


# Audio


@query
def audio_flags(spark, d):
    return I.waves(spark, d).select("vec_id", A.audio_flags(F.col("samples")).alias("f")).select("vec_id", "f.*")


@query
def audio_duration(spark, d):
    return I.waves(spark, d).select("vec_id", A.duration_seconds(F.col("samples"), F.col("sampling_rate")).alias("seconds"))


@query
def audio_fingerprint(spark, d):
    return I.waves(spark, d).select("vec_id", A.audio_fingerprint(F.col("sampling_rate"), F.col("samples")).alias("sha"))


@query
def bandpass(spark, d):
    return I.waves(spark, d).select("vec_id", A.bandpass_udf(F.col("samples"), F.col("sampling_rate")).alias("out"))


@query
def narrowband_roundtrip(spark, d):
    return I.waves(spark, d).select("vec_id", A.narrowband_udf(F.col("samples"), F.col("sampling_rate")).alias("out"))


@query
def codec_roundtrip(spark, d):
    rows = I.waves(spark, d)
    return rows.select("vec_id", A.codec_udf(F.col("samples"), F.col("sampling_rate")).alias("mulaw"), A.codec_udf(F.col("samples"), F.col("sampling_rate"), "alaw").alias("alaw"))


@query
def telephone_degrade(spark, d):
    return I.waves(spark, d).select("vec_id", A.telephone_udf(F.col("samples"), F.col("sampling_rate")).alias("out"))


@query
def augment_training(spark, d):
    return I.waves(spark, d).select("vec_id", A.augment_udf(F.col("samples"), F.col("sampling_rate"), F.col("sample_id"), AUGMENTATION).alias("a")).select("vec_id", "a.*")


# Bookkeeping


@query
def resume_pending(spark, d):
    rows = I.predictions(spark, d).select("sample_id", "index")
    return resume.pending(rows, rows.where(F.col("index") % 4 == 0))


@query
def manifest_select(spark, d):
    manifest = I.predictions(spark, d).where(F.col("index") % 3 == 0).select("index", F.concat(F.lit("m-"), "sample_id").alias("sample_id"))
    return resume.select_examples(I.utterances(spark, d).select("sample_id", "index", "transcript"), manifest)


@query
def pilot_subset(spark, d):
    return training.seeded_subset(I.utterances(spark, d).select("sample_id", "index"), 128)


@query
def pilot_hours(spark, d):
    rows = I.utterances(spark, d).select("sample_id", "index", F.length("transcript").cast("double").alias("seconds"))
    return training.to_target_seconds(rows, 5000.0).select("sample_id", "seconds")


@query
def wer_stop_rule(spark, d):
    rows = I.read(spark, d, "events").select(F.col("user_id"), F.col("event_id").alias("step"), F.col("value").alias("wer"))
    return training.stop_rule(rows, run="user_id").select("step", "rising", "non_finite")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.build()
