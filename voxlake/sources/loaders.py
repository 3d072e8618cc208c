"""Dataset loaders: pinned, pruned scans with row identities.

A dataset is a path (or an already read DataFrame) with a stored ``index`` column, or is given one from a
column the caller names; row order is never used for identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.text import stable_sample_id

from . import gates


def _scan(spark: SparkSession, data: str | DataFrame, index_col: str) -> DataFrame:
    df = spark.read.parquet(data) if isinstance(data, str) else data
    if index_col not in df.columns:
        raise ValueError(f"no index column {index_col!r}")
    return df if index_col == "index" else df.withColumnRenamed(index_col, "index")


def _identified(df: DataFrame, repo: str, revision: str, split: str) -> list[Column]:
    return [
        stable_sample_id(repo, revision, split, F.col("index")).alias("sample_id"), F.lit(repo).alias("repo_id"), F.lit(revision).alias("revision"),
        F.lit(split).alias("split"), F.col("index").cast("long").alias("index"),
    ]


def load_primary(
    spark: SparkSession, data: str | DataFrame, repo: str, revision: str, split: str = "train", max_examples: int | None = None, decode_audio: bool = True, index_col: str = "index"
) -> DataFrame:
    """Gold transcripts.  Without ``decode_audio`` the audio column isn't read at all."""
    revision = gates.check_revision(revision)
    gates.check_limit(max_examples)
    df = _scan(spark, data, index_col)
    if max_examples is not None:
        df = df.where(F.col("index") < max_examples)
    text = gates.transcript_column(df.columns)
    audio = [F.col("audio")] if decode_audio and "audio" in df.columns else []
    return df.select(*_identified(df, repo, revision, split), *audio, F.col(text).cast("string").alias("transcript"), F.lit(False).alias("is_pseudo_labelled"), F.lit(decode_audio).alias("decode_audio"))


def load_pseudo_labelled(
    spark: SparkSession, data: str | DataFrame, repo: str, revision: str, split: str = "train", allow_full_audio: bool = False, allow_license_use: bool = False, index_col: str = "index"
) -> DataFrame:
    """Machine transcripts, marked as such; audio is null unless both permissions are given."""
    revision = gates.check_revision(revision)
    audio_ok = gates.check_pseudo_opt_in(allow_full_audio, allow_license_use)
    df = _scan(spark, data, index_col)
    audio = F.col("audio") if audio_ok and "audio" in df.columns else F.lit(None)
    name = F.col("file_name") if "file_name" in df.columns else F.lit(None).cast("string")
    return df.select(
        *_identified(df, repo, revision, split), audio.alias("audio"), F.col("transcription").cast("string").alias("transcript"), name.alias("file_name"),
        F.lit(True).alias("is_pseudo_labelled"), F.lit(audio_ok).alias("audio_allowed"),
    )


def load_external(spark: SparkSession, data: str | DataFrame, repo: str, revision: str, split: str, decode_audio: bool = True, index_col: str = "index") -> DataFrame:
    """External data, for evaluation only."""
    revision = gates.check_revision(revision)
    gates.check_external_split(split)
    df = _scan(spark, data, index_col)
    text = gates.transcript_column(df.columns)
    optional = [(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in (("seg_id", "string"), ("gender", "string"), ("duration", "double"))]
    audio = [F.col("audio")] if decode_audio and "audio" in df.columns else []
    return df.select(*_identified(df, repo, revision, split), *audio, F.col(text).cast("string").alias("transcript"), *optional, F.lit("external_eval_only").alias("role"))


def load_audio_files(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """PCM WAV files as mono waveforms at ``rate``: path, samples, sampling_rate."""
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def decode(content: pd.Series) -> pd.Series:
        import io
        import wave

        import numpy as np

        from voxlake.functions.audio import resampled

        def one(raw: bytes):
            with wave.open(io.BytesIO(raw)) as f:
                width, channels, source = f.getsampwidth(), f.getnchannels(), f.getframerate()
                frames = f.readframes(f.getnframes())
            kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
            x = np.frombuffer(frames, kind).astype(np.float32)
            x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
            return resampled(x.reshape(-1, channels).mean(axis=1).astype(np.float32), source, rate)

        return content.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", decode("content").alias("samples"), F.lit(rate).alias("sampling_rate"))
