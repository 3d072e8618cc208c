"""Token counts through a digest cache.

Content and tokenizer-version digests are joined to stored counts; only distinct misses are encoded
and their counts appended.  Normalisation of content is the identity (null counts as empty), since
any other could change a count.  Copies are dropped twice: within each task before the shuffle, so
that no digest brings more than one text from a task, and again where a digest's texts meet.

Defined cases: null and empty texts have 0 bytes and the tokenizer's count for the empty text;
repeated rows each get a row; null ids are kept; extra columns are ignored; an empty table gives an
empty result.  Texts are encoded whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from . import tokens
from .common import content_digest, scratch_path

CACHE_SCHEMA = "digest binary, n_tokens long"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _first_of_task(batches):
    """One row for each digest that the task has."""
    seen: set[bytes] = set()
    for batch in batches:
        digests = batch.column(0).to_pylist()
        keep = []
        for i, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def _encoder(path: str):
    def run(batches):
        counter = tokens.counter(path)
        for batch in _first_of_task(batches):
            for part in X.slices(batch, "text"):
                n = counter.counts(*X.buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def cached_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """What the cache holds for one tokenizer version."""
    path = f"{cache_path}/tokenizer={version}"
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    cache_path: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit and the content digest.

    ``cache_path`` names a lasting cache; without it the call starts a cold one in the shared folder.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or tokens.default_path("piece_bpe_32k.model")
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokens.file_version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = rows.select(content_digest(F.col("text")).alias("digest"), "text")
    stored = cached_counts(spark, cache_path, version)
    once = keyed.mapInArrow(_first_of_task, "digest binary, text string")
    misses = once.join(stored, "digest", "left_anti")
    fresh = misses.repartition("digest").mapInArrow(_encoder(tokenizer_path), CACHE_SCHEMA)
    fresh.write.mode("append").parquet(f"{cache_path}/tokenizer={version}")
    counts = cached_counts(spark, cache_path, version)
    sized = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
    out = sized.join(counts, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
