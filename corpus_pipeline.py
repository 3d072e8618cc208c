"""The corpus pipeline: quality classifier, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes every stage's rows to the shared folder and reads them again; a stage's own tables go with it.

Defined cases: rows are told apart by ``common.keyed``, so that null and repeated ids lose no text; rows
equal in all columns are one document.  Texts that are null or hold no word pass the first three stages by
their own rules (the classifier's score; no group, no passage) and have nothing to mix, so the fourth drops
them.  Ties are broken by key.  Extra columns pass through the first four stages, whatever their names; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import common, packing
from voxlake.llm.classifier import accepted_documents
from voxlake.llm.membership import apart
from voxlake.llm.mixing import mix
from voxlake.llm.near_dedup import near_duplicates
from voxlake.llm.substring_dedup import cut_passages, repeated_passages


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.7 go."""
    return accepted_documents(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    rows, key, _ = common.keyed(docs)
    judged = common.settled(lambda: near_duplicates(rows, id_col=key).select(key, "kept"), "classes")
    gone = judged.where("not kept").select(key)
    repeated = judged.groupBy(key).count().where("count > 1").select(key)
    touched = common.written(gone.union(repeated).distinct(), "touched")
    alone, others = apart(rows, touched, key)
    others = others.join(gone.distinct(), key, "left_anti").dropDuplicates([key])
    return alone.unionByName(others).select(*_columns(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut."""
    rows, key, _ = common.keyed(docs)
    passages = common.settled(lambda: repeated_passages(rows, id_col=key), "passages")
    return cut_passages(rows, passages, id_col=key).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times)."""
    rows, key, unique = common.keyed(docs)
    other, copies = common.unused(rows.columns, "_other"), common.unused(rows.columns, "_copies")
    taken = common.settled(lambda: mix(rows, id_col=key).groupBy(F.col(key).alias(other)).agg(F.sum("copies").cast("int").alias(copies)), "taken")
    once = rows if unique else rows.dropDuplicates([key])
    joined = once.join(taken.where(F.col(copies) > 0), F.col(key) == F.col(other))
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, sequence and offset."""
    return packing.pack(common.written(packing.tokenized_pieces(docs), "pieces"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = common.settled(lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
        common.discard(*before)
        before = [docs]
    return docs
