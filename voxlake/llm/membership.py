"""A bit table of ids: rows that surely aren't wanted needn't be shuffled to find that out.

The table has a bounded number of bits, whatever the number of ids.  It only ever lets too many rows
through (all of them, at worst), so an exact semi-join follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most bits of a table: 2 MB.
MOST_BITS = 1 << 24


def slot(column: str, bits: int):
    """The bit of an id."""
    return F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))


def own_slot(column: str, bits: int):
    """The bit of a value that is a hash already."""
    return F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))


def bit_table(ids: DataFrame, column: str = "id", slot=slot) -> tuple[np.ndarray, int]:
    """Words of 64 bits, and how many bits there are: about 16 for each id, up to MOST_BITS.

    ``ids`` should be a stored table: it is read twice.
    """
    bits, n = 1 << 16, ids.count()
    while bits < MOST_BITS and bits < 16 * n:
        bits <<= 2
    at = ids.select(slot(column, bits).alias("s"))
    words = at.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return table, bits


def holds(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def apart(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose id surely isn't among ``ids`` (a stored table with that column), and the others.

    Only ids are tested in Python; the rows themselves stay in the JVM.
    """
    table, bits = bit_table(ids, id_col)

    @F.arrow_udf("boolean")
    def among(slots: pa.Array) -> pa.Array:
        return pa.array(holds(table, slots.to_numpy(zero_copy_only=False)))

    test = among(slot(id_col, bits))
    return rows.where(~test), rows.where(test)


def one_text_per_id(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, text) and ``ids`` (a stored table of id and digest, and others): of different texts with one id,
    that with the smallest digest stays."""
    chosen = ids.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("id", "least")
    if chosen.isEmpty():
        return rows, ids
    chosen = written(chosen, "chosen")
    stays = F.col("least").isNull() | (F.col("digest") == F.col("least"))
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    part = lambda df: df.join(chosen, "id", "left").where(stays)
    return part(rows.withColumn("digest", digest)).select(*rows.columns), part(ids).select(*ids.columns)
