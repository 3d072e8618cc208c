"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled (hash) order; a copy of a document finishes at a virtual
time, the source's cumulative size over its weight.  Up to ``repeats`` rounds of each source queue
up; all copies are sorted by virtual finish time and the order is truncated where the total budget
is reached.  A source whose rounds are used up leaves the queue, which hands its share to the others
by weight.

Both the running sums by source and the global order are computed in hash or time ranges whose
number grows with the table: totals by range, running totals over the ranges, then a sort inside
each range.  No source and no range has to fit one task; only single numbers reach the driver.

Defined cases: a null text has size 0; a null source is one source, last in order; documents of size
0 are taken 0 words; repeated rows are separate documents (told apart by their hash order); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

WEIGHTS = (5, 2, 1)
REPEATS = 3


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, keys: Sequence[str], place: str, order: Sequence[str], value: str, ranges: int, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to and with each one, in (place, order) order.

    ``place`` is a range number below ``ranges``, rising with the order.  Totals are taken by key and
    range, so a key's rows meet only by range.
    """
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, place).agg(F.sum(value).alias("_t"))
    bases = totals.select(*keys, place, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_own", F.sum(value).over(inside)).join(bases, [*keys, place]).withColumn(out, F.col("_before") + F.col("_own")).drop("_own", "_before")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_share: float = 1.0,
    repeats: int = REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies and taken."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
    )
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("null_last", F.col("source").isNull())
    rank = F.row_number().over(Window.orderBy("null_last", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("r", rank).withColumn("w", weight).withColumn("k", F.col("r").cast("long")).drop("r", "null_last"), "sources")
    total, n_rows, latest = sources.agg(F.sum("source_size"), F.sum("n"), F.max(repeats * F.col("source_size") / F.col("w"))).first()
    total, n_rows, latest = int(total or 0), int(n_rows or 0), float(latest or 0.0)
    budget = int(total * budget_share)

    ranges = max(16, math.isqrt(n_rows))
    numbered = rows.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    key_order = F.shiftrightunsigned(F.col("h"), 40)
    placed = numbered.withColumn("place", F.floor(key_order * F.lit(ranges) / F.lit(1 << 24)).cast("long"))
    summed = running_sum(placed, ["k"], "place", [key_order, F.col("h"), F.col("id")], "size", ranges, "upto")
    summed = written(summed.select("id", "source", "size", "source_size", "w", "k", "h", "upto"), "queued")

    # A copy's place in the global order: virtual finish time, then source, then the queue itself.
    cut_time, cut_k, cut_upto, target_time = _truncate(summed, sources, budget, repeats, latest)
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("w")
    taken = F.lit(0)
    for e in range(repeats):
        t = finish(e)
        inside = (t < cut_time) | ((t == cut_time) & ((F.col("k") < cut_k) | ((F.col("k") == cut_k) & (F.col("upto") <= cut_upto))))
        taken = taken + F.when(inside & (F.col("size") > 0), 1).otherwise(0)
    target = F.least(F.col("w") * target_time, F.lit(float(repeats)) * F.col("source_size"))
    out = summed.withColumn("copies", taken.cast("long")).withColumn("target", target.cast("double")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken")


def _truncate(summed: DataFrame, sources: DataFrame, budget: int, repeats: int, latest: float) -> tuple[float, int, int, float]:
    """Where the global order reaches the budget: the last copy within it, and the virtual time itself.

    Copies are sorted into equal ranges of virtual time; totals by range find the one in which the
    budget is reached, which is split again, until its copies are few enough to sort.
    """
    copies = summed.where(F.col("size") > 0).select("k", "upto", "size", F.explode(F.array(*[((F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("w")) for e in range(repeats)])).alias("t"))
    low, high, base = 0.0, latest * (1 + 1e-9) + 1e-9, 0
    parts, found = 4096, None
    for _ in range(6):
        width = (high - low) / parts
        inside = copies.where((F.col("t") >= low) & (F.col("t") < high))
        totals = inside.groupBy(F.floor((F.col("t") - low) / width).alias("r")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy("r").collect()  # at most parts + 1 rows
        found = None
        for row in totals:
            if base + row["s"] > budget:
                found = row
                break
            base += row["s"]
        if found is None:  # everything fits
            break
        low, high = low + found["r"] * width, low + (found["r"] + 1) * width
        if found["n"] <= 10_000 or width <= abs(low) * 1e-12:
            break
    edge = copies.where((F.col("t") >= low) & (F.col("t") < high)).orderBy("t", "k", "upto")
    last = (low, -1, -1)
    if found is not None:
        for row in edge.toLocalIterator():
            if base + row["size"] > budget:
                break
            base += row["size"]
            last = (row["t"], row["k"], row["upto"])
    else:
        last = (math.inf, 0, 0)
    # Water level: sources that reach their last round are full, the others share the rest by weight.
    level = _level(sources, budget, repeats)
    return (*last, level)


def _level(sources: DataFrame, budget: int, repeats: int) -> float:
    """The virtual time at which all sources together have been given the budget."""
    full = F.lit(float(repeats)) * F.col("source_size")
    ordered = Window.orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.where(F.col("source_size") > 0).withColumn("at", full / F.col("w"))
    rows = rows.withColumn("given", F.coalesce(F.sum(full).over(ordered), F.lit(0.0)))
    rows = rows.withColumn("rest_w", F.sum("w").over(Window.orderBy(F.col("at").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("level", (F.lit(float(budget)) - F.col("given")) / F.col("rest_w"))
    # The first source, by filling time, that isn't full when the rest is shared out.
    hit = rows.where(F.col("level") <= F.col("at")).orderBy("at", "k").select("level").first()
    if hit:
        return float(hit[0])
    return float(rows.agg(F.max("at")).first()[0] or 0.0)
