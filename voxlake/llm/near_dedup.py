"""MinHash near-duplicates by ProbMinHash.

A text is a bag of shingles (five words) with their counts.  Every shingle is a Poisson process of its
weight's rate, whose arrivals fall on random registers; a register keeps the shingle that arrived first,
and a process ends early once it is past the text's slowest register.  Two texts agree on a register with
probability equal to their probability Jaccard similarity.  A text that repeats shingles is signed twice,
with its counts and with all weights 1 (where the probability is the plain Jaccard similarity of the sets),
any other text once, as both are the same.  So candidates are found as surely by either measure.

Registers are banded.  Copies are folded into one node first.  Within a band's bucket every node is
compared with the bucket's leader only, the node that shares most buckets with others (in a group of
edited copies, the one nearest the original); nodes that this leaves apart are compared with the
leaders of their other buckets.  In buckets that still hold several classes, a node that alone is outside
the largest class is compared with all others of the bucket.  Nodes of the other such buckets meet by an
exact prefix join: in an order common to all texts, rarest first, two similar texts have their first common
shingle near the start of both, so only those that share one there are compared (further exact bounds come
from what lies before it, and from bit tables: those of two sets differ in no more bits than the sets do in
elements).  So no bucket is given up, and a line that many texts share makes no pairs.  Comparison is exact,
on whole bags: a pair is linked if its probability Jaccard similarity (counts as weights) or its plain one
(sets) is ``threshold`` or more.
Classes are connected components.

Defined cases: texts without words, and rows without an id, are alone in their class (the latter with
a null class); texts of fewer than five words have one shingle; of different texts with one id, that with
the smallest digest is judged, and equal rows are one document; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .common import map_arrow, written
from .components import connected_components, relabel
from .membership import bit_table, holds, one_text_per_id, slot

SHINGLE = 5
THRESHOLD = 0.8
#: 20 bands of 5 registers: a pair at 0.8, by either measure, shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
#: Nodes outside a bucket's largest class that are compared with all its nodes; where there are more, by their prefixes.
MINORITY = 1


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows (of all words, where there are fewer), document by document, and first-by-document."""
    data, offsets = X.buffers(texts)
    w = X.words(data, offsets)
    h, at = X.ngrams(w, n)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = w.counts[short] > i
            whole[has] = whole[has] * np.uint64(0x9FB21C651E98DF25) + w.hash[w.first[:-1][short[has]] + i]
        h, doc = np.concatenate([h, X.mix64(whole)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def weighted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document, hash, count; sorted by document and hash."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Winning shingle of every register, by document (0 where a document has no shingle)."""
    time = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    t = np.zeros(len(h))
    step = np.zeros(len(h), np.uint64)
    live = np.arange(len(h))
    while len(live):
        # Several arrivals at a time when few processes are left.
        many = max(1, min(64, 20_000 // len(live)))
        turn = step[live][:, None] + np.arange(1, many + 1, dtype=np.uint64)
        r = X.mix64(h[live][:, None] ^ (turn * np.uint64(0xD1B54A32D192ED03)))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        when = t[live][:, None] + np.cumsum(-np.log(u), axis=1) / weight[live][:, None]
        t[live], step[live] = when[:, -1], step[live] + np.uint64(many)
        register = (X.mix64(r ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(registers)).astype(np.int64)
        place = (doc[live][:, None] * registers + register).ravel()
        when = when.ravel()
        np.minimum.at(time, place, when)
        won = time[place] == when
        winner[place[won]] = np.repeat(h[live], many)[won]
        slowest = time.reshape(n_docs, registers).max(axis=1)
        live = live[t[live] < slowest[doc[live]]]
    return winner.reshape(n_docs, registers)


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    out = np.zeros((len(winner), bands), np.uint64)
    for i in range(rows):
        out = out * np.uint64(0x9E3779B97F4A7C15) + X.mix64(winner[:, i::rows][:, :bands])
    return X.mix64(out ^ (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common shingles in two sorted arrays of distinct ones."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    ia = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
    return ia, at[ia]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct shingles."""
    both = len(common(a, b)[0])
    return both / max(len(a) + len(b) - both, 1)


def probability_similarity(x: np.ndarray, y: np.ndarray, only_a: float, only_b: float) -> float:
    """Probability Jaccard similarity of two bags: weights of their common shingles, and the sums of the others.

    The sum, over common shingles d, of 1 / sum over all e of max(x[e] / x[d], y[e] / y[d]).  In order of x / y, the
    first kind of term comes from the shingles after d, the second from the others.
    """
    order = np.argsort(x / y, kind="stable")
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    after = np.cumsum(x[::-1])[::-1] - x
    upto = np.cumsum(y)
    return float((1 / ((after + only_a) / x + (upto + only_b) / y)).sum())


def signatures(rows: DataFrame, bands: int = BANDS, per_band: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """``rows``: id, text, digest.  Of texts with words: id, digest and band keys (twice as many where the text repeats
    shingles)."""
    registers = bands * per_band

    def run(batch):
        for part in X.slices(batch, "text"):
            h, first = shingles(part.column(1), n)
            doc, h, count = weighted(h, first)
            plain = prob_min_hash(doc, h, np.ones(len(h)), part.num_rows, registers)
            full = np.diff(first) > 0
            again = np.zeros(part.num_rows, bool)
            again[doc[count > 1]] = True
            number = np.cumsum(again) - 1
            inside = again[doc]
            heavy = prob_min_hash(number[doc[inside]], h[inside], count[inside].astype(np.float64), int(again.sum()), registers)
            who = np.concatenate([np.flatnonzero(full), np.flatnonzero(again)])
            order = np.argsort(who, kind="stable")
            winner = np.concatenate([plain[full], heavy])[order]
            keys = band_keys(winner, bands, per_band).view(np.int64)
            sets = (full.astype(np.int64) + again)[full]
            ends = np.append(0, np.cumsum(sets))
            lists = pa.ListArray.from_arrays(pa.array(ends * bands, pa.int32()), pa.array(keys.reshape(-1)))
            take = pa.array(np.flatnonzero(full))
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), lists], names=["id", "digest", "bands"])

    return map_arrow(rows.select("id", "text", "digest"), run, "id long, digest binary, bands array<long>")


#: Words of 64 bits in a node's bit table.
WORDS = 16


def features(rows: DataFrame, table: np.ndarray, bits: int, n: int = SHINGLE) -> DataFrame:
    """``rows``: id, text.  Of rows whose id the bit table may hold: id, sorted distinct shingles (64 bits each, packed),
    their counts (32 bits each; empty where all are 1), how many there are without and with repeats, and the set's own bit table b0 to b15."""

    def run(batch):
        keep = holds(table, batch.column(2).to_numpy(zero_copy_only=False))
        for part in X.slices(batch.filter(pa.array(keep)), "text"):
            h, first = shingles(part.column(1), n)
            doc, h, count = weighted(h, first)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            marks = np.zeros((part.num_rows, WORDS * 64), np.uint8)
            marks[doc, (h >> np.uint64(54)).astype(np.int64)] = 1
            words = np.packbits(marks, axis=1, bitorder="little").view("<i8")
            packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(h.astype("<u8"))])
            again = np.zeros(part.num_rows, bool)
            again[doc[count > 1]] = True
            ends = np.append(0, np.cumsum(np.where(again, np.diff(first), 0)))
            counts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(count[again[doc]].astype("<u4"))])
            columns = [part.column(0), packed, counts, pa.array(np.diff(first)), pa.array(X.sum_by(count, first)), *(pa.array(words[:, i].copy()) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "s", "c", "n", "total", *(f"b{i}" for i in range(WORDS))])

    schema = "id long, s binary, c binary, n long, total long, " + ", ".join(f"b{i} long" for i in range(WORDS))
    return map_arrow(rows.select("id", "text", slot("id", bits).alias("slot")), run, schema)


def may_be_similar(threshold: float):
    """Exact bound for two rows (x and y) of features: can their sets or their bags reach the threshold.

    Bit tables show that at least p elements of x aren't in y, and q of y not in x.  Sets: p + q elements differ; at a
    similarity of t that is at most (1 - t) / (1 + t) of |x| + |y|.  Bags: with the shares a = p / total(x) and
    b = q / total(y), a common element d adds at most m r / (r + min(a, b)) to the similarity, where m and r m are the
    smaller and the larger of its two shares; all m (1 + r) sum to 2 - a - b at most, and a unit of that is worth most at
    r = 1: so probability similarity is at most (1 - (a + b) / 2) / (1 + min(a, b)).
    """
    p = q = F.lit(0)
    for i in range(WORDS):
        x, y = F.col(f"x.b{i}"), F.col(f"y.b{i}")
        both = x.bitwiseAND(y)
        p, q = p + F.bit_count(x.bitwiseXOR(both)), q + F.bit_count(y.bitwiseXOR(both))
    sets = p + q <= (1 - threshold) / (1 + threshold) * (F.col("x.n") + F.col("y.n")) + 1e-6
    a, b = p / F.col("x.total"), q / F.col("y.total")
    bags = 1 - (a + b) / 2 >= threshold * (1 + F.least(a, b)) - 1e-6
    return sets | ((F.col("x.w") | F.col("y.w")) & bags)


def similar(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, threshold: float) -> bool:
    """By sets or by bags; no counts mean that all are 1."""
    ia, ib = common(x, y)
    both = len(ia)
    if not both:
        return False
    if both / (len(x) + len(y) - both) >= threshold:
        return True
    if not len(wx) and not len(wy):
        return False
    total_x, total_y = (float(w.sum()) if len(w) else float(len(v)) for w, v in ((wx, x), (wy, y)))
    cx, cy = (w[at].astype(np.float64) if len(w) else np.ones(both) for w, at in ((wx, ia), (wy, ib)))
    only_x, only_y = total_x - cx.sum(), total_y - cy.sum()
    # The bound of may_be_similar, from the weights themselves, spares most pairs the sum.
    a, b = only_x / total_x, only_y / total_y
    if 1 - (a + b) / 2 < threshold * (1 + min(a, b)) - 1e-9:
        return False
    return probability_similarity(cx, cy, only_x, only_y) >= threshold - 1e-12


def verified(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough: a, b."""
    side = lambda e: facts.select(F.col("id").alias(e), F.col("s").alias("s" + e), F.col("c").alias("c" + e))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "ca", "sb", "cb")

    def run(batch):
        keep = []
        for row in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
            sa, ca, sb, cb = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, ("<u8", "<u4", "<u8", "<u4"), strict=True))
            keep.append(similar(sa, ca, sb, cb, threshold))
        mask = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return map_arrow(both, run, "a long, b long")


def _mixed(buckets: DataFrame) -> DataFrame:
    """``buckets``: key, node, label, and others.  Those with several labels, with the size of the rest beside the largest label."""
    by_label = buckets.groupBy("key", "label").agg(F.count("*").alias("n"))
    by_key = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"))
    several = by_key.where("labels > 1").select("key", F.col("most.label").alias("major"), (F.col("n") - F.col("most.n")).alias("rest"))
    return buckets.join(several, "key").select(*buckets.columns, "major", "rest")


def _pairs_inside(inside: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a > b) of nodes of different labels in one bucket: nodes outside the largest class with all others."""
    rows = inside.select("key", "node", "label", (F.col("label") == F.col("major")).alias("in_major")).join(bounds, "node")
    x, y = rows.where("not in_major").alias("x"), rows.alias("y")
    once = F.col("y.in_major") | (F.col("x.node") > F.col("y.node"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & may_be_similar(threshold))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _elements(facts: DataFrame) -> DataFrame:
    """node, key (a shingle) and weight of all shingles of ``facts``."""

    def run(batch):
        s, c = (b"".join(v.as_buffer() for v in batch.column(k)) for k in (1, 2))
        n, repeats = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        weight = np.ones(int(n.sum()), np.int64)
        weight[np.repeat(repeats, n)] = np.frombuffer(c, "<u4")
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.frombuffer(s, "<i8")), pa.array(weight)], names=["node", "key", "weight"])

    return map_arrow(facts.select("id", "s", "c", "n", F.length("c") > 0), run, "node long, key long, weight long")


def _prefixes(facts: DataFrame, threshold: float) -> DataFrame:
    """key, node, n, w, left (shingles from this one on), a and b (shares of the set and of the bag before it), short.

    Of two similar texts' first common shingle, in an order common to all: by either measure, neither share is above
    the limit, and one is at most (1 - t) / (1 + t).  Shingles that one text only has come first, and make no rows.
    """
    each = _elements(facts)
    shared = each.join(each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "key")
    own, upto = Window.partitionBy("node"), Window.partitionBy("node").orderBy("often", "key")
    shared = shared.select("node", "key", (F.count("*").over(own) - F.row_number().over(upto) + 1).alias("left"), (F.sum("weight").over(own) - F.sum("weight").over(upto) + F.col("weight")).alias("left_weight"))
    sizes = facts.select(F.col("id").alias("node"), "n", "total", (F.length("c") > 0).alias("w"))
    rows = shared.join(sizes, "node").withColumn("a", 1 - F.col("left") / F.col("n")).withColumn("b", 1 - F.col("left_weight") / F.col("total"))
    near = (1 - threshold) / (1 + threshold) + 1e-6
    rows = rows.where((F.col("a") <= 1 - threshold + 1e-6) | (F.col("b") <= 2 * (1 - threshold) + 1e-6))
    return rows.select("key", "node", "n", "w", "left", "a", "b", ((F.col("a") <= near) | (F.col("b") <= near)).alias("short"))


def _pairs_by_prefix(facts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``labels``: node, label.  Pairs (a > b) of nodes of different labels that may be similar, none left out."""
    rows = _mixed(written(_prefixes(facts, threshold).join(labels, "node"), "prefixes"))
    rows = written(rows.withColumn("in_major", F.col("label") == F.col("major")).drop("major", "rest"), "prefixes")
    # Of a pair one is outside the key's largest class, and one has the key in its short prefix: both, or one each.
    x = rows.where("not in_major").withColumn("far", ~F.col("short")).alias("x")
    y = rows.withColumn("far", F.lit(False)).unionByName(rows.where("in_major and short").withColumn("far", F.lit(True))).alias("y")
    once = F.col("y.in_major") | ~F.col("y.short") | (F.col("x.node") > F.col("y.node"))
    sets = F.least("x.left", "y.left") >= threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - 1e-6
    bags = 1 - (F.col("x.b") + F.col("y.b")) / 2 >= threshold * (1 + F.least("x.b", "y.b")) - 1e-6
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.far") == F.col("y.far"))
    pairs = x.join(y, same & (F.col("x.label") != F.col("y.label")) & once & (sets | ((F.col("x.w") | F.col("y.w")) & bags)))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the class's smallest id) and kept (it is that one)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    there = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    digested = there.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    signed = written(signatures(digested, bands, per_band, n), "signatures")
    there, signed = one_text_per_id(there, signed)
    nodes = written(signed.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    one = signed.join(nodes.select("digest", F.col("node").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["id"])
    one = written(one.select(F.col("id").alias("node"), "bands"), "nodes")
    keyed = one.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key").select("key", "node", "n"), "shared")
    # Centrality, made unique by a hash of the node.
    tie = F.col("node").cast("long").bitwiseXOR(F.shiftright(F.xxhash64("node"), 7)).bitwiseAND(F.lit((1 << 24) - 1).cast("long"))
    central = shared.groupBy("node").agg((F.least(F.sum("n"), F.lit((1 << 38) - 1)) * (1 << 24) + tie).alias("rank"))
    ranked = shared.join(central, "node").select("key", "node", "rank")
    leaders = ranked.groupBy("key").agg(F.max_by("node", "rank").alias("lead"), F.max("rank").alias("lead_rank"))
    stars = ranked.join(leaders, "key").where("node <> lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.max("lead_rank").alias("rank"))
    stars = written(stars, "stars")

    wanted = written(shared.select(F.col("node").alias("id")).distinct(), "wanted")
    table, bits = bit_table(wanted)
    facts = written(features(there, table, bits, n).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "features")

    # 1. Each node with the most central leader of all its buckets.
    first = written(verified(stars.groupBy("a").agg(F.max_by("b", "rank").alias("b")), facts, threshold), "links")
    labels = connected_components(first)
    # 2. Nodes and leaders still apart.
    apart = _apart(stars, labels)
    second = written(verified(apart.select("a", "b"), facts, threshold), "links")
    labels = _joined(labels, second)
    # 3. Buckets that still hold several classes.
    bounds = facts.select(F.col("id").alias("node"), "n", "total", (F.length("c") > 0).alias("w"), *(f"b{i}" for i in range(WORDS)))
    inside = written(_mixed(_with_label(shared.select("key", "node"), labels, "node", "label")), "mixed")
    crowded = written(inside.where(F.col("rest") > MINORITY).select("node", "label").distinct(), "crowded")
    rest = _pairs_inside(inside.where(F.col("rest") <= MINORITY), bounds, threshold)
    if not crowded.isEmpty():
        bags = written(facts.join(crowded.select(F.col("node").alias("id")), "id", "left_semi"), "crowded")
        met = _pairs_by_prefix(bags, crowded, threshold).join(bounds.alias("x"), F.col("a") == F.col("x.node")).join(bounds.alias("y"), F.col("b") == F.col("y.node"))
        rest = rest.union(met.where(may_be_similar(threshold)).select("a", "b")).distinct()
    told = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = rest.join(told, ["a", "b"], "left_anti")
    third = written(verified(rest, facts, threshold), "links")
    labels = _joined(labels, third)

    classes = labels.select("node", F.col("label").alias("class"))
    members = signed.join(nodes, "digest").select("id", "node").join(classes, "node", "left").select("id", F.coalesce("class", "node").alias("class"))
    members = members.groupBy("id").agg(F.min("class").alias("class"))
    out = rows.select("id").join(members, "id", "left").withColumn("class", F.coalesce("class", "id"))
    return out.select(F.col("id").alias(id_col), F.col("class").alias("class_id"), F.coalesce(F.col("id") == F.col("class"), F.lit(True)).alias("kept"))


def _with_label(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_l"))
    return df.join(named, column, "left").withColumn(out, F.coalesce("_l", column)).drop("_l")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _with_label(_with_label(pairs, labels, "a", "la"), labels, "b", "lb").where("la <> lb")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between nodes, some of which may have had none before."""
    if links.isEmpty():
        return labels
    between = _apart(links, labels)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return relabel(labels.union(ends), between.select(F.col("la").alias("a"), F.col("lb").alias("b")))
