"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of whole texts are taken batch-wise in numpy and stored once.  Normal equations of the
Fourier features are summed by partition, then by row of the matrix, so what reaches the driver is one
matrix whose size depends on ``width`` alone; calibration works on a histogram of fixed size.  All
labelled rows count.

Defined cases: null texts are empty; a document with several label rows counts once for each; labels
other than 0 and 1 and labels of unknown documents are ignored; without any labels every score is
0.5, with labels of one kind only it is that label; null ids are scored, never held out; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .common import bounded_batches, discard, map_arrow, returned, written

STATISTICS = (
    "log_words", "log_chars", "mean_word", "sd_word", "long_words", "upper", "digits", "symbols", "pipes", "bangs", "stops", "commas", "other_marks",
    "not_ascii", "words_a_line", "dup_lines", "dup_words", "repeat_3", "upper_words", "mixed_words", "entropy", "word_end_marks",
)
WIDTH = 256
BINS = 2000
LOW, HIGH = -1.0, 2.0


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SYMBOL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#*$%&<>@^~=_+\\/{}[]")
_PIPE, _BANG, _STOP, _COMMA, _MARK = _class("|"), _class("!"), _class(".?"), _class(","), _class(":;'\"()-`")
_END = _class(".,!?;:")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = X.buffers(texts)
    n = len(offsets) - 1
    w = X.words(data, offsets)
    doc = w.doc

    def total(hit):
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(hit, out=c[1:])
        return c

    by_doc = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    points = total(X.code_points(data))
    chars = np.maximum(by_doc(points), 1)
    n_words = np.maximum(w.counts, 1)
    length = points[w.end] - points[w.start]
    mean = X.sum_by(length, w.first) / n_words
    square = X.sum_by(length * length, w.first) / n_words
    # Upper-case letters of Latin-1 follow the byte C3.
    upper = _UPPER[data]
    if len(data):
        upper = upper.copy()
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    ups = total(upper)
    word_ups = ups[w.end] - ups[w.start]
    start, end, first = X.spans(data, offsets, data != 0x0A)
    inner = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    full = inner > 0
    line_doc = np.repeat(np.arange(n), np.diff(first))
    _, later = X.repeated(X.seeded(X.span_hash(data, start[full], end[full]), line_doc[full]))
    dup = np.zeros(len(start), dtype=np.int64)
    dup[np.flatnonzero(full)[later]] = inner[full][later]
    lines = np.maximum(X.sum_by(full, first), 1)
    _, later_word = X.repeated(X.seeded(w.hash, doc))
    h, at = X.ngrams(w, 3)
    again = np.zeros(len(doc), dtype=bool)
    again[at[X.repeats(X.seeded(h, doc[at]))]] = True
    marked = _END[data[w.end - 1]] if len(doc) else np.zeros(0, bool)
    p = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 64 + (data & 63), minlength=n * 64).reshape(n, 64) / np.maximum(np.diff(offsets), 1)[:, None]
    share = lambda table: by_doc(total(table[data])) / chars
    per_word = lambda hit: X.sum_by(hit, w.first) / n_words
    return np.column_stack([
        np.log1p(w.counts), np.log1p(by_doc(points)), mean, np.sqrt(np.maximum(square - mean * mean, 0)), per_word(length > 15),
        by_doc(ups) / chars, share(_DIGIT), share(_SYMBOL), share(_PIPE), share(_BANG), share(_STOP), share(_COMMA), share(_MARK),
        by_doc(total((data >= 0xC0))) / chars, np.log1p(n_words / lines), X.sum_by(dup, first) / n_words, per_word(later_word), per_word(again),
        per_word((word_ups > 1) & (2 * word_ups >= length)), per_word((word_ups > 0) & (word_ups < length) & ~upper[w.start] if len(doc) else np.zeros(0, bool)),
        -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1), per_word(marked),
    ]).astype(np.float64)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and its statistics as one array."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    width = len(STATISTICS)

    def run(batch):
        for part in X.slices(batch, "text"):
            x = statistics(part.column(1)).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["id", "x"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@dataclass
class QualityModel:
    """Everything a score needs."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        width = self.directions.shape[1]
        return np.column_stack([np.ones(len(x)), z, np.sqrt(2 / width) * np.cos(z @ self.directions + self.phases)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.weights, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.values[0])
        return np.interp(self.raw(x), self.edges, self.values)


def _sum_vectors(df: DataFrame, fan: int = 64) -> DataFrame:
    """Adds the vectors ``v`` of each row number ``i`` in two steps."""

    def add(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v").combine_chunks()).sum(axis=0)
        return pa.table({"i": table.column("i")[:1], "part": pa.array([0], pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "i int, part int, v array<double>"
    return df.groupBy("i", "part").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)


def fit(train: DataFrame, width: int = WIDTH, ridge: float = 1.0, bandwidth: float = 0.12, seed: int = 7) -> QualityModel:
    """``train``: a stored table of x (statistics) and y (0 or 1)."""
    d = len(STATISTICS)
    aggregates = [F.count("*"), F.sum("y"), *(F.avg(F.col("x")[j]) for j in range(d)), *(F.stddev_pop(F.col("x")[j]) for j in range(d))]
    got = train.agg(*aggregates).first()
    n, positive = int(got[0]), float(got[1] or 0)
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(d, width)) * bandwidth, rng.uniform(0, 2 * np.pi, width)
    if not 0 < positive < n:
        constant = positive / n if n else 0.5
        return QualityModel(np.zeros(d), np.ones(d), directions, phases, None, np.array([0.0]), np.array([constant]))
    mean, scale = np.array(got[2 : 2 + d], dtype=float), np.array(got[2 + d :], dtype=float)
    scale[scale < 1e-6] = 1.0
    model = QualityModel(mean, scale, directions, phases, None, np.array([0.0]), np.array([0.0]))
    size = 1 + d + width

    def equations(batches):
        a, part = np.zeros((size, size + 1)), None
        for batch in batches:
            z, y = model.expand(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            a[:, :size] += z.T @ z
            a[:, size] += z.T @ y
            part = True
        if part:
            from pyspark import TaskContext

            where = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, where), pa.int32()), pa.array(a.tolist(), pa.list_(pa.float64()))], names=["i", "part", "v"])

    rows = _sum_vectors(train.select("x", "y").mapInArrow(equations, "i int, part int, v array<double>")).collect()  # `size` rows
    a = np.zeros((size, size + 1))
    for r in rows:
        a[r["i"]] = r["v"]
    penalty = np.full(size, ridge)
    penalty[0] = 1e-6
    model.weights = np.linalg.solve(a[:, :size] + np.diag(penalty), a[:, size])

    def histogram(batches):
        c, s = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            b = np.minimum(((model.raw(_matrix(batch.column(0))) - LOW) / (HIGH - LOW) * BINS).astype(np.int64), BINS - 1)
            c += np.bincount(b, minlength=BINS)
            s += np.bincount(b, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), BINS)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c[at]), pa.array(s[at])], names=["b", "n", "s"])

    hist = train.select("x", "y").mapInArrow(histogram, "b int, n double, s double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # at most BINS rows
    model.edges, model.values = isotonic([(r["b"], r["n"], r["s"]) for r in hist])
    return model


def isotonic(hist: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (bin, count, positives): points of a rising curve."""
    blocks: list[list[float]] = []  # first bin, last bin, count, positives
    for b, n, s in sorted(hist):
        blocks.append([b, b, n, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    centre = lambda b: LOW + (b + 0.5) * (HIGH - LOW) / BINS
    x, y = [], []
    for first, last, n, s in blocks:
        x += [centre(first), centre(last) + 1e-9]
        y += [s / n, s / n]
    return np.array(x), np.array(y)


def held_out(id_col: str):
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, options: dict) -> tuple[DataFrame, QualityModel]:
    facts = written(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & ~held_out("id"))
    train = written(facts.join(known, "id").select("x", "y"), "train")
    model = fit(train, **options)
    discard(train)
    return facts, model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """Fit on the labelled rows that aren't held out, score all: id, held_out, score, predicted."""
    facts, model = _fitted(docs, labels, id_col, text_col, label_col, options)

    def run(batch):
        s = model.score(_matrix(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["id", "score"])

    out = map_arrow(facts, run, f"id {facts.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, judged where they are read: no text is shuffled, and only
    the texts go through Python."""
    facts, model = _fitted(docs, labels, id_col, text_col, label_col, options)
    discard(facts)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [model.score(statistics(part.column(0)).astype(np.float32).astype(np.float64)) >= threshold for part in X.slices(rows, "text")]
        returned()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(accepted(F.col(text_col).cast("string")))
