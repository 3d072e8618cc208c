"""Quality rules by repetition coverage.

Rolling (prefix) hashes of words, lines and n-word windows are compared inside each document, in
numpy over whole Arrow batches; a window of n+k words can repeat only where its n-word prefix
does, so each longer length looks at the survivors of the shorter one.  No shuffle.

Defined cases: a null text is an empty one (all counts 0, ``base_failed`` true); rows are judged
one by one, so repeated rows, ties, null ids and extra columns change nothing; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .common import map_arrow

#: Share of a document's word characters allowed inside repeated n-word windows, by n.
NGRAM_LIMITS = {5: 0.30, 7: 0.26, 10: 0.20}
#: Share of a document's word characters allowed inside lines that repeat an earlier one.
LINE_LIMIT = 0.30
BASE_NGRAM = 3
MIN_WORDS = 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in one of the n-word windows beginning at ``at``."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + n, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts by document; ``dup_chars_<n>`` are code points of words inside repeated n-word windows."""
    data, offsets = X.buffers(texts)
    w = X.words(data, offsets)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(X.code_points(data), out=points[1:])
    chars = points[w.end] - points[w.start]
    doc = w.doc
    out = {"n_words": w.counts.astype(np.int64), "word_chars": X.sum_by(chars, w.first)}
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SYMBOLS[data], out=symbols[1:])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    start, end, first = X.spans(data, offsets, data != 0x0A)
    inner = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    line_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    full = inner > 0
    _, later = X.repeated(X.seeded(X.span_hash(data, start[full], end[full]), line_doc[full]))
    dup = np.zeros(len(start), dtype=bool)
    dup[np.flatnonzero(full)[later]] = True
    out["n_dup_lines"] = X.sum_by(dup, first)
    word_total = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=word_total[1:])
    line_chars = word_total[np.searchsorted(w.start, end)] - word_total[np.searchsorted(w.start, start)]
    out["dup_line_chars"] = X.sum_by(np.where(dup, line_chars, 0), first)

    h, at = X.ngrams(w, BASE_NGRAM)
    at = at[X.repeats(X.seeded(h, doc[at]))]
    out["n_repeat_words"] = X.sum_by(_covered(len(chars), at, BASE_NGRAM), w.first)
    for n in sorted(lengths):
        h, every = X.ngrams(w, n)
        keep = np.isin(every, at, assume_unique=True)
        every, h = every[keep], h[keep]
        at = every[X.repeats(X.seeded(h, doc[every]))]
        out[f"dup_chars_{n}"] = X.sum_by(np.where(_covered(len(chars), at, n), chars, 0), w.first)
    return out


def repetition_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram_limits: Mapping[int, float] = NGRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document: its id, the counts of ``measure``, the verdict and the rules it broke."""
    lengths = tuple(sorted(ngram_limits))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, " + ", ".join(f"{c} long" for c in counts)

    def run(batch):
        for part in X.slices(batch, "text"):
            got = measure(part.column(1), lengths)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c], pa.int64()) for c in counts)], names=["id", *counts])

    out = map_arrow(rows, run, schema)
    share = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    broken = [F.when(share(f"dup_chars_{n}") > limit, F.lit(f"ngram_{n}")) for n, limit in sorted(ngram_limits.items())]
    broken += [F.when(share("dup_line_chars") > line_limit, F.lit("lines"))]
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("broken_rules", F.filter(F.array(*broken), lambda x: x.isNotNull()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).withColumnRenamed("id", id_col)
