"""URL filter: host/path rules first, then gradient-boosted trees on lexical features.

Features: lengths, depth, digit ratios, entropies, parameter counts and suffix statistics (how often
labelled URLs with this host suffix, hashed into a fixed number of buckets, were blocked, and how
many there are, over all labelled URLs).  The trees are fitted on the driver to at most
``sample`` labelled URLs, those with the smallest hashes; features are computed batch-wise in numpy.

Where the labelled URLs are those to be judged, hosts are dealt into folds.  A URL is then judged by the trees
and statistics of the other folds only, and those trees were fitted on statistics without the fold of the row
at hand and without the judged fold: so no label of a host has a part in that host's own scores.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is
judged by the model on empty features; repeated rows are judged alike; without labelled URLs of both
kinds the model allows everything (or blocks, if all labels say so); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .boosting import Trees
from .common import map_arrow

#: The rules, as (verdict, host + path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words in host names that well-known public block lists are full of.  They give the
#: labelled URLs of ``term_labels``.
BLOCK_TERMS = (
    "ad", "ads", "adserver", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "clicks", "coupon", "crack", "deal", "deals", "escort",
    "farm", "free", "gamble", "jackpot", "loan", "loans", "lottery", "malware", "phish", "pills", "poker", "porn", "prize", "promo", "replica",
    "sex", "slots", "spam", "torrent", "track", "tracker", "tracking", "viagra", "warez", "win", "winner", "xxx",
)
BUCKETS = 4096
SAMPLE = 20_000
#: Folds of hosts, where URLs are judged that are labelled themselves.
FOLDS = 5
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "host_entropy",
    "parameters", "longest_label", "suffix_rate", "suffix_count", "site_rate", "site_count",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.col(url_col).cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_column(rules: Sequence[tuple[str, str]] = RULES):
    """The longest rule that fits, as struct(n, rule, verdict), or null.  For lists of up to a few hundred rules."""
    fits = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        ok = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def term_labels(urls: DataFrame, url_col: str = "url", terms: Sequence[str] = BLOCK_TERMS) -> DataFrame:
    """Labelled URLs: block (1) where a word of the host is a block-list term, else allow (0)."""
    parts = with_parts(urls.select(F.col(url_col).cast("string").alias("url")).where(F.col("url").isNotNull())).where(F.col("host") != "")
    words = F.split("host", r"[.\-]")
    return parts.select("url", F.arrays_overlap(words, F.array(*map(F.lit, terms))).cast("int").alias("label"))


def _suffix(n: int):
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -n)), F.lit(BUCKETS)).cast("int")


def _entropy(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    c = np.bincount(doc * 256 + values, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(c.sum(axis=1), 1)
    p = c / total[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def lexical(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """The features that come from the URL alone."""
    n = len(urls)

    def parts(column):
        data, offsets = X.buffers(column)
        return data, offsets, np.repeat(np.arange(n), np.diff(offsets))

    def count(data, offsets, hit):
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(hit, out=c[1:])
        return c[offsets[1:]] - c[offsets[:-1]]

    (u, uo, ud), (h, ho, hd), (p, po, _) = parts(urls), parts(hosts), parts(paths)
    digit = lambda d: (d >= 0x30) & (d <= 0x39)
    ul, hl, pl = np.diff(uo), np.diff(ho), np.diff(po)
    start, end, first = X.spans(h, ho, h != ord("."))
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), np.diff(first)), end - start)
    return np.column_stack([
        ul, hl, pl, count(p, po, p == ord("/")), count(h, ho, h == ord(".")) + (hl > 0), count(u, uo, digit(u)) / np.maximum(ul, 1),
        count(h, ho, digit(h)) / np.maximum(hl, 1), count(h, ho, h == ord("-")), _entropy(u, ud, n), _entropy(h, hd, n),
        count(u, uo, (u == ord("?")) | (u == ord("&")) | (u == ord("="))), longest,
    ]).astype(np.float64)


def _fold(folds: int):
    return F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(folds)).cast("int")


class UrlModel:
    """Trees by fold, and the labels' sums and counts by kind of suffix, fold and bucket."""

    def __init__(self, sums: dict[str, np.ndarray], counts: dict[str, np.ndarray]) -> None:
        self.sums, self.counts = sums, counts
        self.folds = len(sums["suffix"])
        self.priors = [self._share(k) for k in range(self.folds)]
        self.trees: list[Trees | None] = [None] * self.folds

    def _without(self, kind: str, folds: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts by bucket over the other folds (over all, where there is but one)."""
        used = [f for f in range(self.folds) if self.folds == 1 or f not in folds]
        return self.sums[kind][used].sum(axis=0), self.counts[kind][used].sum(axis=0)

    def _share(self, fold: int) -> float:
        blocked, n = (x.sum() for x in self._without("suffix", {fold}))
        return float(blocked / n) if n else 0.0

    def features(self, urls, hosts, paths, suffix: np.ndarray, site: np.ndarray, fold: np.ndarray, judged: int | None = None) -> np.ndarray:
        """Features of rows, by statistics without each row's own fold and without the fold ``judged``."""
        extra = np.zeros((len(suffix), 4))
        for f in np.unique(fold).tolist():
            at = np.flatnonzero(fold == f)
            prior = self.priors[f if judged is None else judged]
            for place, kind, bucket in ((0, "suffix", suffix[at]), (2, "site", site[at])):
                blocked, n = self._without(kind, {f} if judged is None else {f, judged})
                extra[at, place] = (blocked[bucket] + prior) / (n[bucket] + 1)
                extra[at, place + 1] = np.log1p(n[bucket])
        return np.column_stack([lexical(urls, hosts, paths), extra])

    def score(self, *columns) -> np.ndarray:
        """Columns as in ``features``; each row by the trees of its fold."""
        x, fold = self.features(*columns), columns[-1]
        out = np.zeros(len(fold))
        for f in np.unique(fold).tolist():
            at = np.flatnonzero(fold == f)
            out[at] = self.priors[f] if self.trees[f] is None else self.trees[f].probability(x[at])
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE, rounds: int = 40, depth: int = 4, folds: int = 1) -> UrlModel:
    """``labelled``: url, label (1: block).  Suffix statistics cover every row; the trees see ``sample`` rows at most.

    ``folds``: 1 where other URLs are judged than the labelled ones, ``FOLDS`` where the same are.
    """
    rows = with_parts(labelled).select(
        "url", "host", "path", F.col("label").cast("double").alias("label"), _suffix(1).alias("suffix"), _suffix(2).alias("site"), _fold(folds).alias("fold")
    )
    sums, counts = ({k: np.zeros((folds, BUCKETS)) for k in ("suffix", "site")} for _ in range(2))
    kinds = F.explode(F.array(F.struct(F.lit("suffix").alias("kind"), F.col("suffix").alias("b")), F.struct(F.lit("site").alias("kind"), F.col("site").alias("b"))))
    by_bucket = rows.select("label", "fold", kinds.alias("x")).groupBy("x.kind", "fold", "x.b").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    for r in by_bucket.collect():  # at most 2 * folds * BUCKETS rows
        sums[r["kind"]][r["fold"], r["b"]], counts[r["kind"]][r["fold"], r["b"]] = r["s"], r["n"]
    model = UrlModel(sums, counts)
    if not 0 < sums["suffix"].sum() < counts["suffix"].sum():
        return model
    got = rows.orderBy(F.xxhash64("url"), "url").limit(sample).toArrow()
    columns = [got.column(c).combine_chunks() for c in ("url", "host", "path")] + [got.column(c).to_numpy() for c in ("suffix", "site", "fold")]
    y, fold = got.column("label").to_numpy(), columns[-1]
    for k in range(folds):
        others = np.flatnonzero((fold != k) | (folds == 1))
        if len(others) and 0 < y[others].mean() < 1:
            x = model.features(*(c.take(pa.array(others)) if isinstance(c, pa.Array) else c[others] for c in columns), judged=k)
            model.trees[k] = Trees.fit(x, y[others], rounds=rounds, depth=depth)
    return model


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per URL: id, host, path, rule, verdict and the model's score."""
    rows = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")))
    rows = rows.select("id", "url", "host", "path", _suffix(1).alias("suffix"), _suffix(2).alias("site"), _fold(model.folds).alias("fold"), rule_column(rules).alias("fit"))
    rows = rows.select("id", "url", "host", "path", "suffix", "site", "fold", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("said"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, said string, score double"

    def run(batch):
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        score = model.score(*(col[c] for c in ("url", "host", "path")), *(col[c].to_numpy(zero_copy_only=False) for c in ("suffix", "site", "fold")))
        return pa.RecordBatch.from_arrays([*(col[c] for c in ("id", "host", "path", "rule", "said")), pa.array(score)], names=["id", "host", "path", "rule", "said", "score"])

    out = map_arrow(rows, run, schema)
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
