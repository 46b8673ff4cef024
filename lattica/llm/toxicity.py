"""Toxicity by maximum-scoring segments of token log-odds.

Fitting, on a bounded sample of labelled rows (``fit_rows``): document counts
of words and of their prefixes in toxic and other texts give log-odds
under an informative Dirichlet prior (the pooled shares); a token takes the
most specific feature that ``LEAST`` texts of the sample hold, so unseen
inflections and compounds fall back on their prefix.  Features whose log-odds
are not significant score nothing, and every token pays ``DRIFT``, so scores
drift down outside toxic passages.

Scoring, of every whole text: one linear scan finds all maximal scoring
segments (Ruzzo and Tompa).  The scale of segment scores by chance comes from
the extreme-value theory of such segments (lambda from the token score
distribution of non-toxic texts, K from a quantile of their best segments
that lies above the texts without any); the best
segment's calibrated score, the sum over significant segments and their number
pass through a logistic function fitted on the sample's other part.

Defined results: null and empty texts have no segments and get the score of
that; repeated rows are scored one by one; rows without an id are scored and
never learned from; an empty table gives no rows; extra columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import LEAD, TextBlock, chunks

#: Labelled rows used in fitting (in expectation), texts a feature needs, its least z score, cost of a token.
FIT_ROWS, LEAST, Z, DRIFT = 20_000, 8, 3.0, 0.25
#: Bytes (up to the beginning of a character) of the prefixes that stand in for rarer words.
PREFIXES = (8, 7, 6, 5)
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]*#$%&|"]] = True


def tokens(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Text of each token, and per token a row of feature hashes, most specific first (0: none)."""
    low = block.lowered()
    start, end, first = low.words()
    doc = np.repeat(np.arange(low.n), np.diff(first))
    if len(end):  # without the signs that end it, but for the first byte
        last = np.maximum.accumulate(np.where(_PUNCT[low.data], -1, np.arange(len(low.data))))
        end = np.maximum(last[end - 1], start) + 1
    h = [low.hash_ranges(start, end)]
    lead = np.append(LEAD[low.data], True)
    for n in PREFIXES:
        to = np.minimum(start + n, end)
        for _ in range(3):
            to = to - (~lead[to] & (to > start))
        h.append(np.where((end > to) & (to > start), low.hash_ranges(start, to) ^ np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0)))
    return doc, np.stack(h, 1)


class Model:
    """Log-odds by feature hash."""

    def __init__(self, features: np.ndarray, odds: np.ndarray, scale: tuple[float, float] = (1.0, 0.0), weights=None):
        order = np.argsort(features)
        self.features, self.odds, self.scale, self.weights = features[order], odds[order], scale, weights

    def token_scores(self, h: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(h)), np.ones(len(h), bool)
        if len(self.features):
            for c in range(h.shape[1]):
                at = np.minimum(np.searchsorted(self.features, h[:, c]), len(self.features) - 1)
                hit = open_ & (self.features[at] == h[:, c])
                out[hit] = self.odds[at[hit]]
                open_ &= ~hit
        return out - DRIFT

    def best(self, block: TextBlock) -> np.ndarray:
        """Per text: lambda times its best segment's score, less the logarithm of its tokens; minus infinity without one."""
        doc, h = tokens(block)
        s = self.token_scores(h)
        n = np.bincount(doc, minlength=block.n)
        total = np.concatenate([[0.0], np.cumsum(s)])
        up = np.flatnonzero(s > 0)
        where = np.searchsorted(doc[up], np.arange(block.n + 1))
        out = np.full(block.n, -np.inf)
        for i in np.flatnonzero(np.diff(where)):
            out[i] = self.scale[0] * max(v for v, _, _ in segments(total, up[where[i] : where[i + 1]])) - np.log(n[i])
        return out

    def stats(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """Per text: best calibrated segment, sum over significant ones, their number; and tokens."""
        doc, h = tokens(block)
        s = self.token_scores(h)
        n = np.bincount(doc, minlength=block.n)
        out = np.zeros((block.n, 3))
        total = np.concatenate([[0.0], np.cumsum(s)])
        up = np.flatnonzero(s > 0)
        lam, log_k = self.scale
        where = np.searchsorted(doc[up], np.arange(block.n + 1))
        for i in np.flatnonzero(np.diff(where)):
            mine = up[where[i] : where[i + 1]]
            gain = [lam * v - log_k - np.log(n[i]) for v, _, _ in segments(total, mine)]
            sure = [g for g in gain if g > 0]
            out[i] = max(max(gain), 0), sum(sure), len(sure)
        return out, n

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(stats) @ self.weights, -30, 30)))


def segments(total: np.ndarray, positive: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) from prefix sums and the positions of positive scores, in linear time."""
    stack: list[list] = []  # left prefix sum, right prefix sum, first, last, nearest earlier entry with a smaller left sum
    for p in positive:
        entry = [total[p], total[p + 1], p, p, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= entry[0]:
                j = stack[j][4]
            entry[4] = j
            if j < 0 or stack[j][1] >= entry[1]:
                stack.append(entry)
                break
            entry[0], entry[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(e[1] - e[0], int(e[2]), int(e[3])) for e in stack]


def _design(stats: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(stats)), np.log1p(stats[:, 0]), np.log1p(stats[:, 1]), np.log1p(stats[:, 2])], 1)


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float, prior: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and z score of document counts under a Dirichlet prior of ``prior`` texts at the pooled share."""
    share = (toxic + other) / max(n_toxic + n_other, 1)
    a = np.maximum(prior * share, 1e-3)
    t, o = toxic + a, other + a
    d = np.log(t / np.maximum(n_toxic + prior - t, 1e-9)) - np.log(o / np.maximum(n_other + prior - o, 1e-9))
    return d, d / np.sqrt(1 / t + 1 / o)


def solve_lambda(values: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda v) = 1 (mean v below 0, some v above)."""
    if not (values > 0).any() or (values * p).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: (p * np.exp(np.clip(x * values, -700, 700))).sum() - 1
    while f(hi) < 0 and hi < 100:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def log_k_of(best: np.ndarray) -> float:
    """log K from the best segments of texts by chance, P(best <= x) = exp(-K exp(-x)): read off the middle of those that have one."""
    have = np.sort(best[np.isfinite(best)])
    if not len(have):
        return 0.0
    none = 1 - len(have) / len(best)
    at = len(have) // 2
    q = none + (1 - none) * (at + 0.5) / len(have)
    return float(have[at] + np.log(-np.log(q)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled rows given (hold-outs are the caller's to take away)."""
    lab = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = lab.count()
    h = F.xxhash64("doc_id")
    chosen = lab.filter(F.pmod(h, F.lit(max(n, 1))) < fit_rows).withColumn("part", F.pmod(F.shiftright(h, 40), F.lit(4)) == 0)
    d = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = docs.select(F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id").count()
    if rows > 2 * fit_rows:  # ids that very many rows share
        d = d.filter(F.rand(3) < fit_rows / rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            block = TextBlock.from_arrow(part.column(1))
            toxic = part.column(2).to_numpy() > 0
            doc, f = tokens(block)
            pairs = np.unique(np.stack([f.T.ravel(), np.tile(doc, f.shape[1]).astype(np.uint64)], 1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
            pairs = pairs[pairs[:, 0] != 0]
            bad = toxic[pairs[:, 1].astype(np.int64)]
            key, inverse = np.unique(pairs[:, 0], return_inverse=True)
            t = np.bincount(inverse, weights=bad, minlength=len(key)).astype(np.int64)
            o = np.bincount(inverse, minlength=len(key)) - t
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[key.view(np.int64), 0]), pa.array(np.r_[t, toxic.sum()]), pa.array(np.r_[o, (~toxic).sum()])], ["f", "t", "o"])

    counts = d.filter("not part").select("doc_id", "text", "toxic").mapInArrow(count, "f long, t long, o long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counts = counts.filter((F.col("f") == 0) | (F.col("t") + F.col("o") >= LEAST))
    kept = counts.toPandas()  # bounded by the sample
    head = kept[kept.f == 0]
    n_toxic, n_other = (float(head.t.sum()), float(head.o.sum())) if len(head) else (0.0, 0.0)
    kept = kept[kept.f != 0]
    odds, z = log_odds(kept.t.to_numpy(float), kept.o.to_numpy(float), n_toxic, n_other)
    model = Model(kept.f.to_numpy(np.int64).view(np.uint64), np.where(np.abs(z) >= Z, odds, 0.0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            block = TextBlock.from_arrow(part.column(1))
            if model.weights is None and model.scale == (1.0, 0.0):
                doc, f = tokens(block)
                s = np.round(model.token_scores(f[(part.column(2).to_numpy() == 0)[doc]]), 2)
                v, c = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c.astype(float)), pa.array(np.zeros(len(v))), pa.array(np.zeros(len(v), np.int64))], ["a", "b", "c", "toxic"])

    spread = d.filter("part").select("doc_id", "text", "toxic").mapInArrow(look, "a double, b double, c double, toxic long").groupBy("a").agg(F.sum("b").alias("b")).toPandas()
    lam = solve_lambda(spread.a.to_numpy(), spread.b.to_numpy() / max(spread.b.sum(), 1))
    model.scale = (lam, 0.0)

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s, n = model.stats(TextBlock.from_arrow(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in s.T] + [part.column(2).cast(pa.int64()), pa.array(n.astype(np.int64))], ["a", "b", "c", "toxic", "n"])

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            part = part.filter(pc.equal(part.column(2), 0))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.best(TextBlock.from_arrow(part.column(1))))], ["best"])

    sample = d.filter("part").select("doc_id", "text", "toxic")
    model.scale = (lam, log_k_of(sample.mapInArrow(chance, "best double").toPandas().best.to_numpy()))
    stats = sample.mapInArrow(stat, "a double, b double, c double, toxic long, n long").toPandas()
    x = _design(stats[["a", "b", "c"]].to_numpy())
    model.weights = fit_logistic(x, stats.toxic.to_numpy(float)) if len(stats) else np.array([-2.0, 1.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: ``doc_id, score, predicted, n_segments``.  No shuffle; the model (features of the bounded sample) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in chunks(batches):
            stats, _ = m.stats(TextBlock.from_arrow(part.column(1)))
            s = m.score(stats)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(stats[:, 2].astype(np.int64))], ["doc_id", "score", "predicted", "n_segments"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_segments long")
