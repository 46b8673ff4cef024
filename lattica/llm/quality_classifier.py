"""Quality classifier from weak labels.

Twelve overlapping heuristics vote bad, nothing or good on every document; a
defect is seen by several of them (odd characters, shouting, repetition, word
shapes).  The counts of the vote patterns (at most 3**12, whatever the corpus)
are gathered over all documents, and expectation-maximisation on them estimates
how each heuristic votes on good documents and on each of three kinds of bad
ones, among which the votes of overlapping heuristics agree; a few pseudo-counts
are all that is assumed beforehand.  Posterior labels of a bounded sample
(``fit_rows`` documents and ``FIT_VALUES`` feature values, in expectation) train
a linear scorer over hashed word shapes and measurements, which then scores
every whole text.

Defined results: null and empty texts score 0 and are rejected; repeated rows
are scored one by one, rows without an id like others; an empty table gives no rows; extra columns of the input
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import measure
from .textblock import TextBlock, chunks, first_in_group, mix

#: Bounds of the sample that the scorer is fitted on (in expectation): rows, and nonzero feature values.
FIT_ROWS, FIT_VALUES = 20_000, 8_000_000
#: Features, and those of them for measurements.
FEATURES, MEASURED = 1 << 14, 160
#: Heuristics, and the groups that see the same defects.
HEURISTICS = ("symbols", "bare", "odd", "case", "exclaimed", "repeats", "lines", "adjacent", "variety", "short_words", "word_length", "length")
GROUPS = (("symbols", "bare", "odd", "short_words", "word_length"), ("case", "exclaimed"), ("repeats", "lines", "adjacent", "variety"))
_ODD = np.zeros(256, bool)
_ODD[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LETTERS = np.zeros(256, np.int64)
_LETTERS[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[0x80:] = ord("a")


def ratios(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per text: what the heuristics look at."""
    n = np.maximum(m["n_words"], 1)
    return {
        "symbols": m["n_symbols"] / n,
        "bare": m["n_bare"] / n,
        "odd": m["n_odd"] / np.maximum(m["word_chars"], 1),
        "case": m["n_upper"] / np.maximum(m["n_letters"], 1),
        "exclaimed": m["n_bangs"] / n,
        "repeats": m["n_repeat_words"] / n,
        "lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        "adjacent": m["n_adjacent"] / n,
        "variety": m["n_distinct"] / np.sqrt(n),
        "short_words": m["n_short"] / n,
        "word_length": m["word_chars"] / n,
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Per text and heuristic: 0 bad, 1 none, 2 good."""
    r, enough = ratios(m), m["n_words"] >= 20
    bad = {
        "symbols": r["symbols"] > 0.25,
        "bare": (r["bare"] > 0.15) & enough,
        "odd": r["odd"] > 0.15,
        "case": (r["case"] > 0.6) & (m["n_letters"] >= 20),
        "exclaimed": r["exclaimed"] > 0.6,
        "repeats": r["repeats"] > 0.2,
        "lines": r["lines"] > 0.3,
        "adjacent": (r["adjacent"] > 0.2) & enough,
        "variety": (r["variety"] < 2) & enough,
        "short_words": (r["short_words"] < 0.12) & enough,
        "word_length": ((r["word_length"] > 6.5) | (r["word_length"] < 2.5)) & enough,
        "length": m["n_words"] == 0,
    }
    good = {
        "symbols": r["symbols"] < 0.02,
        "bare": r["bare"] < 0.02,
        "odd": r["odd"] < 0.06,
        "case": r["case"] < 0.15,
        "exclaimed": r["exclaimed"] < 0.05,
        "repeats": r["repeats"] < 0.02,
        "lines": r["lines"] < 0.05,
        "adjacent": r["adjacent"] < 0.03,
        "variety": r["variety"] > 4,
        "short_words": (r["short_words"] > 0.25) & (r["short_words"] < 0.7),
        "word_length": (r["word_length"] > 3.5) & (r["word_length"] < 5.8),
        "length": m["n_words"] >= 100,
    }
    return np.stack([np.where(bad[h], 0, np.where(good[h] & enough, 2, 1)) for h in HEURISTICS], 1)


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpattern(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(len(HEURISTICS))], 1)


#: Pseudo-counts: of each vote in each class, and of each class.
PSEUDO = 1.0


def _cast(v: np.ndarray) -> np.ndarray:
    """Indicators of the votes bad and good."""
    return (v[:, :, None] == np.array([0, 2])).astype(float)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Class shares (good, then the kinds of bad) and, per class and heuristic, how its votes there divide into bad and good.

    Abstaining says nothing.  To begin with, a text belongs to the kind of the group that casts most bad votes, if there
    are two or more; others are good.
    """
    v = unpattern(patterns)
    cast = _cast(v)
    fired = np.stack([(v[:, [HEURISTICS.index(h) for h in g]] == 0).sum(axis=1) for g in GROUPS], 1)
    r = np.full((len(v), 1 + len(GROUPS)), 0.02)
    r[np.arange(len(v)), np.where(fired.max(axis=1) > 1, 1 + fired.argmax(axis=1), 0)] = 1
    r /= r.sum(axis=1, keepdims=True)
    share = p = None
    for _ in range(rounds):
        w = r * counts[:, None]
        share = (w.sum(axis=0) + PSEUDO) / (w.sum() + PSEUDO * r.shape[1])
        p = np.stack([(w[:, c, None, None] * cast).sum(axis=0) for c in range(r.shape[1])]) + PSEUDO
        p /= p.sum(axis=2, keepdims=True)
        new = _responsibilities(v, share, p)
        if np.abs(new - r).max(initial=0) < 1e-9:
            break
        r = new
    return share, p


def _responsibilities(v: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    log_p = np.zeros((len(p), p.shape[1], 3))  # abstaining: 0
    log_p[:, :, [0, 2]] = np.log(p)
    ll = np.log(share) + sum(log_p[:, k, v[:, k]].T for k in range(v.shape[1]))
    ll -= ll.max(axis=1, keepdims=True)
    e = np.exp(ll)
    return e / e.sum(axis=1, keepdims=True)


def posterior(v: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of good, per row of votes."""
    return _responsibilities(v, share, p)[:, 0]


def _features(block: TextBlock, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value of every nonzero: shares of word shapes, and measurements."""
    start, end, first = block.words()
    n_words = np.diff(first)
    kind = _CLASS[block.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    at = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    shapes = TextBlock(kind[keep], np.array([0, int(at[-1])]))
    h = shapes.hash_ranges(at[start], at[end])
    doc = np.repeat(np.arange(block.n), n_words)
    f = (h % np.uint64(FEATURES - MEASURED)).astype(np.int64)
    key, count = np.unique(doc * FEATURES + f, return_counts=True)
    doc, f = key // FEATURES, key % FEATURES
    value = count / n_words[doc]
    r = ratios(m)
    r["short_words"], r["word_length"], r["variety"] = 1 - r["short_words"], r["word_length"] / 10, r["variety"] / 20
    own = np.clip(np.stack(list(r.values()), 1), 0, 0.999)
    k = own.shape[1]
    bins = np.minimum((own * 10).astype(np.int64), 9) + (own > 0.02)  # 0: hardly any; then tenths
    extra = np.repeat(np.arange(block.n), k)
    base = FEATURES - MEASURED
    doc = np.concatenate([doc, extra, extra, np.arange(block.n)])
    f = np.concatenate([f, np.tile(base + np.arange(k), block.n), (base + k + np.arange(k) * 11 + bins).ravel(), np.full(block.n, FEATURES - 1)])
    return doc, f, np.concatenate([value, own.ravel(), np.ones(block.n * k), np.ones(block.n)])


def _view(part: pa.RecordBatch) -> tuple[TextBlock, dict[str, np.ndarray]]:
    block = TextBlock.from_arrow(part.column(part.schema.get_field_index("text")))
    m = measure(block)
    start, end, first = block.words()
    doc = np.repeat(np.arange(block.n), np.diff(first))
    letters = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_LETTERS[block.data], out=letters[1:])
    h = block.word_hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order, new = first_in_group(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    m["n_short"] = np.bincount(doc[end - start <= 3], minlength=block.n)
    m["n_bare"] = np.bincount(doc[letters[end] == letters[start]], minlength=block.n)
    m["n_odd"] = block.sums(_ODD[block.data])
    m["n_adjacent"] = np.bincount(doc[same], minlength=block.n)
    m["n_distinct"] = np.bincount(doc[order[new]], minlength=block.n)
    return block, m


def fit_linear(doc: np.ndarray, f: np.ndarray, value: np.ndarray, label: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights for soft labels by full-batch gradient steps with per-weight rates."""
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    n = max(1, len(label))
    for _ in range(rounds):
        z = np.bincount(doc, weights=w[f] * value, minlength=len(label))
        g = np.bincount(f, weights=value * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)[doc], minlength=FEATURES) / n + decay * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class shares, vote rates and the scorer's weights."""
    d = docs.select("text")

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            block, m = _view(part)
            code, which, n = np.unique(_pattern(votes(m)), return_inverse=True, return_counts=True)
            values = np.bincount(which, weights=np.minimum(m["n_distinct"], FEATURES) + MEASURED)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (code, n, values)], ["code", "n", "size"])

    seen = d.mapInArrow(patterns, "code long, n long, size long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).orderBy("code").collect()
    code, n = np.array([r.code for r in seen], np.int64), np.array([r.n for r in seen], float)
    share, p = expectation_maximisation(code, n)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            block, m = _view(part)
            y = posterior(votes(m), share, p)
            doc, f, value = _features(block, m)
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()]), pa.array([doc.astype("<i4").tobytes()]), pa.array([f.astype("<i4").tobytes()]), pa.array([value.astype("<f4").tobytes()])], ["y", "doc", "f", "value"])

    # every row alike, whatever its id and text
    rate = min(1.0, fit_rows / max(1.0, n.sum()), FIT_VALUES / max(1, sum(r.size for r in seen)))
    chosen = d.filter(F.rand(5) < rate)
    ys, ds, fs, vs, at = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    for r in chosen.mapInArrow(sample, "y binary, doc binary, f binary, value binary").collect():  # bounded by fit_rows and FIT_VALUES
        ys.append(np.frombuffer(r.y, "<f8"))
        ds.append(np.frombuffer(r.doc, "<i4").astype(np.int64) + at)
        fs.append(np.frombuffer(r.f, "<i4").astype(np.int64))
        vs.append(np.frombuffer(r.value, "<f4").astype(float))
        at += len(ys[-1])
    w = fit_linear(np.concatenate(ds), np.concatenate(fs), np.concatenate(vs), np.concatenate(ys))

    return share, p, w


def _scores(part: pa.RecordBatch, w: np.ndarray):
    block, m = _view(part)
    doc, f, value = _features(block, m)
    z = np.bincount(doc, weights=w[f] * value, minlength=block.n)
    return np.where(m["n_words"] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0), votes(m)


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: ``doc_id, votes`` (pattern code), ``posterior``, ``score`` (probability of good) and ``kept``."""
    share, p, w = fit(docs, fit_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s, v = _scores(part, w)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_pattern(v).astype(np.int64)), pa.array(posterior(v, share, p)), pa.array(s), pa.array(s >= 0.5)], ["doc_id", "votes", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, votes long, posterior double, score double, kept boolean")


def keep(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns; no shuffle."""
    _, _, w = fit(docs, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield part.filter(pa.array(_scores(part, w)[0] >= 0.5))

    return docs.mapInArrow(run, docs.schema)
