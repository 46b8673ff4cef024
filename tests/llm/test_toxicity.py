import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import toxicity as tx
from lattica.llm.textblock import TextBlock


def brute_segments(s):
    """Maximal scoring segments by their recursive definition: the best segment, then the same to its left and right."""
    if not any(v > 0 for v in s):
        return []

    def solve(lo, hi):
        best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return [*solve(lo, a), (a, b - 1), *solve(b, hi)]

    return solve(0, len(s))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.5, -1.0, 0.7, 1.1, 2.3]), max_size=14))
def test_segments(scores):
    s = [v * (1 + i * 1e-6) for i, v in enumerate(scores)]  # no ties
    total = np.concatenate([[0.0], np.cumsum(s)])
    got = [(a, b) for _, a, b in tx.segments(total, np.flatnonzero(np.array(s) > 0))]
    assert got == brute_segments(s)


def test_lambda_and_log_odds():
    lam = tx.solve_lambda(np.array([-1.0, 1.0]), np.array([0.75, 0.25]))
    assert abs(lam - math.log(3)) < 1e-9
    odds, z = tx.log_odds(np.array([50.0, 10.0]), np.array([50.0, 90.0]), 100, 900)
    assert odds[0] > 1 and z[0] > 3 and abs(odds[1]) < 0.3


def test_tokens_ignore_case_and_trailing_punctuation():
    doc, h = tx.tokens(TextBlock.of(["Idiot!! idiot, IDIOT", None, ""]))
    assert doc.tolist() == [0, 0, 0] and len(set(h[:, 0].tolist())) == 1


def corpus(n=900):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    common = [word() for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(common, k=rng.randint(20, 200)) + [word() for _ in range(10)]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "scoundrels" + word()]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    rows += [(10_000, None), (10_001, ""), (10_002, "vile " * 3000), (10_002, "vile " * 3000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(4)
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = tx.score(docs, tx.fit(docs, lab.filter(fold != 2))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.predicted for r in out}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i] == t for i, t in held)
    assert right >= 0.95 * len(held)
    assert got[10_000] == got[10_001] == 0 and got[10_002] == 1
    assert tx.score(docs.limit(0), tx.Model(np.zeros(0, np.uint64), np.zeros(0), weights=np.zeros(4))).count() == 0


def slow_score(model, text):
    """One text: tokens by splitting, features by single hashes, segments by their definition."""
    import re

    odds = dict(zip(model.features.tolist(), model.odds.tolist(), strict=True))
    one = lambda b: int(TextBlock.of([b.decode("utf-8")]).hash_ranges(np.array([0]), np.array([len(b)]))[0])
    s = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()):
        w = w[:1] + w[1:].rstrip(b".,;:!?\"'()[]*#$%&|")
        found = [one(w)]
        for n in tx.PREFIXES:
            p = w[:n].decode("utf-8", "ignore").encode()
            if p and len(p) < len(w):
                found.append(one(p) ^ 0xA5A5A5A5A5A5A5A5)
        s.append(next((odds[f] for f in found if f in odds), 0.0) - tx.DRIFT)
    lam, log_k = model.scale
    gain = [lam * sum(s[a : b + 1]) - log_k - math.log(len(s)) for a, b in brute_segments(s)]
    sure = [g for g in gain if g > 0]
    x = [1.0, *(math.log1p(v) for v in (max([0.0, *gain]), sum(sure), len(sure)))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_scores_equal_a_slow_version(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [t[:150] for _, t in rows[:40]] + ["vile. vile!!!!!!!! ROTTEN; scoundrelsé x", "!!!!!! ...", "ééééé scoundréls"]
    stats, _ = model.stats(TextBlock.of(texts))
    assert np.allclose(model.score(stats), [slow_score(model, t) for t in texts], atol=1e-9)


def test_log_k_from_a_sample_by_chance():
    rng = np.random.default_rng(1)
    x = math.log(0.05) - np.log(-np.log(rng.random(20_000)))
    x[x < -2.5] = -np.inf  # texts without a segment
    assert abs(tx.log_k_of(x) - math.log(0.05)) < 0.05
    assert tx.log_k_of(np.full(5, -np.inf)) == 0.0


def test_rows_without_id_and_many_rows_of_one_id(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame([*rows, *([(3, "same id again")] * 500), (None, "vile vile vile rotten")], "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fit_rows=150)
    out = tx.score(docs, model).collect()
    assert len(out) == 901 and all(0 <= r.score <= 1 for r in out)
