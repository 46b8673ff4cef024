import random

import numpy as np

from lattica.llm import quality_classifier as qc


def simulated(alarm, n=40_000, seed=0):
    """Votes of documents of which 15 % are bad, of three kinds, and every heuristic fires on ``alarm`` of the good ones."""
    rng = np.random.default_rng(seed)
    k = len(qc.HEURISTICS)
    kind = rng.choice(4, n, p=[0.85, 0.06, 0.05, 0.04])
    rate = np.full((4, k), alarm)
    for c, group in enumerate(qc.GROUPS, 1):
        for i, h in enumerate(group):
            rate[c, qc.HEURISTICS.index(h)] = (0.9, 0.8, 0.7, 0.75, 0.6)[i]
    fire = rng.random((n, k)) < rate[kind]
    praise = rng.random((n, k)) < np.where(kind == 0, 0.8, 0.3)[:, None]
    return np.where(fire, 0, np.where(praise, 2, 1)), kind, rate


def test_em_recovers_the_rates():
    for alarm in (0.01, 0.03, 0.1):
        v, kind, rate = simulated(alarm)
        codes, counts = np.unique(qc._pattern(v), return_counts=True)
        assert (qc._pattern(qc.unpattern(codes)) == codes).all()
        share, p = qc.expectation_maximisation(codes, counts.astype(float))
        assert abs(share[0] - 0.85) < 0.02
        # rates among the votes cast
        told = lambda bad, praise: bad / (bad + (1 - bad) * praise)
        assert np.abs(p[0, :, 0] - told(alarm, 0.8)).max() < 0.01 + 0.1 * alarm
        for c, group in enumerate(qc.GROUPS, 1):
            at = [qc.HEURISTICS.index(h) for h in group]
            assert np.abs(p[c, at, 0] - told(rate[c, at], 0.3)).max() < 0.08
        # as many documents judged right as with the true rates, but for a few
        bad = told(rate, np.where(np.arange(4) == 0, 0.8, 0.3)[:, None])
        best = qc.posterior(v, np.array([0.85, 0.06, 0.05, 0.04]), np.stack([bad, 1 - bad], 2))
        right = lambda x: ((x < 0.5) == (kind > 0)).mean()
        assert right(qc.posterior(v, share, p)) > right(best) - 0.005 and right(best) > 0.95


def slow_em(v, rounds):
    """Document by document, without patterns."""
    k, classes = v.shape[1], 1 + len(qc.GROUPS)
    r = []
    for row in v:
        fired = [sum(row[qc.HEURISTICS.index(h)] == 0 for h in g) for g in qc.GROUPS]
        first = 0 if max(fired) < 2 else 1 + fired.index(max(fired))
        x = [1.0 if c == first else 0.02 for c in range(classes)]
        r.append([y / sum(x) for y in x])
    for _ in range(rounds):
        share = [(sum(x[c] for x in r) + 1) / (len(v) + classes) for c in range(classes)]
        p = [[[sum(x[c] for x, row in zip(r, v, strict=True) if row[i] == o) + 1 for o in (0, 2)] for i in range(k)] for c in range(classes)]
        p = [[[y / sum(z) for y in z] for z in q] for q in p]
        r = []
        for row in v:
            x = [share[c] * np.prod([p[c][i][row[i] // 2] for i in range(k) if row[i] != 1]) for c in range(classes)]
            r.append([y / sum(x) for y in x])
    return np.array([x[0] for x in r])


def test_em_equals_a_document_by_document_version():
    v, _, _ = simulated(0.05, 300, 3)
    codes, counts = np.unique(qc._pattern(v), return_counts=True)
    share, p = qc.expectation_maximisation(codes, counts.astype(float), 12)
    assert np.allclose(qc.posterior(v, share, p), slow_em(v, 12), atol=1e-8)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.choice([2, 2, 3, 4, 5, 6, 7])))
    good = [(i, " ".join(word() for _ in range(rng.randint(60, 300))) + ".") for i in range(300)]
    bad = []
    for i in range(300, 360):
        w = [word() for _ in range(100)]
        bad.append((i, rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x + "###" for x in w), " ".join(w[:6] * 20), " | ".join(x + word() for x in w)])))
    return good, bad


def test_keeps_good_and_rejects_bad(spark):
    good, bad = corpus()
    rows = [*good, *bad, (900, None), (901, ""), (902, "\n \t"), (903, good[0][1]), (903, good[0][1]), (None, good[1][1]), (904, " ".join(good[i % 300][1] for i in range(3000)))]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean").repartition(4)
    out = qc.classify(docs).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert sum(kept[i] for i, _ in good) >= 0.99 * len(good)
    assert sum(not kept[i] for i, _ in bad) >= 0.95 * len(bad)
    assert not any(kept[i] for i in (900, 901, 902)) and kept[903] and kept[None] and kept[904]
    stay = qc.keep(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, k in kept.items() if k}
    assert qc.classify(docs.limit(0)).count() == 0
