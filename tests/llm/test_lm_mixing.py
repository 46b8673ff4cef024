import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import lm_mixing as lm
from lattica.llm.textblock import TextBlock


def corpus(n=150):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60)]
    texts = [None, "", " \n", "ÉÀ ß 日本 🙂", "A a\tA", "x" * 20_000]
    texts += [" ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(1, 200))) + "." for _ in range(n)]
    return list(enumerate(texts))


def test_probabilities_of_all_short_texts_sum_to_at_most_one():
    counts = np.zeros(257, np.int64)
    counts[[97, 98]] = 50
    counts[256] = 10
    a = lm.Alphabet(counts)
    model = lm.Predictors.of(TextBlock.of(["abab", "ba", "aab"]), a)
    texts = ["", *(bytes([x]).decode("latin1") for x in range(128)), *(chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26))]
    p = np.exp(-model.cost(TextBlock.of(texts)))
    assert 0.1 < p.sum() <= 1 + 1e-6
    block = TextBlock.of(texts)
    word = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
    share = np.array([{"abab": 0.3, "ba": 0.2, "a": 0.1, "b": 0.1}.get(w, 0.0) for ws in word for w in ws])
    mixed = np.exp(-model.cost(block, share))
    assert 0.1 < mixed.sum() <= 1 + 1e-6
    assert abs(mixed - p).max() > 1e-3


def test_score_does_not_depend_on_company():
    rows = corpus(40)
    counts = np.bincount(np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), minlength=257)
    counts[256] = len(rows)
    a = lm.Alphabet(counts)
    model = lm.Predictors.of(TextBlock.of([t for _, t in rows]), a)
    every = model.cost(TextBlock.of([t for _, t in rows]))
    single = np.array([model.cost(TextBlock.of([t]))[0] for _, t in rows])
    assert np.allclose(every, single, rtol=1e-6)


def test_base_counts_and_held_out_bits(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(lm, "GROUP_BYTES", 7000)
    rows = corpus()
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, train boolean").repartition(4)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = {r.doc_id: r for r in lm.score(docs, fold != 2).collect()}
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in tok(t))
    n, v, bits = sum(c.values()), len(c), []
    for i, t in rows:
        r, w = got[i], tok(t)
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (not held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
        if held[i] and i > 5:
            bits.append(r.bits_per_byte)
    data = np.frombuffer(" ".join(t or "" for _, t in rows[6:]).encode(), np.uint8)
    share = np.bincount(data) / len(data)
    assert np.mean(bits) < -(share[share > 0] * np.log2(share[share > 0])).sum() - 0.3
    assert lm.score(docs.limit(0), fold != 2).count() == 0


def test_every_stretch_teaches_the_next():
    rows = corpus(40)
    counts = np.bincount(np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), minlength=257)
    counts[256] = len(rows)
    a = lm.Alphabet(counts)
    tables = lm.Predictors.of(TextBlock.of([t for _, t in rows]), a).tables
    model, text = lm.Predictors(a, -tables), "abc defg hij " * 15  # predictors that are always wrong: only learning helps
    assert len(text) < 256
    learnt = model.cost(TextBlock.of([text]))[0]
    model.alphabet.step = model.alphabet.step * 0
    assert learnt < model.cost(TextBlock.of([text]))[0]


def slow_cost(model, text, share):
    """One text, one bit at a time."""
    a = model.alphabet
    raw, first = lm.stream(TextBlock.of([text]))
    slots = lm.contexts(raw)
    sig = lambda v: 1 / (1 + math.exp(-v))
    w = [[f] * lm.GATES for f in lm.FIRST]
    mid = [sig((i - lm.BUCKETS / 2 + 0.5) * 32 / lm.BUCKETS) for i in range(lm.BUCKETS)]
    seen, ones = [30.0] * lm.BUCKETS, [30.0 * m for m in mid]
    costs, waiting = [], []
    for j in range(len(text.encode()) + 1):
        at = first[0] + j
        sym, cost = int(raw[at]), 0.0
        for i in range(a.begin[sym], a.begin[sym] + a.length[sym]):
            node, gate, one = int(a.node[i]), int(a.gate[i]), float(a.one[i])
            x = [float(model.tables[k][int(slots[k][at]) ^ node]) for k in range(lm.ORDERS)]
            z = min(16.0, max(-16.0, sum(w[k][gate] * x[k] for k in range(lm.ORDERS)) / 8))
            bucket = int(z * lm.BUCKETS / 32 + lm.BUCKETS / 2 - 1e-3)
            q = 0.75 * sig(z) + 0.25 * ones[bucket] / seen[bucket]
            cost -= math.log(q if one else 1 - q)
            waiting.append((gate, x, one, one - sig(z), bucket))
        costs.append(cost)
        if j % lm.STRETCH == lm.STRETCH - 1:
            for gate, x, one, err, bucket in waiting:
                for k in range(lm.ORDERS):
                    w[k][gate] += a.step[gate] * err * x[k]
                seen[bucket] += 1
                ones[bucket] += one
            waiting = []
    total, gained, data = sum(costs), [0.0] * len(lm.WORD_RATES), text.encode()
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", data):
        by = sum(costs[m.start() : m.end() + 1])
        after = a.after[data[m.end()] if m.end() < len(data) else lm.END]
        for i, r in enumerate(lm.WORD_RATES):
            gained[i] += by + math.log((1 - r) * math.exp(-by) + r * share.get(m[0].lower(), 0.0) * math.exp(after))
    return total - math.log(sum(p * math.exp(g) for p, g in zip(lm.WORD_PRIOR, gained, strict=True)))


def test_scores_equal_a_bit_by_bit_version():
    rows = [t for _, t in corpus(30) if t and len(t) < 2000]
    counts = np.bincount(np.frombuffer("".join(rows).lower().encode(), np.uint8), minlength=257)
    counts[256] = len(rows)
    model = lm.Predictors.of(TextBlock.of(rows), lm.Alphabet(counts))
    rows = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in rows]
    words = Counter(w for t in rows for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))
    share = {w: c / words.total() for w, c in words.items()}
    each = np.array([share[w] for t in rows for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())])
    got = model.cost(TextBlock.of(rows), each)
    want = [slow_cost(model, t, share) for t in rows]
    assert np.allclose(got, want, rtol=2e-4, atol=2e-3)


def test_counts_beyond_four_bytes():
    n = np.array([1, 5_000_000_000, 7])
    assert lm._unwide(lm._wide(n), 3).tolist() == n.tolist()
    assert lm._unwide(lm._wide(n[:1]), 1).tolist() == [1] and len(lm._wide(n[:1])) == 4


def test_all_texts_of_a_minority_script_have_contexts():
    texts = ["plain words of the many " * 20] * 50 + ["мало слов на другом языке " * 20] * 3
    counts = np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=257)
    counts[256] = len(texts)
    model = lm.Predictors.of(TextBlock.of(texts), lm.Alphabet(counts))
    bits = model.cost(TextBlock.of([texts[-1]]))[0] / math.log(2) / len(texts[-1].encode())
    assert bits < 1.5


def test_few_long_texts_are_prepared_many_stretches_at_once():
    class Counted(np.ndarray):
        calls = 0

        def take(self, *args, **kwargs):
            Counted.calls += 1
            return np.asarray(self).take(*args, **kwargs)

    texts = ["abc defg hij " * 250, "hij abc k " * 320]  # about a hundred stretches each
    counts = np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=257)
    counts[256] = len(texts)
    model = lm.Predictors.of(TextBlock.of(texts), lm.Alphabet(counts))
    want = [slow_cost(model, t, {}) for t in texts]
    model.alphabet.length = model.alphabet.length.view(Counted)
    assert np.allclose(model.cost(TextBlock.of(texts), np.zeros(sum(len(t.split()) for t in texts))), want, rtol=2e-4)
    assert 0 < Counted.calls <= 5  # once per stretch would be a hundred times


def test_context_counts_do_not_depend_on_parts(monkeypatch):
    block = TextBlock.of([t for _, t in corpus(40)])
    raw, first = lm.stream(block)
    own = np.ones(len(raw), bool)
    own[(first[:, None] + np.arange(-4, 0)).ravel()] = False
    want = [np.unique(((s << np.uint32(8)) | raw)[own], return_counts=True) for s in lm.contexts(raw)]
    for size in (1, 3000, 1 << 20):
        monkeypatch.setattr(lm, "PART_BYTES", size, raising=False)
        for (k, n), (wk, wn) in zip(lm.context_counts(block), want, strict=True):
            assert np.array_equal(k, wk) and np.array_equal(n, wn)
