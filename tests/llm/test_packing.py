import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lattica.llm import packing

FILE = P.path("byte_bpe_50k.json")


def test_plan_covers_the_histogram_with_little_waste():
    rng = random.Random(5)
    hist = Counter(min(1023, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    patterns = packing.plan(dict(hist), 1024)
    made = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 1024
        for v in lengths:
            made[v] += n
    assert made == hist
    used = sum(n for _, n in patterns)
    assert used <= 1.01 * sum(k * v for k, v in hist.items()) / 1024 + 2


def test_plan_small_cases():
    assert packing.plan({}, 1024) == []
    assert packing.plan({600: 3}, 1024) == [([600], 3)]
    assert sum(n for _, n in packing.plan({512: 4, 256: 4}, 1024)) == 3


def test_pack_documents(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", " gamma", "Ünïcode", "日本", "<|endoftext|>", "\x1cx"]
    texts = [None, "", "a", "a", *(" ".join(rng.choices(words, k=rng.randint(1, 1500))) for _ in range(60)), "y z " * 20_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    rows = packing.pack_documents(docs, FILE, P.PATTERN).collect()
    tok = Tokenizer.from_file(FILE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0), FILE, P.PATTERN).count() == 0


def made_by(solution, m):
    out = np.zeros(m)
    for (items, times), x in zip(solution.patterns, solution.uses, strict=True):
        out[items] += times * x
    return out


def test_column_generation_ends_at_the_optimum():
    length, demand = np.array([300, 352, 420, 604]), np.array([900.0, 700.0, 800.0, 500.0])
    _, first, _ = packing.start(length, demand, 1024)
    solved = packing.solve(length, demand, 1024)
    assert np.abs(made_by(solved, 4) - demand).max() < 1e-4
    assert solved.price <= 1 + 1e-8 and solved.uses.sum() <= first.sum() + 1e-4
    # all patterns at once, solved by enumeration of bases
    from itertools import combinations, product

    every = [p for p in product(*(range(1024 // v + 1) for v in length)) if any(p) and np.dot(p, length) <= 1024]
    best = np.inf
    for some in combinations(every, 4):
        a = np.array(some, float).T
        if abs(np.linalg.det(a)) > 1e-9:
            x = np.linalg.solve(a, demand)
            if x.min() > -1e-9:
                best = min(best, x.sum())
    assert abs(best - solved.uses.sum()) < 1e-4


def test_many_lengths_are_priced_to_the_optimum():
    rng = random.Random(7)
    for scale in (1, 5, 40):
        hist = Counter(min(1023, int(rng.lognormvariate(5.5, 0.9)) + 1) for _ in range(scale * 2000))
        length = np.array(sorted(hist))
        demand = np.array([hist[int(v)] for v in length], float)
        solved = packing.solve(length, demand, 1024)
        assert solved.price <= 1 + 1e-8 and solved.pivots > 0
        assert np.abs(made_by(solved, len(length)) - demand).max() < 1e-3
        used = sum(n for _, n in packing.plan(dict(hist), 1024))
        assert used <= solved.uses.sum() * 1.002 + 60


def test_scattered_long_and_short_lengths_are_solved_soon():
    """Few documents of each of many lengths, most of them long: patterns alone took minutes to the optimum."""
    import time

    rng = random.Random(2)
    hist = Counter(rng.choice((rng.randint(1, 1023), rng.randint(560, 1000), min(1023, int(rng.lognormvariate(4.5, 1.2)) + 1))) for _ in range(1000))
    length = np.array(sorted(hist))
    demand = np.array([hist[int(v)] for v in length], float)
    began = time.process_time()
    solved = packing.solve(length, demand, 1024)
    assert time.process_time() - began < 60
    assert solved.price <= 1 + 1e-8
    assert np.abs(made_by(solved, len(length)) - demand).max() < 1e-3
    for items, times in solved.patterns:
        assert times.min() > 0 and (length[items] * times).sum() <= 1024


def test_exchanges_are_carried_out():
    one = lambda *pairs: (np.array([i for i, _ in pairs]), np.array([t for _, t in pairs]))
    columns = [one((3, 2)), (np.array([1, 1, 3]), np.array([1, 1, -1])), one((0, 1), (1, -1))]
    patterns, uses = packing.without_exchanges(columns, np.array([4.0, 5.0, 3.0]))
    made = np.zeros(4)
    for (items, times), x in zip(patterns, uses, strict=True):
        assert times.min() > 0
        made[items] += times * x
    assert made.tolist() == [3.0, 7.0, 0.0, 3.0] and uses.sum() == 4.0


def test_ids_are_checked_against_ranks():
    import json

    import pytest

    with open(FILE) as f:
        spec = json.load(f)
    m = spec["model"]["merges"]
    m[0], m[1] = m[1], m[0]
    with pytest.raises(ValueError):
        packing.spec_of(json.dumps(spec))


def test_special_names_are_the_librarys():
    tok = packing.Tokens(open(FILE).read(), P.PATTERN)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "plain"):
        assert tok.ids(text) == Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
