import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400) | st.text("ab", max_size=400).map(str.encode) | st.text("a\0", max_size=200).map(str.encode))
def test_suffix_array(data):
    assert sd.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_long_ties_and_many_buckets():
    data = b"abcabcab" * 700 + b"x" + b"abcabcab" * 500
    got = np.concatenate(list(sd.suffix_blocks(np.frombuffer(data, np.uint8), most=64)))
    assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 8)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = [para(30) for _ in range(6)]
    texts = [None, "", "short", "short", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 200]
    for _ in range(60):
        parts = [para(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.7:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts.insert(rng.randint(0, len(parts)), s[a : a + rng.randint(40, 200)])
        texts.append(" ".join(parts))
    texts += [texts[20], texts[20], texts[21][:200] + "!" + texts[21][200:], texts[30] + texts[31], texts[30] * 3]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[o]) for i, o in enumerate(order)]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, tag string").repartition(3)
    got = sorted(tuple(r) for r in sd.repeated_spans(docs).collect())
    assert got == brute(rows)


def test_spans_equal_brute_force(spark):
    check(spark, corpus())


def test_repeated_rows_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 1)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(sd, "GROUP_BYTES", 2500)
    monkeypatch.setattr(sd, "SHARD_BYTES", 3000)
    rows = corpus()
    check(spark, rows + rows[:5])


def test_rows_without_id(spark):
    text = "some words that are long enough to be found again by the sorter " * 3
    docs = spark.createDataFrame([(None, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in sd.repeated_spans(docs).collect()) == [(0, 0), (0, 0), (1, 0)]


def test_empty_table(spark):
    assert sd.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_repeats(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(3)
    want = {i: (n - gone, sha) for i, n, gone, _, sha in brute(rows)}
    out = sd.without_repeats(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        n, sha = want[r.doc_id]
        b = (r.text or "").encode()
        assert r.kept == "x" and (hashlib.sha256(b).hexdigest() == sha or len(b) < n)
    assert sum(hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][1] for r in out) > 0.9 * len(out)


def test_groups_by_place_in_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sd, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(sd, "GROUP_BYTES", 2500)
    monkeypatch.setattr(sd, "SHARD_BYTES", 3000)
    rows = corpus()
    rows = rows + rows[:5] + [(rows[7][0], rows[8][1] + " another text of one id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = sorted(tuple(r) for r in sd.repeated_spans(spark.read.parquet(f"{tmp_path}/d")).collect())
    assert got == brute(rows)
    assert sd.without_repeats(spark.read.parquet(f"{tmp_path}/d")).count() == len(rows)
