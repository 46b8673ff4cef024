import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import minhash_dedup as md


def plain_classes(rows, threshold=0.8):
    vec, root = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        vec.append((i, t or "", Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    df, n = Counter(x for _, _, v in vec for x in v), len(vec)
    idf = lambda x: 1 + md.DAMP * np.log(n / df[x]) / np.log(max(n, 2))
    for a in range(len(vec)):
        for b in range(a):
            (i, ti, vi), (j, tj, vj) = vec[a], vec[b]
            lo = sum(min(vi[x], vj[x]) * idf(x) for x in vi.keys() & vj.keys())
            hi = sum(max(vi[x], vj[x]) * idf(x) for x in vi.keys() | vj.keys())
            if ti == tj or (hi and lo / hi >= threshold):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, find(i)) for i, _, _ in vec)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63, 900, dtype=np.uint64))
    w1, w2 = rng.uniform(0.5, 3, 900), rng.uniform(0.5, 3, 900)
    w2[:600] = w1[:600]
    hits, real = [], np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    for shift in range(40):
        x = md.mix(h + np.uint64(shift))
        a = md.samples(np.zeros(900, np.int64), x, w1, 1)[0]
        b = md.samples(np.zeros(900, np.int64), x, w2, 1)[0]
        hits.append((a == b).mean())
    assert abs(np.mean(hits) - real) < 0.04


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(30, 300))] for _ in range(25)]
    texts = [None, "", " ", "one", "one", "two words", "a b c d", "a b c d e", "a b c d e"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(rng.choice([1, 1, 2, max(1, len(c) // 20), len(c) // 3])):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [texts[12]] * 6 + [" ".join(base[3] * 40)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(md, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(md, "GROUP_BYTES", 5000)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(4)
    got = sorted((r.doc_id, r.class_id) for r in md.near_duplicates(docs).collect())
    assert got == plain_classes(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(None, "x y z w v u t"), (1, "x y z w v u t"), (1, "x y z w v u t"), (2, "x y z w v u t"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in md.near_duplicates(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    assert md.near_duplicates(docs.limit(0)).count() == 0


def one_bucket(spark, texts, bands, threshold=0.8):
    """Vectors of texts (shingle hash -> weight) that share every band bucket."""
    df = Counter(x for v in texts for x in v)
    doc = np.repeat(np.arange(len(texts)), [len(v) for v in texts])
    h = np.array([x for v in texts for x in v], np.uint64) << np.uint64(32)
    w = np.array([x for v in texts for x in v.values()], float)
    total = np.bincount(doc, weights=w)
    token = (h >> np.uint64(32)).astype("<u4")
    r = md.rare(doc, h, np.array([df[int(x)] for x in token]), w, total, threshold)
    rows = []
    for i in range(len(texts)):
        at = np.flatnonzero(doc == i)
        at = at[np.argsort(token[at])]
        shares = np.bincount((h[at] >> np.uint64(32)).astype(np.int64) % md.SHARES, weights=w[at], minlength=md.SHARES)
        rows.append((i, float(total[i]), shares.tolist(), bytearray(token[at].tobytes() + w[at].astype("<f4").tobytes()), list(range(100, 100 + bands)), token[r[doc[r] == i]].view(np.int32).tolist()))
    return spark.createDataFrame(rows, md._VECTOR).repartition(4)


def classes_of(edges):
    return {(r.doc_id, r.class_id) for r in md.components(edges).collect()}


def test_bucket_of_hundreds_of_unlike_groups(spark):
    # 60 of 100 shingles are everyone's, 35 the group's, 5 a text's own
    texts, n = [], 300
    for g in range(n):
        for i in (0, 1):
            own = [*range(1000 + g * 50, 1035 + g * 50), *range(100_000 + g * 20 + i * 5, 100_005 + g * 20 + i * 5)]
            texts.append(dict.fromkeys([*range(1, 61), *own], 1.0))
    got = classes_of(md.links(one_bucket(spark, texts, 10), 0.8))
    assert got == {(2 * g + i, 2 * g) for g in range(n) for i in (0, 1)}


def test_chain_through_a_linked_member(spark):
    # 0 ~ 1, 1 ~ 2, 0 !~ 2; 0 leads, and 1 leaves the only bucket with it
    chain = [dict.fromkeys(range(1 + 8 * i, 101 + 8 * i), 1.0) for i in range(3)]
    assert classes_of(md.links(one_bucket(spark, chain, 1), 0.8)) == {(0, 0), (1, 0), (2, 0)}


def test_each_text_of_a_shared_id_has_its_near_duplicates(spark):
    say = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=200))
    texts = [say(i) for i in range(4)]
    rows = [(1, t) for t in texts] + [(10 + i, t + " more") for i, t in enumerate(texts)] + [(20, say(9))]
    got = {(r.doc_id, r.class_id) for r in md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (20, 20)} | {(10 + i, 1) for i in range(4)}


def test_groups_by_place_in_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(md, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(md, "GROUP_BYTES", 5000)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = sorted((r.doc_id, r.class_id) for r in md.near_duplicates(spark.read.parquet(f"{tmp_path}/d")).collect())
    assert got == plain_classes(rows)


def test_group_sizes_are_bounded(spark, tmp_path):
    from lattica.llm.shared import group_of, text_stats

    texts = ["w " * (5 if i < 900 else 3000) for i in range(1000)]  # the long ones last
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    n, size = text_stats(docs)
    by = docs.select(group_of(docs, n, size, 20_000).alias("g"), "text").groupBy("g").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert max(r.b for r in by) <= 4 * 20_000 and sum(r.n for r in by) == 1000
    assert len(by) <= 3 * size / 20_000


def test_a_word_of_all_texts_is_told_once_per_group(spark, tmp_path):
    import pyarrow as pa

    texts = [f"the same five words stand here and then {i} {i + 1} {i + 2}" for i in range(2000)]
    grp = [i // 100 for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(texts), pa.array(range(2000))], ["grp", "text", "doc_id"])
    sent = list(md._send(7)([batch]))
    per_bucket = [sum(np.frombuffer(x, "<u4").sum() for x in b.column(2).to_pylist()) for b in sent]
    # every text has 4 shared shingles and a few of its own; the shared ones are told 20 times, not 2000
    assert sum(per_bucket) <= 2000 * 5 + 20 * 4
    assert max(per_bucket) < 1.5 * np.median(per_bucket) + 80


def test_components_on_the_driver_are_those_of_the_joins(spark, monkeypatch):
    import random

    from lattica.llm import minhash_dedup
    from lattica.llm.shared import owned

    rng = random.Random(8)
    chain = list(range(1000, 1300))
    rng.shuffle(chain)
    pairs = [*zip(chain, chain[1:]), *((rng.randrange(200), rng.randrange(200)) for _ in range(90)), (5, 5), (1 << 61, 7), (7, 1 << 61)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = []
    for here in (len(pairs), 0):
        monkeypatch.setattr(minhash_dedup, "HERE", here)
        with owned(spark, "components"):
            got.append(sorted(tuple(r) for r in minhash_dedup.components(edges).collect()))
            assert not minhash_dedup.components(edges.limit(0)).count()
    assert got[0] == got[1] and len({c for i, c in got[0] if i >= 1000 and i < 1300}) == 1
