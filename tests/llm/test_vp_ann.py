import numpy as np

from lattica.llm import vp_ann


def brute(vectors, k, every):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in sorted(ok):
        if q % every == 0:
            s = sorted((-float(vp_ann._exact(ok[q][None].astype(float), x[None])[0]), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])]
    return sorted(out)


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8))
    q = rng.normal(size=(40, 8))
    tree = vp_ann.VPTree(x, leaf=32)
    row, dist = tree.search(q, 10)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(np.sort(d, 1)[:, :10], dist)
    loose, _ = tree.search(q, 10, factor=2.0)
    hits = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(row, loose, strict=True)])
    assert 0.3 < hits <= 1


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vp_ann, "SHARD", 100)
    monkeypatch.setattr(vp_ann, "BLOCK", 10)
    rng = np.random.default_rng(1)
    v = [[float(np.float32(c)) for c in rng.normal(size=6)] for _ in range(400)]
    v[40] = v[41] = v[42] = v[43]
    for i in range(200, 260):
        v[i] = v[199]
    v[5], v[6], v[7], v[8], v[20] = None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6
    v[60], v[61], v[62] = [1.0, 2.0], [2.0, 1.0], []
    rows = list(enumerate(v))
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = sorted(tuple(r) for r in vp_ann.nearest(df, 20, 20).collect())
    assert got == brute(rows, 20, 20)
    assert vp_ann.nearest(df.limit(0)).count() == 0


def same(spark, v):
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in vp_ann.nearest(df, 20, 20).collect()) == brute(rows, 20, 20)


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    same(spark, rng.choice([-1.0, 1.0], size=(900, 16)))
    same(spark, (rng.random((900, 40)) < 0.1) + np.eye(40)[np.arange(900) % 40])


def test_one_long_vector_costs_the_others_no_precision(spark):
    v = np.random.default_rng(3).normal(size=(900, 8))
    v /= np.sqrt((v**2).sum(1))[:, None]
    v[40] *= 1e8
    same(spark, v)
    v[40], v[41] = v[41], v[40].copy()
    same(spark, v)
