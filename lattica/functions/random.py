"""Random numbers as functions of a row's counter: any draw is random-access, whatever the partitioning.

``psdes`` is a pseudo-DES hash of two 32-bit words in four rounds; the
sequential generators (linear and inversive congruential, KISS, MRG32k3a,
Mersenne twister) are driver-side iterators for tests and small inputs, and a
column is drawn from them through a seed per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = (1 << 32) - 1
#: Round constants of the pseudo-DES hash (fixed values).
PSDES_1 = (0xBAA96887, 0x1E17D32C, 0x03BCDC3C, 0x0F33D1B2)
PSDES_2 = (0x4B0F3B58, 0xE874F0C3, 0x6955C5A6, 0x55A7CA46)


def psdes(left: int, right: int) -> tuple[int, int]:
    for a, b in zip(PSDES_1, PSDES_2, strict=True):
        turned = right ^ a
        lo, hi = turned & 0xFFFF, turned >> 16
        mixed = (lo * lo + (~(hi * hi) & _M)) & _M
        mixed = ((mixed >> 16) | ((mixed & 0xFFFF) << 16)) & _M
        left, right = right, left ^ (((mixed ^ b) + lo * hi) & _M)
    return left & _M, right & _M


def _psdes_array(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, h = np.uint64(_M), np.uint64(0xFFFF)
    left, right = left.astype(np.uint64) & m, right.astype(np.uint64) & m
    for a, b in zip(PSDES_1, PSDES_2, strict=True):
        t = right ^ np.uint64(a)
        lo, hi = t & h, t >> np.uint64(16)
        x = (lo * lo + (~(hi * hi) & m)) & m
        x = (x >> np.uint64(16)) | ((x & h) << np.uint64(16))
        left, right = right, left ^ (((x ^ np.uint64(b)) + lo * hi) & m)
    return left, right


class Counter:
    """Sequential use: the state's front word counts, its back word is the key; children hash the whole state."""

    def __init__(self, state: int):
        self.state = state & ((1 << 64) - 1)

    def draw(self, leap: int = 0) -> float:
        front, key = self.state >> 32, self.state & _M
        front = (front + leap) & _M
        left, right = psdes(key, front)
        self.state = (((front + 1) & _M) << 32) | key
        return STEP * float((left << 32) | right)

    def child(self, leap: int = 0) -> Counter:
        if leap:
            self.draw(leap - 1)
        left, right = psdes(self.state >> 32, self.state & _M)
        self.draw(0)
        return Counter((left << 32) | right)


#: 2**-64, the step of a 64-bit word on [0, 1).
STEP = 5.4210108624275222e-20


def counter_uniform(counter: Column, key: int) -> Column:
    """Uniform on [0, 1): the 64-bit word of ``psdes(key, counter)`` times ``STEP``; a leap is an addition to the counter."""

    @F.pandas_udf("double")
    def draw(c: pd.Series) -> pd.Series:
        a, b = _psdes_array(np.full(len(c), key, np.uint64), c.to_numpy(np.int64).astype(np.uint64))
        return pd.Series(((a << np.uint64(32)) | b).astype(np.float64) * STEP)

    return draw(counter)


def hash_uniform(*columns: Column, seed: int = 42) -> Column:
    """Uniform on [0, 1) from the columns' 64-bit hash; stays in the JVM."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def normal(u1: Column, u2: Column) -> Column:
    """Box-Muller."""
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * np.pi * u2)


def uniform_int(u: Column, low: int, high: int) -> Column:
    """Integers of [low, high]."""
    return (F.lit(low) + F.floor(u * F.lit(high - low + 1))).cast("long")


def on_sphere(u1: Column, u2: Column) -> Column:
    z, a = 2.0 * u1 - 1.0, 2.0 * np.pi * u2
    r = F.sqrt(F.greatest(1.0 - z * z, F.lit(0.0)))
    return F.struct((r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), z.alias("z"))


# ------------------------------------------------------------ sequential generators


def linear_congruential(seed: int, a: int = 16807, c: int = 0, m: int = 2147483647) -> Iterator[int]:
    x = seed % m
    if c == 0 and x == 0:
        x = 1
    while True:
        x = (a * x + c) % m
        yield x


def inversive_congruential(seed: int, a: int = 9102, b: int = 2147483647 - 36884165, p: int = 2147483647) -> Iterator[int]:
    x = seed % p
    while True:
        x = (a * (pow(x, -1, p) if x else 0) + b) % p
        yield x


def mersenne_twister(seed: int = 5489) -> Iterator[int]:
    rng = np.random.RandomState(seed)
    while True:
        yield int(rng.randint(0, 1 << 32, dtype=np.uint64))


def kiss(x: int = 123456789, y: int = 362436069, z: int = 521288629, w: int = 916191069) -> Iterator[int]:
    """A congruential, a shift-register and a multiply-with-carry generator, added."""
    while True:
        x = (69069 * x + 12345) & _M
        y ^= (y << 13) & _M
        y ^= y >> 17
        y ^= (y << 5) & _M
        z = (36969 * (z & 0xFFFF) + (z >> 16)) & _M
        w = (18000 * (w & 0xFFFF) + (w >> 16)) & _M
        yield (x + y + ((z << 16) + w & _M)) & _M


def mrg32k3a(seed: int = 12345) -> Iterator[float]:
    """Two combined multiple recursive generators; uniform on (0, 1)."""
    m1, m2 = 4294967087, 4294944443
    a, b = [seed] * 3, [seed] * 3
    while True:
        p, q = (1403580 * a[1] - 810728 * a[0]) % m1, (527612 * b[2] - 1370589 * b[0]) % m2
        a, b = [*a[1:], p], [*b[1:], q]
        yield ((p - q) % m1 or m1) / (m1 + 1)


GENERATORS = {"linear": linear_congruential, "inversive": inversive_congruential, "mersenne": mersenne_twister, "kiss": kiss, "mrg32k3a": mrg32k3a}
