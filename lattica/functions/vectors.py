"""Real2, Real3, their tensors and vectors of any size, as structs and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def real(*parts: Column) -> Column:
    return F.struct(*(p.cast("double").alias(a) for p, a in zip(parts, AXES, strict=False)))


def components(v: Column, dim: int = 3) -> list[Column]:
    return [v[a] for a in AXES[:dim]]


def _each(f, *vs: Column, dim: int = 3) -> Column:
    return real(*(f(*parts) for parts in zip(*(components(v, dim) for v in vs), strict=True)))


def add(a: Column, b: Column, dim: int = 3) -> Column:
    return _each(lambda p, q: p + q, a, b, dim=dim)


def sub(a: Column, b: Column, dim: int = 3) -> Column:
    return _each(lambda p, q: p - q, a, b, dim=dim)


def scale(a: Column, k: Column, dim: int = 3) -> Column:
    return _each(lambda p: p * k, a, dim=dim)


def absolute(a: Column, dim: int = 3) -> Column:
    return _each(F.abs, a, dim=dim)


def dot(a: Column, b: Column, dim: int = 3) -> Column:
    return reduce(lambda s, t: s + t, (p * q for p, q in zip(components(a, dim), components(b, dim), strict=True)))


def square_norm(a: Column, dim: int = 3) -> Column:
    return dot(a, a, dim)


def norm(a: Column, dim: int = 3) -> Column:
    return F.sqrt(square_norm(a, dim))


def normalize(a: Column, dim: int = 3) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a, dim)
    return F.when(n == 0, a).otherwise(_each(lambda p: F.try_divide(p, n), a, dim=dim))


def nearly_zero(a: Column, eps: float, dim: int = 3) -> Column:
    return reduce(lambda s, t: s & t, (F.abs(p) < eps for p in components(a, dim)))


def cross(a: Column, b: Column) -> Column:
    (ax, ay, az), (bx, by, bz) = components(a), components(b)
    return real(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def cross2d(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def determinant(a: Column, b: Column, c: Column) -> Column:
    return dot(a, cross(b, c))


def tensor(*rows: Column) -> Column:
    return F.struct(*(r.alias(a) for r, a in zip(rows, AXES, strict=False)))


def tensor_apply(t: Column, v: Column, dim: int = 3) -> Column:
    """Matrix times vector."""
    return real(*(dot(t[a], v, dim) for a in AXES[:dim]))


def tensor_nearly_zero(t: Column, eps: float, dim: int = 3) -> Column:
    return reduce(lambda s, u: s & u, (nearly_zero(t[a], eps, dim) for a in AXES[:dim]))


# ------------------------------------------------------------ arrays of numbers


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)


def array_norm(a: Column, kind: str = "2") -> Column:
    """Norms 0 (nonzeros), 1, 2 and inf."""
    d = F.transform(a, lambda v: F.abs(v.cast("double")))
    if kind == "0":
        return F.size(F.filter(d, lambda v: v != 0)).cast("double")
    if kind == "1":
        return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)
    if kind == "2":
        return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))
    return F.array_max(d)


# ------------------------------------------------------------ geometry of items


def surface_centre(points: list[Column], dim: int = 3) -> Column:
    n = float(len(points))
    return real(*(reduce(lambda s, t: s + t, (p[a] for p in points)) / n for a in AXES[:dim]))


def quad_area_2d(p: list[Column]) -> Column:
    """Half the cross product of the diagonals."""
    return 0.5 * cross2d(sub(p[2], p[0], 2), sub(p[3], p[1], 2))


def polygon_area_2d(p: list[Column]) -> Column:
    """Oriented area of a polygon given in order."""
    return 0.5 * reduce(lambda s, t: s + t, (cross2d(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True)))


def quad_normal(p: list[Column]) -> Column:
    """Oriented area vector of a quadrangle in space."""
    return scale(cross(sub(p[2], p[0]), sub(p[3], p[1])), F.lit(0.5))


#: Faces of a hexahedron by its corners, outward.
HEXA_FACES = ((0, 3, 2, 1), (0, 4, 7, 3), (0, 1, 5, 4), (4, 5, 6, 7), (1, 2, 6, 5), (3, 7, 6, 2))


def hexa_volume(p: list[Column]) -> Column:
    """Volume by pyramids from the centre over the faces' quarters."""
    c = surface_centre(p)
    total = None
    for face in HEXA_FACES:
        q = [p[i] for i in face]
        m = surface_centre(q)
        for a, b in zip(q, q[1:] + q[:1], strict=True):
            v = determinant(sub(a, c), sub(b, c), sub(m, c)) / 6.0
            total = v if total is None else total + v
    return total


def tetra_volume(p: list[Column]) -> Column:
    return determinant(sub(p[1], p[0]), sub(p[2], p[0]), sub(p[3], p[0])) / 6.0
