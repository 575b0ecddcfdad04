"""Column algebra of complex numbers, vectors and quaternions: elements are arrays of doubles, lane by lane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = {"scalar": 1, "complex": 2, "vec2": 2, "vec3": 3, "quaternion": 4}


def lanes(*values: Column) -> Column:
    return F.array(*values)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def scale(a: Column, s: float | Column) -> Column:
    return F.transform(a, lambda p: p * s)


def mul(a: Column, b: Column, element: str) -> Column:
    """Product of scalars, complex numbers or quaternions (w, x, y, z); vectors have none."""
    if element == "scalar":
        return lanes(a[0] * b[0])
    if element == "complex":
        return lanes(a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0])
    if element != "quaternion":
        raise ValueError("vectors have no product; use dot or cross")
    signs = ((0, 0, 1), (1, 1, -1), (2, 2, -1), (3, 3, -1)), ((0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, -1)), ((0, 2, 1), (1, 3, -1), (2, 0, 1), (3, 1, 1)), ((0, 3, 1), (1, 2, 1), (2, 1, -1), (3, 0, 1))
    return lanes(*[sum((s * a[i] * b[j] for i, j, s in row[1:]), row[0][2] * a[row[0][0]] * b[row[0][1]]) for row in signs])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cross(a: Column, b: Column) -> Column:
    return lanes(*[a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)])


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; zero stays zero."""
    m = magnitude(a)
    return F.when(m > 0, F.transform(a, lambda p: p / m)).otherwise(a)


def conjugate(a: Column, element: str) -> Column:
    if element not in ("complex", "quaternion"):
        raise ValueError("only complex numbers and quaternions have a conjugate")
    return F.transform(a, lambda p, k: F.when(k == 0, p).otherwise(-p))


def real(a: Column) -> Column:
    return a[0]


def imaginary(a: Column) -> Column:
    return a[1]
