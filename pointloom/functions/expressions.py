"""Column functions: affine transforms, units, colour, implicit solids, trait genomes and an expression tree."""

from __future__ import annotations

from math import pi, radians

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- transforms -------------------------------------------------------------------------------------------------


def compose(second: list[Column], first: list[Column]) -> list[Column]:
    """Affine (a, b, c, d, tx, ty): x' = a x + c y + tx, y' = b x + d y + ty, ``first`` applied before ``second``."""
    a, b, c, d, tx, ty = second
    e, f, g, h, ux, uy = first
    return [a * e + c * f, b * e + d * f, a * g + c * h, b * g + d * h, a * ux + c * uy + tx, b * ux + d * uy + ty]


def apply_affine(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, tx, ty = m
    return a * x + c * y + tx, b * x + d * y + ty


#: Micrometres of a unit of length.
MICROMETRES = {"nanometer": 1e-3, "micrometer": 1.0, "millimeter": 1e3, "centimeter": 1e4, "meter": 1e6, "inch": 25400.0}


def to_micrometres(value: Column, unit: Column) -> Column:
    """Null for a unit that is not known."""
    out = F.lit(None).cast("double")
    for name, factor in MICROMETRES.items():
        out = F.when(F.lower(unit) == name, value * factor).otherwise(out)
    return out


# --- colour -----------------------------------------------------------------------------------------------------

#: Fixed values of the Oklab colour space: linear sRGB to cone responses, their roots to lightness, a and b.
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def _times(matrix, v: list[Column]) -> list[Column]:
    return [sum((w * x for w, x in zip(row[1:], v[1:], strict=True)), row[0] * v[0]) for row in matrix]


def srgb_to_oklab(r: Column, g: Column, b: Column) -> list[Column]:
    return _times(TO_LAB, [F.cbrt(x) for x in _times(TO_CONES, [srgb_to_linear(c) for c in (r, g, b)])])


def oklab_to_oklch(lab: list[Column]) -> list[Column]:
    """Lightness, chroma, hue in radians from -pi to pi."""
    return [lab[0], F.sqrt(lab[1] * lab[1] + lab[2] * lab[2]), F.atan2(lab[2], lab[1])]


_FROM_LAB, _FROM_CONES = (tuple(map(tuple, np.linalg.inv(np.array(m)).tolist())) for m in (TO_LAB, TO_CONES))
#: How far out of 0 to 1 a linear component may lie to count as inside.
GAMUT_EDGE, GAMUT_STEPS = 1e-6, 24


def oklch_to_linear(lightness: Column, chroma: Column, hue: Column) -> list[Column]:
    cones = _times(_FROM_LAB, [lightness, chroma * F.cos(hue), chroma * F.sin(hue)])
    return _times(_FROM_CONES, [c * c * c for c in cones])


def in_gamut(lightness: Column, chroma: Column, hue: Column) -> Column:
    ok = [c.between(-GAMUT_EDGE, 1 + GAMUT_EDGE) for c in oklch_to_linear(lightness, chroma, hue)]
    return ok[0] & ok[1] & ok[2]


def gamut_chroma(lightness: Column, chroma: Column, hue: Column) -> Column:
    """The chroma itself if the colour can be shown, or the largest that can at this lightness and hue, by bisection."""
    zero = F.struct(F.lit(0.0).alias("lo"), chroma.cast("double").alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        ok = in_gamut(lightness, mid, hue)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(GAMUT_STEPS)), zero, step, lambda s: s["lo"])
    return F.when(in_gamut(lightness, chroma, hue), chroma).otherwise(found)


def oklch_to_srgb(lightness: Column, chroma: Column, hue: Column) -> list[Column]:
    """Red, green and blue from 0 to 1; ``chroma`` is one that can be shown."""
    return [F.least(F.greatest(linear_to_srgb(c), F.lit(0.0)), F.lit(1.0)) for c in oklch_to_linear(lightness, chroma, hue)]


def diverging(t: Column, negative: float = radians(250), positive: float = radians(29), centre: float = 0.97, end: float = 0.55, chroma: float = 0.15) -> list[Column]:
    """Lightness, chroma and hue of a signed value from -1 to 1: size sets the first two, the sign the hue alone."""
    size = F.least(F.abs(t), F.lit(1.0))
    return [centre + (end - centre) * size, chroma * size, F.when(t < 0, negative).otherwise(positive)]


def sequential(t: Column, hue: Column, low: float = 0.14, high: float = 0.86, chroma: float = 0.15) -> list[Column]:
    """Lightness, chroma and hue of a value from 0 to 1: lightness grows evenly, chroma fast at first."""
    v = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return [low + (high - low) * v, chroma * F.pow(v, F.lit(0.4)), hue]


def categorical_hue(k: Column, n: int, offset: float = radians(200)) -> Column:
    """Hue of one of n categories, evenly around the circle."""
    return (offset + 2 * pi * k / max(n, 1)) % (2 * pi)


def mixed(first: list[Column], second: list[Column], share: Column) -> list[Column]:
    """Two colours (lightness, a, b) mixed in proportion."""
    return [a + (b - a) * share for a, b in zip(first, second, strict=True)]


# --- solids -----------------------------------------------------------------------------------------------------


def sphere(x: Column, y: Column, z: Column, r: float) -> Column:
    return F.sqrt(x * x + y * y + z * z) - r


def box(x: Column, y: Column, z: Column, half: tuple[float, float, float]) -> Column:
    q = [F.abs(c) - h for c, h in zip((x, y, z), half, strict=True)]
    out = [F.greatest(c, F.lit(0.0)) for c in q]
    return F.sqrt(sum((c * c for c in out[1:]), out[0] * out[0])) + F.least(F.greatest(*q), F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return F.least(a, b)


def intersect(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.greatest(a, -b)


def smooth_union(a: Column, b: Column, k: float) -> Column:
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * (b - a) / k))
    return b + (a - b) * h - k * h * (1 - h)


# --- expression tree --------------------------------------------------------------------------------------------

_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(b != 0, a / b),
    "min": F.least,
    "max": F.greatest,
    "pow": F.pow,
    "atan2": F.atan2,
}
_UNARY = {"neg": lambda a: -a, "sin": F.sin, "cos": F.cos, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "log": F.ln, "floor": F.floor}


def lower(tree, names: dict[str, Column]) -> Column:
    """A nested list such as ["add", "x", ["mul", 2, "y"]] as a column; unknown operators raise."""
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if isinstance(tree, str):
        return names[tree]
    op, *args = tree
    args = [lower(a, names) for a in args]
    if op in _UNARY and len(args) == 1:
        return _UNARY[op](*args)
    if op in _BINARY and len(args) == 2:
        return _BINARY[op](*args)
    raise ValueError(f"no operator {op!r} of {len(args)} arguments")


# --- trait genomes ----------------------------------------------------------------------------------------------


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _unless_locked(old: Column, new: Column, locked: list[bool]) -> Column:
    """``new`` where the trait is free; without ``locked`` all traits are."""
    if not any(locked):
        return new
    fixed = F.array(*[F.lit(x) for x in locked])
    return F.zip_with(F.arrays_zip(old.alias("o"), new.alias("n")), fixed, lambda x, f: F.when(f, x["o"]).otherwise(x["n"]))


def mutate(position: Column, rate: float, noise: Column, locked: list[bool] = ()) -> Column:
    """Number traits moved by ``rate`` times standard normal ``noise`` (one a trait) and kept in [0, 1]."""
    return _unless_locked(position, F.zip_with(position, noise, lambda p, g: _unit(p + rate * g)), locked)


def flip(enabled: Column, rate: float, draw: Column, locked: list[bool] = ()) -> Column:
    """On-off traits turned over where the uniform draw lies below ``rate``."""
    return _unless_locked(enabled, F.zip_with(enabled, draw, lambda e, u: F.when(u < rate, ~e).otherwise(e)), locked)


def marry(a: Column, b: Column, weight: Column, locked: list[bool] = ()) -> Column:
    """Number traits (or their velocities) blended by a weight of their own; locked ones are the first parent's."""
    mixed = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), weight.alias("t")), lambda x: x["a"] * (1 - x["t"]) + x["b"] * x["t"])
    return _unless_locked(a, mixed, locked)


def inherit(a: Column, b: Column, draw: Column, locked: list[bool] = ()) -> Column:
    """On-off traits of one parent or the other, by the toss of a coin."""
    either = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), draw.alias("u")), lambda x: F.when(x["u"] < 0.5, x["a"]).otherwise(x["b"]))
    return _unless_locked(a, either, locked)


def steer(velocity: Column, direction: Column, amount: float, locked: list[bool] = ()) -> Column:
    return _unless_locked(velocity, F.zip_with(velocity, direction, lambda v, d: v + d * amount), locked)


def toward(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: y - x)


def advance(position: Column, velocity: Column, dt: float, damping: float, locked: list[bool] = ()) -> tuple[Column, Column]:
    """Position and velocity a step later: a trait bounces off the walls of [0, 1], and its velocity decays."""
    free = F.zip_with(position, velocity, lambda p, v: p + v * dt)
    moved = F.transform(free, lambda p: _unit(F.when(p < 0, -p).when(p > 1, 2 - p).otherwise(p)))
    turned = F.zip_with(free, velocity, lambda p, v: F.when((p < 0) | (p > 1), -v).otherwise(v) * damping)
    return _unless_locked(position, moved, locked), _unless_locked(velocity, turned, locked)


def decode(position: Column, low: list[float], high: list[float]) -> Column:
    """Traits in [0, 1] on their own scales."""
    scale = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(low, high, strict=True)])
    return F.zip_with(position, scale, lambda p, s: s["a"] + p * (s["b"] - s["a"]))


def mulberry32(seed: Column) -> Column:
    """One draw in [0, 1) of the public mulberry32 generator from a 32-bit seed, in 64-bit integer arithmetic."""
    m = F.lit(0xFFFFFFFF).cast("long")

    def imul(a: Column, b: Column) -> Column:
        low, high = b.bitwiseAND(F.lit(0xFFFF).cast("long")), F.shiftright(b, 16)
        return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)).bitwiseAND(m)

    a = (seed + 0x6D2B79F5).bitwiseAND(m)
    t = imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(m))
    return t.bitwiseXOR(F.shiftright(t, 14)).bitwiseAND(m).cast("double") / 4294967296.0


def gaussian(u: Column, v: Column) -> Column:
    """Box-Muller, cosine branch, of two uniform draws."""
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * pi * v)
