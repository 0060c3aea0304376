"""Orientations as Column expressions: conversions between representations, and what follows from them.

Angles are radians. Euler angles follow the Bunge (z, x, z) convention, matrices are passive 3x3 rows as nine numbers,
quaternions are (x, y, z, w), axis-angle is (x, y, z, angle), Rodrigues is (x, y, z, tan(angle / 2)). Every conversion goes
through quaternions.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

REPRESENTATIONS = ("euler", "matrix", "quaternion", "axis_angle", "rodrigues", "homochoric", "stereographic")
_EPS = 1e-12


def _let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's variable stands for it, so nested conversions don't multiply."""
    return F.transform(F.array(value), f)[0]


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def euler_to_quaternion(e: Column) -> Column:
    half, plus, minus = 0.5 * e[1], 0.5 * (e[0] + e[2]), 0.5 * (e[0] - e[2])
    w = F.cos(half) * F.cos(plus)
    q = [-F.sin(half) * F.cos(minus), -F.sin(half) * F.sin(minus), -F.cos(half) * F.sin(plus), w]
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    return F.array(*(sign * c for c in q))


def quaternion_to_euler(q: Column) -> Column:
    a, b = q[3] ** 2 + q[2] ** 2, q[0] ** 2 + q[1] ** 2
    chi = F.sqrt(a * b)
    flat = F.when(b < _EPS, F.atan2(-2 * q[3] * q[2], q[3] ** 2 - q[2] ** 2)).otherwise(F.atan2(2 * q[0] * q[1], q[0] ** 2 - q[1] ** 2))
    first = F.when(chi < _EPS, flat).otherwise(F.atan2((q[0] * q[2] - q[3] * q[1]) / chi, (-q[3] * q[0] - q[1] * q[2]) / chi))
    middle = F.when(b < _EPS, 0.0).when(a < _EPS, math.pi).otherwise(F.atan2(2 * chi, a - b))
    last = F.when(chi < _EPS, 0.0).otherwise(F.atan2((q[3] * q[1] + q[0] * q[2]) / chi, (q[1] * q[2] - q[3] * q[0]) / chi))
    return F.array(F.pmod(first, F.lit(2 * math.pi)), middle, F.pmod(last, F.lit(2 * math.pi)))


def quaternion_to_matrix(q: Column) -> Column:
    x, y, z, w = (q[i] for i in range(4))
    bar = w * w - (x * x + y * y + z * z)
    return F.array(
        bar + 2 * x * x, 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), bar + 2 * y * y, 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), bar + 2 * z * z,
    )


def matrix_to_quaternion(m: Column) -> Column:
    part = lambda c: 0.5 * F.sqrt(F.greatest(c, F.lit(0.0)))
    w = part(1 + m[0] + m[4] + m[8])
    x = F.when(m[7] < m[5], -1.0).otherwise(1.0) * part(1 + m[0] - m[4] - m[8])
    y = F.when(m[2] < m[6], -1.0).otherwise(1.0) * part(1 - m[0] + m[4] - m[8])
    z = F.when(m[3] < m[1], -1.0).otherwise(1.0) * part(1 - m[0] - m[4] + m[8])
    size = F.sqrt(x * x + y * y + z * z + w * w)
    return F.array(x / size, y / size, z / size, w / size)


def quaternion_to_axis_angle(q: Column) -> Column:
    angle = 2 * F.acos(_clip(q[3]))
    size = F.sqrt(q[0] ** 2 + q[1] ** 2 + q[2] ** 2)
    none = size < _EPS
    return F.array(*(F.when(none, float(i == 2)).otherwise(q[i] / size) for i in range(3)), F.when(none, 0.0).otherwise(angle))


def axis_angle_to_quaternion(a: Column) -> Column:
    s = F.sin(a[3] / 2)
    return F.array(a[0] * s, a[1] * s, a[2] * s, F.cos(a[3] / 2))


def axis_angle_to_rodrigues(a: Column) -> Column:
    return F.array(a[0], a[1], a[2], F.when(F.abs(a[3] - math.pi) < _EPS, math.inf).otherwise(F.tan(a[3] / 2)))


def rodrigues_to_axis_angle(r: Column) -> Column:
    return F.array(r[0], r[1], r[2], 2 * F.atan(r[3]))


def axis_angle_to_homochoric(a: Column) -> Column:
    f = F.pow(0.75 * F.greatest(a[3] - F.sin(a[3]), F.lit(0.0)), F.lit(1 / 3))
    return F.array(a[0] * f, a[1] * f, a[2] * f)


def homochoric_to_axis_angle(h: Column) -> Column:
    """The angle by Newton's iteration for angle - sin(angle) = 4/3 |h|^3."""
    size = F.sqrt(h[0] ** 2 + h[1] ** 2 + h[2] ** 2)
    want = size**3 * (4 / 3)
    guess = F.least(F.pow(6 * want, F.lit(1 / 3)), F.lit(math.pi))
    start = F.struct(guess.alias("t"), want.alias("w"))
    step = lambda acc, _: F.struct((acc["t"] - F.when(acc["t"] < 1e-9, 0.0).otherwise((acc["t"] - F.sin(acc["t"]) - acc["w"]) / F.greatest(1 - F.cos(acc["t"]), F.lit(_EPS)))).alias("t"), acc["w"].alias("w"))
    angle = F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)["t"]
    none = size < _EPS
    return F.array(*(F.when(none, float(i == 2)).otherwise(h[i] / size) for i in range(3)), F.when(none, 0.0).otherwise(angle))


def axis_angle_to_stereographic(a: Column) -> Column:
    t = F.tan(a[3] / 4)
    return F.array(a[0] * t, a[1] * t, a[2] * t)


def stereographic_to_axis_angle(s: Column) -> Column:
    size = F.sqrt(s[0] ** 2 + s[1] ** 2 + s[2] ** 2)
    none = size < _EPS
    return F.array(*(F.when(none, float(i == 2)).otherwise(s[i] / size) for i in range(3)), F.when(none, 0.0).otherwise(4 * F.atan(size)))


_TO_QUATERNION = {
    "quaternion": lambda v: v,
    "euler": euler_to_quaternion,
    "matrix": matrix_to_quaternion,
    "axis_angle": axis_angle_to_quaternion,
    "rodrigues": lambda v: _let(rodrigues_to_axis_angle(v), axis_angle_to_quaternion),
    "homochoric": lambda v: _let(homochoric_to_axis_angle(v), axis_angle_to_quaternion),
    "stereographic": lambda v: _let(stereographic_to_axis_angle(v), axis_angle_to_quaternion),
}
_FROM_QUATERNION = {
    "quaternion": lambda q: q,
    "euler": quaternion_to_euler,
    "matrix": quaternion_to_matrix,
    "axis_angle": quaternion_to_axis_angle,
    "rodrigues": lambda q: _let(quaternion_to_axis_angle(q), axis_angle_to_rodrigues),
    "homochoric": lambda q: _let(quaternion_to_axis_angle(q), axis_angle_to_homochoric),
    "stereographic": lambda q: _let(quaternion_to_axis_angle(q), axis_angle_to_stereographic),
}


def convert(v: Column, source: str, to: str) -> Column:
    """A representation as another one."""
    if source not in _TO_QUATERNION or to not in _FROM_QUATERNION:
        raise ValueError(f"no conversion from {source!r} to {to!r}")
    if source == to:
        return v
    return _let(_let(v, _TO_QUATERNION[source]), _FROM_QUATERNION[to])


def reorder_quaternion(q: Column, to: str = "scalar_vector") -> Column:
    """(x, y, z, w) to (w, x, y, z), or back."""
    order = (3, 0, 1, 2) if to == "scalar_vector" else (1, 2, 3, 0)
    return F.array(*(q[i] for i in order))


def conjugate(q: Column) -> Column:
    """The conjugate of (x, y, z, w)."""
    return F.array(0 - q[0], 0 - q[1], 0 - q[2], q[3])


def rodrigues_convertor(r: Column) -> Column:
    """A vector of three as direction and length; no length gives NaN."""
    size = F.sqrt(r[0] ** 2 + r[1] ** 2 + r[2] ** 2)
    return F.array(*(F.when(size > 0, r[i] / size).otherwise(math.nan) for i in range(3)), size)


def multiply(a: Column, b: Column) -> Column:
    """Quaternion product a b."""
    ax, ay, az, aw = (a[i] for i in range(4))
    bx, by, bz, bw = (b[i] for i in range(4))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def cubic_symmetry() -> list[tuple[float, float, float, float]]:
    """The 24 rotations of a cube, from their generation by quarter turns about z and third turns about the diagonal."""
    h = math.sqrt(0.5)
    turn, third = (0.0, 0.0, h, h), (0.5, 0.5, 0.5, 0.5)
    flip = (h, 0.0, 0.0, h)
    return _group([turn, third, flip])


def hexagonal_symmetry() -> list[tuple[float, float, float, float]]:
    """The 12 rotations of a hexagonal prism."""
    return _group([(0.0, 0.0, 0.5, math.sqrt(0.75)), (1.0, 0.0, 0.0, 0.0)])


def _group(generators) -> list[tuple[float, float, float, float]]:
    def times(a, b):
        ax, ay, az, aw = a
        bx, by, bz, bw = b
        return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)

    def key(q):
        q = [round(c, 6) + 0.0 for c in q]
        lead = next(c for c in reversed(q) if c)
        return tuple(c if lead > 0 else -c + 0.0 for c in q)

    found = {key((0.0, 0.0, 0.0, 1.0)): (0.0, 0.0, 0.0, 1.0)}
    todo = list(found.values())
    while todo:
        q = todo.pop()
        for g in generators:
            new = times(g, q)
            if key(new) not in found:
                found[key(new)] = new
                todo.append(new)
    return [found[k] for k in sorted(found)]


SYMMETRY = {"cubic": cubic_symmetry, "hexagonal": hexagonal_symmetry, "triclinic": lambda: [(0.0, 0.0, 0.0, 1.0)]}


def fundamental_zone(q: Column, symmetry: str) -> Column:
    """The equivalent quaternion of least angle, its scalar part not negative."""
    turns = F.array(*(F.array(*map(F.lit, s)) for s in SYMMETRY[symmetry]()))

    def least(q: Column) -> Column:
        options = F.transform(turns, lambda s, i: _let(multiply(s, q), lambda o: F.struct(F.round(F.abs(o[3]), 12).alias("w"), (-i).alias("i"), o.alias("q"))))
        return _let(F.array_max(options)["q"], lambda o: F.transform(o, lambda c: F.when(o[3] < 0, -c).otherwise(c)))

    return _let(q, least)


def misorientation(a: Column, b: Column, symmetry: str) -> Column:
    """The least angle, in radians, between two orientations under the symmetry."""
    turns = F.array(*(F.array(*map(F.lit, s)) for s in SYMMETRY[symmetry]()))
    inverse = _let(b, lambda b: F.array(-b[0], -b[1], -b[2], b[3]))
    between = _let(a, lambda a: _let(inverse, lambda i: multiply(a, i)))
    best = _let(between, lambda q: F.array_max(F.transform(turns, lambda s: F.abs(multiply(s, q)[3]))))
    return 2 * F.acos(F.least(best, F.lit(1.0)))


def c_axis(q: Column) -> Column:
    """The crystal's z axis in the sample's frame, turned to the upper hemisphere."""
    axis = _let(_let(q, quaternion_to_matrix), lambda m: F.array(m[6], m[7], m[8]))
    return _let(axis, lambda v: F.transform(v, lambda c: F.when(v[2] < 0, -c).otherwise(c)))


def cubic_ipf_color(q: Column, direction: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> Column:
    """Red, green, blue, 0 to 255, of a sample direction in the standard triangle of a cubic crystal: red at 001,
    green at 011, blue at 111."""
    size = math.sqrt(sum(c * c for c in direction))
    unit = [c / size for c in direction]
    crystal = _let(_let(q, quaternion_to_matrix), lambda m: F.sort_array(F.array(*(F.abs(m[3 * i] * unit[0] + m[3 * i + 1] * unit[1] + m[3 * i + 2] * unit[2]) for i in range(3)))))

    def color(v: Column) -> Column:
        eta, chi = F.atan2(v[0], v[1]), F.acos(F.least(v[2], F.lit(1.0)))
        return _let(F.array(eta / (math.pi / 4), chi / F.acos(F.sqrt(1 / (2 + F.tan(eta) ** 2)))), parts)

    def parts(p: Column) -> Column:
        depth = F.least(p[1], F.lit(1.0))
        made = F.transform(F.array(1 - depth, (1 - p[0]) * depth, p[0] * depth), lambda c: F.sqrt(F.greatest(c, F.lit(0.0))))
        return _let(made, lambda c: F.transform(c, lambda x: F.floor(255 * x / F.array_max(c) + 1e-9).cast("int")))

    return _let(crystal, color)


def rotate_euler_frame(e: Column, axis: tuple[float, float, float], angle: float) -> Column:
    """Euler angles after a turn of the reference frame."""
    size = math.sqrt(sum(a * a for a in axis))
    s = math.sin(angle / 2)
    turn = F.array(*(F.lit(a / size * s) for a in axis), F.lit(math.cos(angle / 2)))
    return _let(_let(_let(e, euler_to_quaternion), lambda q: multiply(q, turn)), quaternion_to_euler)


def schmid_factor(q: Column, loading: tuple[float, float, float], plane: tuple[int, int, int], direction: tuple[int, int, int]) -> Column:
    """|cos(loading, plane) cos(loading, direction)| in the crystal's frame, the largest over the cubic equivalents."""
    size = math.sqrt(sum(c * c for c in loading))
    unit = [c / size for c in loading]
    load = _let(_let(q, quaternion_to_matrix), lambda m: F.array(*(m[3 * i] * unit[0] + m[3 * i + 1] * unit[1] + m[3 * i + 2] * unit[2] for i in range(3))))

    def forms(v):
        made = {tuple(s * c for s, c in zip(signs, p)) for p in itertools.permutations(v) for signs in itertools.product((1, -1), repeat=3)}
        return sorted(made)

    pairs = [(a, b) for a in forms(plane) for b in forms(direction) if sum(x * y for x, y in zip(a, b)) == 0 and a > tuple(-x for x in a) and b > tuple(-x for x in b)]
    na, nb = math.sqrt(sum(c * c for c in plane)), math.sqrt(sum(c * c for c in direction))

    def best(v: Column) -> Column:
        dot = lambda a, n: v[0] * (a[0] / n) + v[1] * (a[1] / n) + v[2] * (a[2] / n)
        return F.greatest(*(F.abs(dot(a, na) * dot(b, nb)) for a, b in pairs))

    return _let(load, best)
