"""Orientations of cells and features: segmentation, averages, misorientations between neighbors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.orientation import SYMMETRY, c_axis, misorientation
from gridloom.grid import Grid
from gridloom.operators.segment import segment


def _split(cells: DataFrame, quats: str) -> tuple[DataFrame, list[str]]:
    names = [f"_q{i}" for i in range(4)]
    return cells.withColumns({n: F.col(quats)[i].cast("double") for i, n in enumerate(names)}), names


def _angles(a: list[np.ndarray], b: list[np.ndarray], symmetry: str) -> np.ndarray:
    """Misorientation angles of arrays of quaternions, the least over the symmetry."""
    ax, ay, az, aw = a
    bx, by, bz, bw = (-b[0], -b[1], -b[2], b[3])
    d = (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)
    best = np.zeros_like(d[3], dtype=float)
    for sx, sy, sz, sw in SYMMETRY[symmetry]():
        best = np.maximum(best, np.abs(sw * d[3] - sx * d[0] - sy * d[1] - sz * d[2]))
    return 2 * np.arccos(np.minimum(best, 1.0))


def misorientation_segment(cells: DataFrame, grid: Grid, quats: str, tolerance: float, symmetry: str = "cubic", phase: str | None = None, mask: str | None = None, name: str = "fid", tile: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """Face neighbors of one phase whose misorientation is below the tolerance, in radians, belong together."""
    wide, names = _split(cells, quats)

    def similar(a, b):
        same = a[phase] == b[phase] if phase else True
        return same & (_angles([a[n] for n in names], [b[n] for n in names], symmetry) < tolerance)

    return segment(wide, grid, [*names, *([phase] if phase else [])], similar, mask, tile, name).drop(*names)


def c_axis_segment(cells: DataFrame, grid: Grid, quats: str, tolerance: float, phase: str | None = None, mask: str | None = None, name: str = "fid") -> DataFrame:
    """Face neighbors whose crystal z axes are within the tolerance, either way round, belong together."""
    names = [f"_c{i}" for i in range(3)]
    wide = cells.withColumn("_axis", c_axis(F.col(quats)))
    wide = wide.withColumns({n: F.col("_axis")[i] for i, n in enumerate(names)}).drop("_axis")

    def similar(a, b):
        angle = np.arccos(np.clip(sum(a[n] * b[n] for n in names), -1, 1))
        return (a[phase] == b[phase] if phase else True) & ((angle <= tolerance) | (np.pi - angle <= tolerance))

    return segment(wide, grid, [*names, *([phase] if phase else [])], similar, mask, name=name).drop(*names)


def average_orientations(cells: DataFrame, quats: str, symmetry: str = "cubic", feature: str = "fid") -> DataFrame:
    """(feature, quats): the mean quaternion of each feature above 0. Every quaternion is first turned to the equivalent
    nearest to that of the feature's first cell, so the sum doesn't depend on the order of cells."""
    some = cells.where(F.col(feature) > 0)
    first = some.groupBy(feature).agg(F.min_by(quats, "idx").alias("_f"))
    turns = F.array(*(F.array(*map(F.lit, s)) for s in SYMMETRY[symmetry]()))

    def product(s: Column, q: Column) -> Column:
        sx, sy, sz, sw = (s[i] for i in range(4))
        return F.array(sw * q[0] + sx * q[3] + sy * q[2] - sz * q[1], sw * q[1] - sx * q[2] + sy * q[3] + sz * q[0], sw * q[2] + sx * q[1] - sy * q[0] + sz * q[3], sw * q[3] - sx * q[0] - sy * q[1] - sz * q[2])

    def scored(o: Column) -> Column:
        dot = sum((o[i] * F.col("_f")[i] for i in range(1, 4)), o[0] * F.col("_f")[0])
        return F.struct(F.abs(dot).alias("w"), F.transform(o, lambda c: F.when(dot < 0, -c).otherwise(c)).alias("q"))

    near = F.array_max(F.transform(turns, lambda s: F.transform(F.array(product(s, F.col(quats))), scored)[0]))["q"]
    turned = some.join(first, feature).withColumn("_n", near)
    sums = turned.groupBy(feature).agg(*(F.sum(F.col("_n")[i]).alias(f"_s{i}") for i in range(4)))
    size = F.sqrt(sum((F.col(f"_s{i}") ** 2 for i in range(1, 4)), F.col("_s0") ** 2))
    return sums.select(feature, F.array(*(F.col(f"_s{i}") / size for i in range(4))).alias(quats))


def average_c_axes(cells: DataFrame, quats: str, hexagonal: str, feature: str = "fid") -> DataFrame:
    """(feature, c_axis): mean crystal z axis of the hexagonal cells, each turned to the side of the feature's first one;
    a feature with another cell gets NaN."""
    some = cells.where(F.col(feature) > 0).withColumn("_a", c_axis(F.col(quats)))
    first = some.groupBy(feature).agg(F.min_by("_a", "idx").alias("_f"), F.min(F.col(hexagonal).cast("int")).alias("_h"))
    dot = sum((F.col("_a")[i] * F.col("_f")[i] for i in range(1, 3)), F.col("_a")[0] * F.col("_f")[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    sums = some.join(first, feature).groupBy(feature).agg(F.min("_h").alias("_h"), *(F.sum(sign * F.col("_a")[i]).alias(f"_s{i}") for i in range(3)))
    size = F.sqrt(F.col("_s0") ** 2 + F.col("_s1") ** 2 + F.col("_s2") ** 2)
    return sums.select(feature, F.array(*(F.when(F.col("_h") == 1, F.col(f"_s{i}") / size).otherwise(math.nan) for i in range(3))).alias("c_axis"))


def neighbor_misorientations(features: DataFrame, neighbors: DataFrame, quats: str, symmetry: str = "cubic", feature: str = "fid") -> DataFrame:
    """(feature, misorientations, average): degrees to each neighbor in the order of the list."""
    pairs = neighbors.select(feature, F.posexplode("neighbors").alias("_p", "_n"))
    a = features.select(feature, F.col(quats).alias("_a"))
    b = features.select(F.col(feature).alias("_n"), F.col(quats).alias("_b"))
    angle = F.degrees(misorientation(F.col("_a"), F.col("_b"), symmetry))
    listed = pairs.join(a, feature).join(b, "_n").groupBy(feature).agg(F.sort_array(F.collect_list(F.struct("_p", angle.alias("m")))).alias("_l"))
    values = F.col("_l.m")
    return listed.select(feature, values.alias("misorientations"), (F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).alias("average"))


def merge_twins(features: DataFrame, neighbors: DataFrame, quats: str, axis_tolerance: float = 3.0, angle_tolerance: float = 2.0, phase: str | None = None, feature: str = "fid") -> DataFrame:
    """Parents of cubic features: neighbors a turn of 60 degrees about a <111> axis apart, within tolerances in degrees."""
    from gridloom.operators.segment import group_features

    pairs = neighbors.select(feature, F.explode("neighbors").alias("other")).where(F.col(feature) < F.col("other"))
    more = [phase] if phase else []
    a = features.select(feature, F.col(quats).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in more))
    b = features.select(F.col(feature).alias("other"), F.col(quats).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in more))
    met = pairs.join(a, feature).join(b, "other")
    if phase:
        met = met.where(F.col(f"_a_{phase}") == F.col(f"_b_{phase}"))
    turns = np.array(SYMMETRY["cubic"]())

    def twin(frames):
        for f in frames:
            keep = []
            for qa, qb in zip(f["_a"], f["_b"]):
                qb = np.array([-qb[0], -qb[1], -qb[2], qb[3]])
                x, y, z, w = qa
                d = np.array([w * qb[0] + x * qb[3] + y * qb[2] - z * qb[1], w * qb[1] - x * qb[2] + y * qb[3] + z * qb[0], w * qb[2] + x * qb[1] - y * qb[0] + z * qb[3], w * qb[3] - x * qb[0] - y * qb[1] - z * qb[2]])
                vec = turns[:, 3:] * d[:3] + d[3] * turns[:, :3] + np.cross(turns[:, :3], d[:3])
                scalar = turns[:, 3] * d[3] - turns[:, :3] @ d[:3]
                angle = np.degrees(2 * np.arccos(np.minimum(np.abs(scalar), 1)))
                size = np.linalg.norm(vec, axis=1)
                axis = np.divide(np.abs(vec), size[:, None], out=np.zeros_like(vec), where=size[:, None] > 0)
                off = np.degrees(np.arccos(np.clip(axis.sum(axis=1) / math.sqrt(3), -1, 1)))
                keep.append(bool(((np.abs(angle - 60) < angle_tolerance) & (off < axis_tolerance)).any()))
            yield f.loc[keep, [feature, "other"]]

    kind = dict(features.dtypes)[feature]
    return group_features(features, met.mapInPandas(twin, f"{feature} {kind}, other {kind}"), feature)
