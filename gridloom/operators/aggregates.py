"""Statistics of columns and of features: partial aggregation over cells, one row a feature.

Feature 0 means none; operators that skip it say so. Where the last cell of a feature decides, the cell of greatest idx does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, face_pairs

THIRD = 1.0 / 3.0


def array_histogram(df: DataFrame, columns: list[str], bins: int, low: float | None = None, high: float | None = None, mask: str | None = None) -> DataFrame:
    """(name, bin, bin_min, bin_max, count, overflow) with every bin; a range that isn't given is min to max plus 1."""
    rows = df.where(F.col(mask).cast("boolean")) if mask else df
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("s.*")
    lo = F.lit(float(low)) if low is not None else F.min("v")
    hi = F.lit(float(high)) if high is not None else F.max("v") + 1
    ranges = long.groupBy("name").agg(lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = long.join(F.broadcast(ranges), "name").withColumn("bin", F.floor((F.col("v") - F.col("lo")) / width).cast("int"))
    inside = F.col("bin").between(0, bins - 1)
    counts = binned.groupBy("name", F.when(inside, F.col("bin")).otherwise(-1).alias("bin")).count()
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    over = counts.where("bin = -1").select("name", F.col("count").alias("overflow"))
    out = frame.join(counts, ["name", "bin"], "left").join(over, "name", "left")
    return out.select("name", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_min"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_max"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("overflow", F.lit(0)).cast("long").alias("overflow"))


def array_statistics(df: DataFrame, column: str, by: str | None = None, mask: str | None = None, modes: bool = True) -> DataFrame:
    """length, min, max, mean, median, stddev (population), sum, n_unique, modes (sorted list); whole or by feature.

    Median, modes and distinct values come from counts of distinct values, so a group's rows never meet in one task.
    """
    rows = df.where(F.col(mask).cast("boolean")) if mask else df
    keys = [by] if by else []
    counts = rows.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    v = F.col("v").cast("double")
    plain = counts.groupBy(*keys).agg(
        F.sum("n").alias("length"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum(v * F.col("n")).alias("sum"),
        F.count("v").alias("n_unique"), F.max("n").alias("_top"),
    )
    mean = plain.select(*keys, (F.col("sum") / F.col("length")).alias("mean"), "_top", "length")
    joined = counts.join(mean, keys) if keys else counts.crossJoin(F.broadcast(mean))
    spread = joined.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("n") * (v - F.col("mean")) ** 2) / F.sum("n")).alias("stddev"),
        F.sort_array(F.collect_list(F.when((F.col("n") == F.col("_top")) & F.lit(modes), F.col("v")))).alias("modes"),
        F.expr("percentile(v, 0.5D, n)").alias("median"),
    )
    out = plain.withColumn("mean", F.col("sum") / F.col("length"))
    out = out.join(spread, keys) if keys else out.crossJoin(F.broadcast(spread))
    return out.select(*keys, "length", "min", "max", "mean", "median", "stddev", "sum", "n_unique", "modes")


def modal_bins(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """The fullest bins' ranges of a histogram over each group's own range."""
    keys = [by] if by else []
    lim = df.groupBy(*keys).agg(F.min(column).cast("double").alias("lo"), (F.max(column) + 1).cast("double").alias("hi"))
    joined = df.join(lim, keys) if keys else df.crossJoin(F.broadcast(lim))
    width = (F.col("hi") - F.col("lo")) / bins
    counts = joined.groupBy(*keys, "lo", "hi", F.floor((F.col(column) - F.col("lo")) / width).cast("int").alias("bin")).count()
    best = counts.groupBy(*keys).agg(F.max("count").alias("_top"))
    top = (counts.join(best, keys) if keys else counts.crossJoin(F.broadcast(best))).where("count = _top")
    return top.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_min"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_max"), "count")


def standardize(df: DataFrame, column: str, by: str | None = None, name: str | None = None) -> DataFrame:
    """(value - mean) / population deviation, of the whole column or of each group."""
    keys = [by] if by else []
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(name or f"{column}_standardized", (F.col(column) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def list_statistics(column: str) -> dict[str, Column]:
    """Columns of each row's list: length, min, max, mean, median, stddev (population), sum; 0 for an empty list."""
    c = F.col(column)
    n = F.size(c)
    zero = lambda x: F.when(n > 0, x).otherwise(0.0)
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = total / n
    spread = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - mean) ** 2) / n)
    ordered = F.sort_array(c)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0
    return {"length": n.cast("long"), "min": zero(F.array_min(c)), "max": zero(F.array_max(c)), "mean": zero(mean), "median": zero(middle), "stddev": zero(spread), "sum": zero(total)}


def feature_sizes(cells: DataFrame, grid: Grid, feature: str = "fid") -> DataFrame:
    """cells, volume and equivalent diameter (circle on flat grids, sphere otherwise) of each feature but 0."""
    flat = sum(n == 1 for n in grid.dims) >= 1
    unit = 1.0
    for n, s in zip(grid.dims, grid.spacing):
        unit *= 1.0 if flat and n == 1 else s
    counts = cells.where(F.col(feature) > 0).groupBy(feature).agg(F.count("*").alias("num_elements"))
    volume = F.col("num_elements") * unit
    diameter = 2 * F.sqrt(volume / math.pi) if flat else 2 * F.pow(volume * 0.75 / math.pi, F.lit(THIRD))
    return counts.select(feature, "num_elements", volume.alias("volume"), diameter.alias("equivalent_diameter"))


def volume_fractions(cells: DataFrame, phase: str = "phase") -> DataFrame:
    """Share of all cells by phase, 0 included."""
    counts = cells.groupBy(phase).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(phase, (F.col("_n") / F.col("_t")).alias("volume_fraction"))


def num_features(features: DataFrame, phase: str = "phase", feature: str = "fid") -> DataFrame:
    return features.where(F.col(feature) > 0).groupBy(phase).agg(F.count("*").alias("num_features"))


def last_value(cells: DataFrame, value: str, feature: str = "fid", idx: str = "idx", name: str | None = None) -> DataFrame:
    """The value of each feature's last cell, and whether its cells disagree."""
    return cells.groupBy(feature).agg(F.max_by(value, idx).alias(name or value), (F.min(value) != F.max(value)).alias("disagrees"))


def feature_phases(cells: DataFrame, phase: str = "phase", feature: str = "fid") -> DataFrame:
    return last_value(cells, phase, feature)


def feature_phases_binary(cells: DataFrame, mask: str, feature: str = "fid") -> DataFrame:
    """Phase 1 for features whose last cell is in the mask, else 0."""
    return cells.groupBy(feature).agg(F.max_by(F.col(mask).cast("int"), "idx").alias("phase"))


def feature_centroids(cells: DataFrame, grid: Grid, feature: str = "fid") -> DataFrame:
    """Mean cell centre of each feature."""
    c = grid.with_xyz(cells)
    return c.groupBy(feature).agg(*(F.avg(grid.centre(k, F.col(a))).alias(f"centroid_{a}") for k, a in enumerate("xyz")))


def feature_rects(cells: DataFrame, grid: Grid, feature: str = "fid") -> DataFrame:
    """Bounds of each feature's cell coordinates, 0 skipped."""
    c = grid.with_xyz(cells.where(F.col(feature) > 0))
    return c.groupBy(feature).agg(*(f(a).alias(f"{a}_{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def boundary_fractions(cells: DataFrame, boundary: str, feature: str = "fid") -> DataFrame:
    """Share of each feature's cells with boundary above 0, feature 0 skipped."""
    return cells.where(F.col(feature) > 0).groupBy(feature).agg(F.avg((F.col(boundary) > 0).cast("double")).alias("boundary_fraction"))


def largest_cross_sections(cells: DataFrame, grid: Grid, plane: str = "xy", feature: str = "fid") -> DataFrame:
    """The largest area of a feature in any slice parallel to the plane."""
    normal = {"xy": "z", "xz": "y", "yz": "x"}[plane]
    area = math.prod(grid.spacing["xyz".index(a)] for a in plane)
    slices = grid.with_xyz(cells.where(F.col(feature) > 0)).groupBy(feature, normal).agg(F.count("*").alias("n"))
    return slices.groupBy(feature).agg((F.max("n") * area).alias("largest_cross_section"))


def _face_area(grid: Grid) -> Column:
    sx, sy, sz = grid.spacing
    return F.when(F.col("axis") == 0, sy * sz).when(F.col("axis") == 1, sx * sz).otherwise(sx * sy)


def surface_area_to_volume(cells: DataFrame, grid: Grid, feature: str = "fid", sphericity: bool = True) -> DataFrame:
    """Area of faces towards other features over volume, each face weighed by its own axis; sphericity."""
    faces = face_pairs(cells, grid, [feature]).where(F.col(f"a_{feature}") != F.col(f"b_{feature}")).withColumn("area", _face_area(grid))
    sides = faces.select(F.explode(F.array(f"a_{feature}", f"b_{feature}")).alias(feature), "area").where(F.col(feature) > 0)
    area = sides.groupBy(feature).agg(F.sum("area").alias("_area"))
    unit = math.prod(grid.spacing)
    sizes = cells.where(F.col(feature) > 0).groupBy(feature).agg((F.count("*") * unit).alias("_volume"))
    out = sizes.join(area, feature, "left").withColumn("_area", F.coalesce("_area", F.lit(0.0)))
    columns = [feature, (F.col("_area") / F.col("_volume")).alias("surface_area_volume_ratio")]
    if sphericity:
        columns.append((F.pow(F.lit(math.pi), F.lit(THIRD)) * F.pow(6 * F.col("_volume"), F.lit(2 * THIRD)) / F.col("_area")).alias("sphericity"))
    return out.select(*columns)


def relabel_components(cells: DataFrame, feature: str = "fid", minimum: int = 0) -> DataFrame:
    """Labels 1.. by descending size (ties by old label); 0 stays, labels below the minimum size become 0."""
    sizes = cells.where(F.col(feature) > 0).groupBy(feature).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    new = sizes.select(feature, F.row_number().over(Window.orderBy(F.desc("_n"), feature)).alias("_new"))
    return cells.join(new, feature, "left").withColumn(feature, F.coalesce("_new", F.lit(0))).drop("_new").select(*cells.columns)


def project(cells: DataFrame, grid: Grid, value: str, axis: str, how: str, foreground=1) -> DataFrame:
    """One row for each line of cells along an axis: max, min, mean, sum, stddev, median or binary (any foreground)."""
    rest = [a for a in "xyz" if a != axis]
    f = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "stddev": F.stddev_samp, "median": F.median, "binary": lambda c: F.max((F.col(c) == foreground).cast("int"))}[how]
    return grid.with_xyz(cells).groupBy(*rest).agg(f(value).alias(value))


def shapes(cells: DataFrame, grid: Grid, feature: str = "fid") -> DataFrame:
    """Second moments about the centroid (a cell counts as eight points a quarter off its centre), axis lengths of the
    ellipsoid of the same moments, aspect ratios, and omega3 capped at 1."""
    centre = feature_centroids(cells, grid, feature)
    c = grid.with_xyz(cells.where(F.col(feature) > 0)).join(centre, feature)
    d = {a: grid.centre(k, F.col(a)) - F.col(f"centroid_{a}") for k, a in enumerate("xyz")}
    quarter = {a: (s / 4) ** 2 for a, s in zip("xyz", grid.spacing)}
    unit = math.prod(grid.spacing)
    moment = {a: F.sum(d[a] ** 2 + quarter[a]) * unit for a in "xyz"}
    cross = {p: F.sum(d[p[0]] * d[p[1]]) * unit for p in ("xy", "yz", "xz")}
    m = c.groupBy(feature).agg((F.count("*") * unit).alias("volume"), *(moment[a].alias(f"m_{a}{a}") for a in "xyz"), *(cross[p].alias(f"m_{p}") for p in cross))

    def axes(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            t = np.empty((len(f), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    t[:, i, j] = f["m_" + "".join(sorted(a + b))]
            values = np.linalg.eigvalsh(t)[:, ::-1]
            volume = f["volume"].to_numpy()
            half = np.sqrt(np.maximum(5 * values / volume[:, None], 0))
            det = np.linalg.det(t)
            with np.errstate(divide="ignore", invalid="ignore"):
                omega = np.minimum(volume**5 / det / (2000 * np.pi**2 / 9), 1.0)
                out = {feature: f[feature], "axis_a": half[:, 0], "axis_b": half[:, 1], "axis_c": half[:, 2], "b_over_a": half[:, 1] / half[:, 0], "c_over_a": half[:, 2] / half[:, 0], "omega3": omega, "volume": volume}
            yield pd.DataFrame(out)

    kind = dict(cells.dtypes)[feature]
    return m.mapInPandas(axes, f"{feature} {kind}, axis_a double, axis_b double, axis_c double, b_over_a double, c_over_a double, omega3 double, volume double")


def moment_invariants(cells: DataFrame, grid: Grid, feature: str = "fid") -> DataFrame:
    """(feature, mass, m20, m02, m11, omega1, omega2) of flat features: central moments of the feature's cells as unit
    squares, and the two invariants of their size."""
    c = grid.with_xyz(cells.where(F.col(feature) > 0))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = c.groupBy(feature).agg(F.count("*").cast("double").alias("mass"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("vxy"))
    n = F.col("mass")
    m = m.select(feature, "mass", (n * (F.col("vx") + 1 / 12)).alias("m20"), (n * (F.col("vy") + 1 / 12)).alias("m02"), (n * F.col("vxy")).alias("m11"))
    m20, m02, m11 = F.col("m20"), F.col("m02"), F.col("m11")
    return m.withColumns({"omega1": 2 * n * n / (m20 + m02), "omega2": n**4 / (m20 * m02 - m11 * m11)})
