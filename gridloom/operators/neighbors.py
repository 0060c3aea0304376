"""Gathers and neighborhoods: features to cells, features that touch, points to cells, grids to grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, face_pairs
from gridloom.operators.aggregates import _face_area
from gridloom.operators.pairs import chunks, map_pairs
from gridloom.session import cut


def copy_feature_to_element(cells: DataFrame, features: DataFrame, values: list[str], feature: str = "fid") -> DataFrame:
    """Each cell with its feature's values; a cell whose feature has no row is an error of the tables and gets nulls."""
    return cells.join(features.select(feature, *values), feature, "left").select(*cells.columns, *values)


def feature_neighbors(cells: DataFrame, grid: Grid, feature: str = "fid") -> DataFrame:
    """neighbors (sorted), num_neighbors, shared areas in the same order; features above 0 only."""
    faces = face_pairs(cells, grid, [feature]).where((F.col(f"a_{feature}") != F.col(f"b_{feature}")) & (F.col(f"a_{feature}") > 0) & (F.col(f"b_{feature}") > 0))
    faces = faces.withColumn("area", _face_area(grid))
    both = faces.select(F.explode(F.array(F.struct(F.col(f"a_{feature}").alias("f"), F.col(f"b_{feature}").alias("n")), F.struct(F.col(f"b_{feature}").alias("f"), F.col(f"a_{feature}").alias("n")))).alias("s"), "area")
    pairs = both.groupBy(F.col("s.f").alias(feature), F.col("s.n").alias("_n")).agg(F.sum("area").alias("_a"))
    listed = pairs.groupBy(feature).agg(F.sort_array(F.collect_list(F.struct("_n", "_a"))).alias("_l"))
    return listed.select(feature, F.col("_l._n").alias("neighbors"), F.size("_l").cast("long").alias("num_neighbors"), F.col("_l._a").alias("shared_areas"))


def boundary_cells(cells: DataFrame, grid: Grid, feature: str = "fid", ignore_zero: bool = True) -> DataFrame:
    """(idx, boundary): number of face neighbors in other features (0 aside if ignored)."""
    faces = face_pairs(cells, grid, [feature]).where(F.col(f"a_{feature}") != F.col(f"b_{feature}"))
    if ignore_zero:
        faces = faces.where((F.col(f"a_{feature}") > 0) & (F.col(f"b_{feature}") > 0))
    step = F.when(F.col("axis") == 0, 1).when(F.col("axis") == 1, grid.dims[0]).otherwise(grid.dims[0] * grid.dims[1])
    counts = faces.select(F.explode(F.array(F.col("idx"), F.col("idx") + step)).alias("idx")).groupBy("idx").agg(F.count("*").alias("boundary"))
    return cells.select("idx").join(counts, "idx", "left").select("idx", F.coalesce("boundary", F.lit(0)).cast("long").alias("boundary"))


def surface_features(cells: DataFrame, grid: Grid, feature: str = "fid", mark_zero: bool = True) -> DataFrame:
    """(feature, surface): touches the outside, or feature 0 if marked; axes of one cell don't count."""
    c = grid.with_xyz(cells)
    edge = F.lit(False)
    for a, n in zip("xyz", grid.dims):
        if n > 1:
            edge = edge | (F.col(a) == 0) | (F.col(a) == n - 1)
    out = c.where(F.col(feature) > 0).groupBy(feature).agg(F.max(edge).alias("surface"))
    if not mark_zero:
        return out
    faces = face_pairs(cells, grid, [feature]).where(F.least(f"a_{feature}", f"b_{feature}") == 0)
    touching = faces.select(F.greatest(f"a_{feature}", f"b_{feature}").alias(feature)).where(F.col(feature) > 0).distinct()
    return out.join(touching.withColumn("_t", F.lit(True)), feature, "left").select(feature, (F.col("surface") | F.coalesce("_t", F.lit(False))).alias("surface"))


def neighborhoods(features: DataFrame, multiple: float, feature: str = "fid", centre: tuple[str, str, str] = ("centroid_x", "centroid_y", "centroid_z"), diameter: str = "equivalent_diameter") -> DataFrame:
    """Features whose centre is within a feature's diameter times multiple, by bins of the mean diameter on all axes.

    The mean divides by the number of features plus one. Bins are an equi-join on a coarse cell and its 26 neighbors.
    """
    mean = features.agg((F.sum(diameter) / (F.count("*") + 1)).alias("_mean"), F.max(diameter).alias("_most"), *(F.min(c).alias(f"_lo{k}") for k, c in enumerate(centre)))
    f = features.crossJoin(F.broadcast(mean))
    f = f.withColumns({f"_b{k}": F.floor((F.col(c) - F.col(f"_lo{k}")) / F.col("_mean")) for k, c in enumerate(centre)})
    reach = F.floor(F.col(diameter) * multiple / F.col("_mean"))
    span = F.greatest(F.lit(1), F.floor(F.col("_most") * multiple / F.col("_mean")))
    coarse = lambda k: F.floor(F.col(f"_b{k}") / span)
    mine = f.select(F.col(feature), reach.alias("_r"), *(F.col(f"_b{k}") for k in range(3)), *(F.explode(F.array(coarse(k) - 1, coarse(k), coarse(k) + 1)).alias(f"_c{k}") if k == 0 else coarse(k).alias(f"_c{k}") for k in range(3)))
    for k in (1, 2):
        mine = mine.withColumn(f"_c{k}", F.explode(F.array(F.col(f"_c{k}") - 1, F.col(f"_c{k}"), F.col(f"_c{k}") + 1)))
    other = f.select(F.col(feature).alias("_o"), *(F.col(f"_b{k}").alias(f"_ob{k}") for k in range(3)), *(coarse(k).alias(f"_c{k}") for k in range(3)))
    near = F.lit(True)
    for k in range(3):
        near = near & (F.abs(F.col(f"_b{k}") - F.col(f"_ob{k}")) < F.col("_r"))
    met = mine.join(other, ["_c0", "_c1", "_c2"]).where((F.col(feature) != F.col("_o")) & near)
    listed = met.groupBy(feature).agg(F.sort_array(F.collect_set("_o")).alias("neighborhood"))
    none = F.array().cast(listed.schema["neighborhood"].dataType)
    return features.select(feature).join(listed, feature, "left").select(feature, F.coalesce("neighborhood", none).alias("neighborhood"), F.size(F.coalesce("neighborhood", none)).cast("long").alias("num_neighborhood"))


def feature_clustering(features: DataFrame, bins: int, phase: str, of: int, feature: str = "fid", centre: tuple[str, str, str] = ("centroid_x", "centroid_y", "centroid_z")) -> DataFrame:
    """Histogram of the distances between the centres of one phase's features (bin, lo, hi, count).

    Distances of all pairs are what is asked; numpy forms them block by block, once for their limits and once for the counts, and
    only limits and counts leave a block.
    """
    some = cut(features.where(F.col(phase) == of).select(F.col(feature).alias("i"), *(F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(centre))))

    def distances(a, b, same):
        x, y = ([t[f"p{k}"].to_numpy() for k in range(3)] for t in (a, b))
        ia, ib = a["i"].to_numpy(), b["i"].to_numpy()
        for part in chunks(len(ia), len(ib)):
            total = 0.0
            for k in range(3):
                d = x[k][part, None] - y[k]
                total = total + d * d
            yield np.sqrt(total)[ia[part, None] < ib] if same else np.sqrt(total).ravel()

    def limits(a, b, same):
        import pyarrow as pa

        found = [(d.min(), d.max()) for d in distances(a, b, same) if len(d)]
        return pa.table({"lo": pa.array([min(f[0] for f in found)] if found else [], pa.float64()), "hi": pa.array([max(f[1] for f in found)] if found else [], pa.float64())})

    lim = map_pairs(some, "i", limits, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    lo, hi = lim["lo"], lim["hi"]

    def counts(a, b, same):
        import pyarrow as pa

        made = np.zeros(bins, dtype=np.int64)
        width = (hi - lo) / bins
        for d in distances(a, b, same):
            at = np.minimum(np.floor((d - lo) / width), bins - 1).astype(np.int64) if width > 0 else np.zeros(len(d), dtype=np.int64)
            made += np.bincount(at, minlength=bins)
        return pa.table({"bin": np.flatnonzero(made).astype(np.int32), "n": made[made > 0]})

    made = map_pairs(some, "i", counts, "bin int, n long") if lo is not None else features.sparkSession.createDataFrame([], "bin int, n long")
    return made.groupBy("bin").agg(F.sum("n").alias("count")).select("bin", F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), "count")


def map_points_to_grid(points: DataFrame, grid: Grid, axes: tuple[str, str, str] = ("x", "y", "z"), name: str = "voxel", outside: str = "silent") -> DataFrame:
    """points with the index of their cell, -1 outside; outside='error' fails the job there."""
    at = [F.floor((F.col(a) - grid.origin[k]) / grid.spacing[k]) for k, a in enumerate(axes)]
    inside = F.lit(True)
    for k in range(3):
        inside = inside & at[k].between(0, grid.dims[k] - 1)
    beyond = F.lit(-1).cast("long")
    if outside == "error":
        beyond = F.raise_error(F.lit("a point lies outside the grid")).cast("long")
    return points.withColumn(name, F.when(inside, grid.index(*at)).otherwise(beyond))


def grid_around(points: DataFrame, spacing: tuple[float, float, float], axes: tuple[str, str, str] = ("x", "y", "z"), mask: str | None = None) -> Grid:
    """The grid whose cells hold all (masked) points: half a cell of margin where an axis has an extent."""
    rows = points.where(F.col(mask).cast("boolean")) if mask else points
    lim = rows.agg(*(f(a).alias(f"{n}{k}") for k, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    dims, origin = [], []
    for k, s in enumerate(spacing):
        lo, hi = lim[f"lo{k}"], lim[f"hi{k}"]
        n = max(1, math.ceil((hi - lo) / s))
        dims.append(n + 1 if n > 1 else n)
        origin.append(lo - s / 2 if n > 1 else lo)
    return Grid(tuple(dims), tuple(spacing), tuple(origin))


def interpolate_points(points: DataFrame, grid: Grid, value: str, kernel: tuple[float, float, float], sigma: tuple[float, float, float] | None = None, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(voxel, values, weights): what each point spreads to the cells of its kernel; weights are 1 or Gaussian."""
    at = map_points_to_grid(points, grid, axes).where("voxel >= 0")
    half = [max(0, math.ceil(k / s / 2)) for k, s in zip(kernel, grid.spacing)]
    c = grid.with_xyz(at.select("voxel", value), "voxel")
    for a, h in zip("xyz", half):
        c = c.withColumn(f"_d{a}", F.explode(F.sequence(F.lit(-h), F.lit(h))))
    weight = F.lit(1.0)
    if sigma:
        for a, s, w in zip("xyz", grid.spacing, sigma):
            weight = weight * F.exp(-((F.col(f"_d{a}") * s) ** 2) / (2 * w * w))
    for a, n in zip("xyz", grid.dims):
        c = c.withColumn(a, F.col(a) + F.col(f"_d{a}")).where(F.col(a).between(0, n - 1))
    spread = c.select(grid.index(F.col("x"), F.col("y"), F.col("z")).alias("voxel"), F.struct(F.col(value).alias("v"), weight.alias("w")).alias("s"))
    return spread.groupBy("voxel").agg(F.sort_array(F.collect_list("s")).alias("_l")).select("voxel", F.col("_l.v").alias("values"), F.col("_l.w").alias("weights"))


def _interval(bounds: list[float], at: Column) -> Column:
    """Number of the interval of sorted bounds that holds the value, by bisection; -1 outside."""

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at < bounds[mid], search(lo, mid)).otherwise(search(mid, hi))

    return F.when((at < bounds[0]) | (at >= bounds[-1]), -1).otherwise(search(0, len(bounds) - 1))


def resample_rectilinear(cells: DataFrame, bounds: tuple[list[float], list[float], list[float]], to: Grid, values: list[str]) -> DataFrame:
    """A regular grid's cells with the values of the rectilinear cells that hold their centres."""
    spark = cells.sparkSession
    out = to.cells(spark)
    n = [len(b) - 1 for b in bounds]
    at = [_interval(b, to.centre(k, F.col(a))) for k, (a, b) in enumerate(zip("xyz", bounds))]
    source = F.when((at[0] < 0) | (at[1] < 0) | (at[2] < 0), -1).otherwise(at[0] + at[1] * n[0] + at[2] * (n[0] * n[1]))
    return out.withColumn("_s", source.cast("long")).join(cells.select(F.col("idx").alias("_s"), *values), "_s", "left").drop("_s")


def resample_grid(cells: DataFrame, grid: Grid, spacing: tuple[float, float, float], values: list[str]) -> tuple[DataFrame, Grid]:
    """The same extent at another spacing; a new cell takes the old cell that holds its centre."""
    dims = tuple(max(1, int(n * s / t)) for n, s, t in zip(grid.dims, grid.spacing, spacing))
    to = Grid(dims, spacing, grid.origin)
    at = [F.least(F.floor((F.col(a) + 0.5) * t / s), F.lit(n - 1)) for a, s, t, n in zip("xyz", grid.spacing, spacing, grid.dims)]
    out = to.cells(cells.sparkSession).withColumn("_s", grid.index(*at))
    return out.join(cells.select(F.col("idx").alias("_s"), *values), "_s").drop("_s"), to


def crop(cells: DataFrame, grid: Grid, low: tuple[int, int, int], high: tuple[int, int, int]) -> tuple[DataFrame, Grid]:
    """Cells of a closed box, numbered again, and their grid."""
    to = Grid(tuple(b - a + 1 for a, b in zip(low, high)), grid.spacing, tuple(o + a * s for o, a, s in zip(grid.origin, low, grid.spacing)))
    c = grid.with_xyz(cells)
    for a, lo, hi in zip("xyz", low, high):
        c = c.where(F.col(a).between(lo, hi))
    new = to.index(*(F.col(a) - lo for a, lo in zip("xyz", low)))
    return c.withColumn("idx", new).select(*cells.columns), to


def partition_geometry(points: DataFrame, parts: Grid, axes: tuple[str, str, str], start: int = 1, outside: int = 0, mask: str | None = None, name: str = "partition") -> DataFrame:
    """points with the number of the coarse cell that holds them plus start."""
    out = map_points_to_grid(points, parts, axes, "_p")
    good = F.col("_p") >= 0
    if mask:
        good = good & F.col(mask).cast("boolean")
    return out.withColumn(name, F.when(good, F.col("_p") + start).otherwise(F.lit(outside)).cast("long")).drop("_p")


def fuse_regular_grids(reference: DataFrame, grid: Grid, sampling: DataFrame, other: Grid, values: list[str]) -> DataFrame:
    """reference with values of the other grid's cell at each cell's corner; 0 where there is none."""
    at = [F.floor((grid.origin[k] + F.col(a) * grid.spacing[k] - other.origin[k]) / other.spacing[k]) for k, a in enumerate("xyz")]
    inside = F.lit(True)
    for k in range(3):
        inside = inside & at[k].between(0, other.dims[k] - 1)
    c = grid.with_xyz(reference).withColumn("_s", F.when(inside, other.index(*at)))
    kinds = dict(sampling.dtypes)
    joined = c.join(sampling.select(F.col("idx").alias("_s"), *values), "_s", "left")
    return joined.select(*reference.columns, *(F.coalesce(v, F.lit(0).cast(kinds[v])).alias(v) for v in values))
