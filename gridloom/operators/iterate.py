"""Operators that repeat a step until nothing changes: distance maps, reconstruction, cleanup, alignment.

Each step is one tiled shuffle; within a tile a step runs to its own fixed point, so the number of steps follows the number of
tiles that a change has to cross, not the number of cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import FACES, Grid, map_tiles, shifted
from gridloom.operators.neighbors import feature_neighbors
from gridloom.operators.stencil import erode_dilate_bad_data
from gridloom.operators.threshold import ranks
from gridloom.session import cut


def _unfinished(most: int) -> RuntimeError:
    return RuntimeError(f"not stable after {most} rounds; pass a larger bound")


def _until_stable(cells: DataFrame, grid: Grid, state: str, fixed: list[str], sweep, tile, most: int) -> DataFrame:
    """Replaces state by sweep(arrays, inside) on tiles with a rim of one until no cell changes."""
    kind = dict(cells.dtypes)[state]
    columns = [state, *fixed]

    def compute(arrays, inside, first):
        new = sweep(arrays, inside)
        return {"_new": new, "_moved": new != arrays[state]}

    now = cells
    for _ in range(most):
        made = cut(map_tiles(now, grid, columns, {"_new": kind, "_moved": "boolean"}, compute, 1, tile, carry=[c for c in now.columns if c not in ("idx", state)]))
        now = made.withColumnRenamed("_new", state).select(*cells.columns)
        if made.where("_moved").isEmpty():
            return now
    raise _unfinished(most)


def reconstruct(cells: DataFrame, grid: Grid, marker: str, mask: str, by: str = "dilation", tile=(64, 64, 64), most: int = 10_000) -> DataFrame:
    """Marker grown below (dilation) or shrunk above (erosion) the mask through faces until stable."""
    up = by == "dilation"

    def sweep(arrays, inside):
        m, limit = arrays[marker], arrays[mask]
        low, high = (np.iinfo(m.dtype).min, np.iinfo(m.dtype).max) if np.issubdtype(m.dtype, np.integer) else (-np.inf, np.inf)
        empty = low if up else high
        while True:
            new = np.where(inside, m, empty)
            for d in FACES:
                near = np.where(shifted(inside, *d, fill=False), shifted(m, *d), empty)
                new = np.maximum(new, near) if up else np.minimum(new, near)
            new = np.minimum(new, limit) if up else np.maximum(new, limit)
            new = np.where(inside, new, m)
            if (new == m).all():
                return m
            m = new

    return _until_stable(cells, grid, marker, [mask], sweep, tile, most)


def _edge(grid: Grid):
    out = F.lit(False)
    for at, n in zip((grid.x(), grid.y(), grid.z()), grid.dims):
        if n > 1:
            out = out | (at == 0) | (at == n - 1)
    return out


def _done(cells: DataFrame, made: DataFrame, value: str, name: str | None) -> DataFrame:
    out = made.withColumn(name or value, F.col("_m").cast(dict(cells.dtypes)[value])).drop("_m")
    return out.select(*cells.columns, *([name] if name and name not in cells.columns else []))


def grayscale_fill_hole(cells: DataFrame, grid: Grid, value: str, name: str | None = None) -> DataFrame:
    """Dark places that don't reach the outside are filled up to their lowest rim."""
    top = cells.agg(F.max(value).alias("_top"))
    start = cells.crossJoin(F.broadcast(top)).withColumn("_m", F.when(_edge(grid), F.col(value)).otherwise(F.col("_top"))).drop("_top")
    return _done(cells, reconstruct(start, grid, "_m", value, "erosion"), value, name)


def grayscale_grind_peak(cells: DataFrame, grid: Grid, value: str, name: str | None = None) -> DataFrame:
    """Bright places that don't reach the outside are ground down to their highest rim."""
    low = cells.agg(F.min(value).alias("_low"))
    start = cells.crossJoin(F.broadcast(low)).withColumn("_m", F.when(_edge(grid), F.col(value)).otherwise(F.col("_low"))).drop("_low")
    return _done(cells, reconstruct(start, grid, "_m", value, "dilation"), value, name)


def h_maxima(cells: DataFrame, grid: Grid, value: str, height: float, name: str | None = None) -> DataFrame:
    """Maxima cut down by height."""
    start = cells.withColumn("_m", (F.col(value) - height).cast(dict(cells.dtypes)[value]))
    return _done(cells, reconstruct(start, grid, "_m", value, "dilation"), value, name)


def h_minima(cells: DataFrame, grid: Grid, value: str, height: float, name: str | None = None) -> DataFrame:
    """Minima filled up by height."""
    start = cells.withColumn("_m", (F.col(value) + height).cast(dict(cells.dtypes)[value]))
    return _done(cells, reconstruct(start, grid, "_m", value, "erosion"), value, name)


def h_convex(cells: DataFrame, grid: Grid, value: str, height: float, name: str = "convex") -> DataFrame:
    made = h_maxima(cells, grid, value, height, "_h")
    return made.withColumn(name, F.col(value) - F.col("_h")).drop("_h")


def h_concave(cells: DataFrame, grid: Grid, value: str, height: float, name: str = "concave") -> DataFrame:
    made = h_minima(cells, grid, value, height, "_h")
    return made.withColumn(name, F.col("_h") - F.col(value)).drop("_h")


def regional_extrema(cells: DataFrame, grid: Grid, value: str, minima: bool = False, foreground: int = 1, background: int = 0, name: str | None = None) -> DataFrame:
    """Flat zones whose face neighbors are all lower (or higher): 1 there, 0 elsewhere."""
    start = cells.withColumn("_m", F.lit(True))
    sign = -1 if minima else 1

    def sweep(arrays, inside):
        v, m = arrays[value], arrays["_m"]
        v = sign * v.astype(np.float64)
        while True:
            new = m & inside
            for d in FACES:
                near, there = shifted(v, *d), shifted(inside, *d, fill=False)
                new &= ~(there & (near > v)) & ~(there & (near == v) & ~shifted(m, *d, fill=False))
            new = np.where(inside, new, m)
            if (new == m).all():
                return m
            m = new

    made = _until_stable(start, grid, "_m", [value], sweep, (64, 64, 64), 10_000)
    name = name or ("regional_minima" if minima else "regional_maxima")
    return made.withColumn(name, F.when(F.col("_m"), foreground).otherwise(background)).drop("_m")


def euclidean_distance_map(cells: DataFrame, grid: Grid, feature: str = "fid", junction: int = 1, manhattan: bool = False, name: str = "distance", most: int = 10_000) -> DataFrame:
    """Distance of each cell above feature 0 to the nearest cell that borders at least junction other features (1: any
    boundary, 2: triple lines, 3: quadruple points); -1 where there is none.

    Waves pass a source's position through faces, so Euclidean values are those of the source that arrived, as in a
    vector distance transform.
    """
    near = None
    for d in FACES:
        step = d[0] + d[1] * grid.dims[0] + d[2] * grid.dims[0] * grid.dims[1]
        axis = next(k for k in range(3) if d[k])
        at = (grid.x(), grid.y(), grid.z())[axis] + d[axis]
        part = cells.where((F.col(feature) > 0) & at.between(0, grid.dims[axis] - 1)).select("idx", F.col(feature).alias("_f"), (F.col("idx") + step).alias("_j"))
        near = part if near is None else near.unionByName(part)
    other = near.join(cells.select(F.col("idx").alias("_j"), F.col(feature).alias("_g")), "_j").where("_g != _f and _g > 0")
    sources = other.groupBy("idx").agg(F.countDistinct("_g").alias("_n")).where(F.col("_n") >= junction).select("idx", F.col("idx").alias("_src"))
    start = cut(cells.select("idx", feature).join(sources, "idx", "left").withColumn("_src", F.coalesce("_src", F.lit(-1)).cast("long")))
    nx, ny, _ = grid.dims
    spacing = (1.0, 1.0, 1.0) if manhattan else grid.spacing

    def sweep(arrays, inside):
        src, f = arrays["_src"], arrays[feature]
        z, y, x = np.indices(src.shape)
        x, y, z = x + arrays["_first"][0], y + arrays["_first"][1], z + arrays["_first"][2]

        def far(s):
            d = [np.abs(a - b) * w for a, b, w in zip((x, y, z), (s % nx, s // nx % ny, s // (nx * ny)), spacing)]
            return np.where(s < 0, np.inf, d[0] + d[1] + d[2] if manhattan else np.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2))

        best = far(src)
        while True:
            old = src
            for d in FACES:
                theirs = np.where(shifted(inside, *d, fill=False) & (shifted(f, *d) > 0), shifted(src, *d, fill=-1), -1)
                cost = far(theirs)
                better = inside & (f > 0) & ((cost < best) | (cost == best) & (theirs < src) & (theirs >= 0))
                src, best = np.where(better, theirs, src), np.where(better, cost, best)
            if (src == old).all():
                return src, best

    now = start.withColumn("_d", F.lit(-1.0))
    for _ in range(most):

        def compute(arrays, inside, first):
            src, best = sweep(arrays | {"_first": first}, inside)
            return {"_n": src, "_d": np.where(np.isfinite(best), best, -1.0), "_moved": src != arrays["_src"]}

        made = cut(map_tiles(now, grid, ["_src", feature], {"_n": "long", "_d": "double", "_moved": "boolean"}, compute, 1, carry=[feature]))
        now = made.select("idx", feature, F.col("_n").alias("_src"), "_d")
        if made.where("_moved").isEmpty():
            break
    else:
        raise _unfinished(most)
    return cells.join(now.select("idx", F.col("_d").alias(name), F.col("_src").alias(f"{name}_source")), "idx")


def _fill(cells: DataFrame, grid: Grid, feature: str, carry: tuple[str, ...], most: int) -> DataFrame:
    for _ in range(most):
        left = cells.where(F.col(feature) == 0).count()
        if not left:
            return cells
        new = cut(erode_dilate_bad_data(cells, grid, feature, "erode", carry=carry))
        if new.where(F.col(feature) == 0).count() == left:
            return cells
        cells = new
    raise _unfinished(most)


def _renumbered(cells: DataFrame, feature: str) -> DataFrame:
    number = ranks(cells.where(F.col(feature) > 0), feature)
    return cells.join(number, feature, "left").withColumn(feature, F.coalesce(F.col("_rank") + 1, F.lit(0)).cast(dict(cells.dtypes)[feature])).select(*cells.columns)


def _without(cells: DataFrame, drop: DataFrame, feature: str) -> DataFrame:
    lost = drop.select(feature).withColumn("_x", F.lit(True))
    return cells.join(lost, feature, "left").withColumn(feature, F.when(F.col("_x"), 0).otherwise(F.col(feature)).cast(dict(cells.dtypes)[feature])).select(*cells.columns)


def require_minimum_size(cells: DataFrame, grid: Grid, minimum: int, feature: str = "fid", carry: tuple[str, ...] = (), phase: tuple[str, int] | None = None, most: int = 1000) -> DataFrame:
    """Features of fewer cells (of one phase, if given) vanish, their cells are filled by majority, ids are numbered again."""
    some = cells.where(F.col(feature) > 0)
    if phase:
        some = some.where(F.col(phase[0]) == phase[1])
    few = some.groupBy(feature).count().where(F.col("count") < minimum)
    return _renumbered(_fill(cut(_without(cells, few, feature)), grid, feature, carry, most), feature)


def require_minimum_neighbors(cells: DataFrame, grid: Grid, minimum: int, feature: str = "fid", carry: tuple[str, ...] = (), most: int = 1000) -> DataFrame:
    """Features with fewer neighboring features vanish, in the same way."""
    have = feature_neighbors(cells, grid, feature).select(feature, "num_neighbors")
    few = cells.where(F.col(feature) > 0).select(feature).distinct().join(have, feature, "left").where(F.coalesce("num_neighbors", F.lit(0)) < minimum)
    return _renumbered(_fill(cut(_without(cells, few, feature)), grid, feature, carry, most), feature)


def remove_flagged_features(cells: DataFrame, grid: Grid, flags: DataFrame, flag: str, feature: str = "fid", fill: bool = True, carry: tuple[str, ...] = (), most: int = 1000) -> DataFrame:
    """Flagged features vanish (filled by majority, or left as 0)."""
    out = cut(_without(cells, flags.where(F.col(flag).cast("boolean")), feature))
    return _renumbered(_fill(out, grid, feature, carry, most) if fill else out, feature)


def _section_centres(cells: DataFrame, grid: Grid, mask: str) -> DataFrame:
    c = grid.with_xyz(cells.where(F.col(mask).cast("boolean")))
    return c.groupBy("z").agg(*(F.avg(grid.centre(k, F.col(a))).alias(f"c{a}") for k, a in enumerate("xy")))


def align_sections_feature_centroid(cells: DataFrame, grid: Grid, mask: str, values: list[str], reference: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each section moved in whole cells so that its masked cells' centroid meets that of the section above, or of the
    reference section; the shifts (z, dx, dy). Cells moved in from outside are 0."""
    centre = cut(_section_centres(cells, grid, mask))
    if reference is not None:
        base = centre.where(F.col("z") == reference).select(F.col("cx").alias("_x"), F.col("cy").alias("_y"))
        moved = centre.crossJoin(F.broadcast(base))
    else:
        top = Window.orderBy(F.desc("z"))  # one row for each section
        moved = centre.withColumn("_x", F.first("cx").over(top)).withColumn("_y", F.first("cy").over(top))
    shifts = moved.select("z", F.round((F.col("cx") - F.col("_x")) / grid.spacing[0]).cast("long").alias("dx"), F.round((F.col("cy") - F.col("_y")) / grid.spacing[1]).cast("long").alias("dy"))
    return shift_sections(cells, grid, shifts, values), shifts


def shift_sections(cells: DataFrame, grid: Grid, shifts: DataFrame, values: list[str]) -> DataFrame:
    """Cell (x, y, z) takes the values of (x + dx, y + dy, z), 0 where that lies outside."""
    kinds = dict(cells.dtypes)
    c = grid.with_xyz(cells).join(shifts, "z", "left")
    x, y = F.col("x") + F.coalesce("dx", F.lit(0)), F.col("y") + F.coalesce("dy", F.lit(0))
    inside = x.between(0, grid.dims[0] - 1) & y.between(0, grid.dims[1] - 1)
    source = cells.select(F.col("idx").alias("_s"), *(F.col(v).alias(f"_v_{v}") for v in values))
    out = c.withColumn("_s", F.when(inside, grid.index(x, y, F.col("z")))).join(source, "_s", "left")
    return out.withColumns({v: F.coalesce(f"_v_{v}", F.lit(0).cast(kinds[v])) for v in values}).select(*cells.columns)


def align_sections_list(cells: DataFrame, grid: Grid, shifts: list[tuple[int, int, int]], values: list[str]) -> DataFrame:
    """Sections moved by a list of (z, dx, dy), each relative to the section above, which adds up from the top down."""
    total_x = total_y = 0
    rows = []
    for z, dx, dy in sorted(shifts, reverse=True):
        total_x, total_y = total_x + dx, total_y + dy
        rows.append((z, total_x, total_y))
    return shift_sections(cells, grid, F.broadcast(cells.sparkSession.createDataFrame(rows, "z long, dx long, dy long")), values)


def _thin_once(m: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """One round of parallel thinning in the x, y plane: contour cells of one side go, then those of the other."""
    ring = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
    for half in (0, 1):
        near = [shifted(m, dx, dy, 0, fill=False) & shifted(inside, dx, dy, 0, fill=False) for dx, dy in ring]
        count = sum(n.astype(int) for n in near)
        changes = sum((~a & b).astype(int) for a, b in zip(near, near[1:] + near[:1]))
        n, e, s, w = near[0], near[2], near[4], near[6]
        open_ = ~(n & e & s) & ~(e & s & w) if half == 0 else ~(n & e & w) & ~(n & s & w)
        m = m & ~(m & (count >= 2) & (count <= 6) & (changes == 1) & open_)
    return m


def binary_thinning(cells: DataFrame, grid: Grid, value: str, foreground: int = 1, name: str | None = None, steps: int = 4, most: int = 10_000) -> DataFrame:
    """The skeleton of the foreground in each layer, one cell wide; steps rounds to a shuffle."""
    now = cells.withColumn("_m", F.col(value) == foreground)

    def compute(arrays, inside, first):
        m = arrays["_m"]
        for _ in range(steps):
            m = _thin_once(m, inside)
        return {"_new": m, "_moved": m != arrays["_m"]}

    for _ in range(most):
        made = cut(map_tiles(now, grid, ["_m"], {"_new": "boolean", "_moved": "boolean"}, compute, (2 * steps, 2 * steps, 0), carry=[c for c in now.columns if c not in ("idx", "_m")]))
        now = made.withColumnRenamed("_new", "_m").drop("_moved")
        if made.where("_moved").isEmpty():
            break
    else:
        raise _unfinished(most)
    kind = dict(cells.dtypes)[value]
    return now.withColumn(name or value, F.when(F.col("_m"), foreground).otherwise(0).cast(kind)).drop("_m").select(*cells.columns, *([name] if name and name not in cells.columns else []))


def iterative_closest_point(moving: DataFrame, target: DataFrame, iterations: int = 10, width: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """moving fitted rigidly to target: nearest points, least-squares rotation and shift, repeated; and the 4x4 matrix.

    Nearest points come from cells of a hash grid, rings of cells growing until every point has its nearest one. Only sums of
    the pairs, sixteen numbers, reach the driver.
    """
    total = np.eye(4)
    lim = target.agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    n = target.count()
    extent = max(lim[f"hi{a}"] - lim[f"lo{a}"] for a in "xyz") if n else 0.0
    width = width or (extent / max(1.0, n ** (1 / 3)) or 1.0)
    now = moving
    for _ in range(iterations if n else 0):
        pairs = nearest_points(now, target, width)
        a, b = [f"{c}" for c in "xyz"], [f"n{c}" for c in "xyz"]
        sums = pairs.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in (*a, *b)), *(F.sum(F.col(p) * F.col(q)).alias(f"s_{p}{q}") for p in a for q in b)).first()
        if not sums["n"]:
            break
        ca, cb = (np.array([sums[f"s_{c}"] for c in s]) / sums["n"] for s in (a, b))
        h = np.array([[sums[f"s_{p}{q}"] for q in b] for p in a]) - sums["n"] * np.outer(ca, cb)
        u, _, vt = np.linalg.svd(h)
        d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
        r = vt.T @ np.diag([1, 1, d]) @ u.T
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = r, cb - r @ ca
        total = step @ total
        now = now.withColumns({c: sum((float(step[i, j]) * F.col(k) for j, k in enumerate("xyz")), F.lit(float(step[i, 3]))) for i, c in enumerate("xyz")})
        now = cut(now)
        if np.abs(step - np.eye(4)).max() < 1e-9:
            break
    return now, total


def every_pair(few: DataFrame, many: DataFrame, blocks: int = 32) -> DataFrame:
    """Every row of few with every row of many, which is dealt to blocks by its content, so that no task holds all of it."""
    a = few.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = many.withColumn("_block", F.pmod(F.xxhash64(*many.columns), F.lit(blocks)).cast("int"))
    return a.join(b, "_block").drop("_block")


def nearest_points(points: DataFrame, target: DataFrame, width: float, most: int = 40) -> DataFrame:
    """points (idx, x, y, z) with nx, ny, nz, the nearest target, and their distance; ring by ring of hash-grid cells.

    Points that are not sure of their nearest target within most rings are compared with all targets, block by block.
    """
    at = lambda df: df.withColumns({f"_c{a}": F.floor(F.col(a) / width) for a in "xyz"})
    t = cut(at(target.select("x", "y", "z")).select(*(F.col(a).alias(f"n{a}") for a in "xyz"), "_cx", "_cy", "_cz"))
    left = cut(at(points))
    done = None
    reach = 1
    while True:
        near = left
        for a in "xyz":
            near = near.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_c{a}") - reach, F.col(f"_c{a}") + reach)))
        d = F.sqrt(sum((F.col(a) - F.col(f"n{a}")) ** 2 for a in "xyz"))
        best = near.join(t, ["_cx", "_cy", "_cz"]).groupBy("idx").agg(F.min(F.struct(d.alias("d"), "nx", "ny", "nz")).alias("b"))
        got = cut(left.join(best, "idx", "left").withColumn("_ok", F.col("b.d") <= reach * width))
        part = got.where("_ok").select(*points.columns, "b.nx", "b.ny", "b.nz", F.col("b.d").alias("distance"))
        done = part if done is None else done.unionByName(part)
        left = cut(got.where(~F.coalesce("_ok", F.lit(False))).select(*left.columns))
        if left.isEmpty():
            return done
        if reach >= most:
            pairs = every_pair(left.select(*points.columns), t.select("nx", "ny", "nz")).withColumn("_d", d).where("_d is not null")
            best = pairs.groupBy("idx").agg(F.min(F.struct(F.col("_d").alias("d"), "nx", "ny", "nz")).alias("b"))
            return done.unionByName(left.join(best, "idx").select(*points.columns, "b.nx", "b.ny", "b.nz", F.col("b.d").alias("distance")))
        reach = min(most, reach * 3)
