"""Triangles, vertices and edges: geometry of elements, sums by feature, transforms, smoothing, slicing, sampling.

A mesh is a table of vertices (idx, x, y, z) and one of elements (idx, v0, v1, ...). Corners are fetched by equi-joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import uniform
from gridloom.grid import Grid, face_pairs
from gridloom.operators.iterate import every_pair
from gridloom.operators.threshold import ranks
from gridloom.session import cut

CORNERS = ("v0", "v1", "v2")


def with_corners(triangles: DataFrame, vertices: DataFrame, corners=CORNERS) -> DataFrame:
    """triangles with p0, p1, p2, each an array of x, y, z."""
    out = triangles
    for k, c in enumerate(corners):
        out = out.join(vertices.select(F.col("idx").alias(c), F.array("x", "y", "z").alias(f"p{k}")), c)
    return out


def _minus(a: Column, b: Column) -> list[Column]:
    return [a[i] - b[i] for i in range(3)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a) -> Column:
    return F.sqrt(_dot(a, a))


def _points() -> tuple[Column, Column, Column]:
    return F.col("p0"), F.col("p1"), F.col("p2")


def triangle_centroids(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    p = _points()
    return with_corners(triangles, vertices).select(*triangles.columns, F.array(*((p[0][i] + p[1][i] + p[2][i]) / 3 for i in range(3))).alias("centroid"))


def triangle_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    p = _points()
    n = _cross(_minus(p[1], p[0]), _minus(p[2], p[0]))
    size = _norm(n)
    return with_corners(triangles, vertices).select(*triangles.columns, F.array(*(F.when(size > 0, c / size).otherwise(math.nan) for c in n)).alias("normal"))


def triangle_areas(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    p = _points()
    return with_corners(triangles, vertices).select(*triangles.columns, (0.5 * _norm(_cross(_minus(p[1], p[0]), _minus(p[2], p[0])))).alias("area"))


def triangle_dihedral_angles(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """The least corner angle in degrees, from absolute cosines; an edge of no length gives NaN."""
    p = _points()
    ab, ac, bc = _minus(p[1], p[0]), _minus(p[2], p[0]), _minus(p[2], p[1])

    def angle(a, b) -> Column:
        size = _norm(a) * _norm(b)
        return F.when(size > 0, F.degrees(F.acos(F.least(F.abs(_dot(a, b)) / size, F.lit(1.0))))).otherwise(math.nan)

    return with_corners(triangles, vertices).select(*triangles.columns, F.least(angle(ab, ac), 180 - angle(ab, bc), angle(bc, ac)).alias("dihedral_angle"))


def reverse_winding(triangles: DataFrame) -> DataFrame:
    return triangles.withColumns({"v0": F.col("v2"), "v2": F.col("v0")})


def triangle_feature_volumes(triangles: DataFrame, vertices: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """(fid, volume): signed tetrahedra summed over each label's triangles, the other side turned; -1 is outside."""
    p = _points()
    det = _dot(p[0], _cross([p[1][i] for i in range(3)], [p[2][i] for i in range(3)])) / 6
    sides = with_corners(triangles, vertices).select(F.explode(F.array(F.struct(F.col(label_a).alias("fid"), det.alias("v")), F.struct(F.col(label_b).alias("fid"), (-det).alias("v")))).alias("s")).select("s.*")
    return sides.where("fid > 0").groupBy("fid").agg(F.abs(F.sum("v")).alias("volume"))


def triangle_feature_centroids(triangles: DataFrame, vertices: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """(fid, x, y, z): mean of the different vertices of each label's triangles."""
    used = triangles.select(F.explode(F.array(label_a, label_b)).alias("fid"), F.array(*CORNERS).alias("_v")).where("fid > 0").select("fid", F.explode("_v").alias("idx")).distinct()
    return used.join(vertices.select("idx", "x", "y", "z"), "idx").groupBy("fid").agg(*(F.avg(a).alias(a) for a in "xyz"))


def transform_vertices(vertices: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """x, y, z by a 4x4 matrix (rotation, scale, translation or any affine map)."""
    new = {a: sum((float(matrix[i][j]) * F.col(b) for j, b in enumerate("xyz")), F.lit(float(matrix[i][3]))) for i, a in enumerate("xyz")}
    return vertices.withColumns(new)


def rotation_matrix(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    size = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / size for a in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y, 0.0], [t * x * y + s * z, t * y * y + c, t * y * z - s * x, 0.0], [t * x * z - s * y, t * y * z + s * x, t * z * z + c, 0.0], [0.0, 0.0, 0.0, 1.0]]


def rotate_grid(cells: DataFrame, grid: Grid, matrix: list[list[float]], values: list[str]) -> tuple[DataFrame, Grid]:
    """The grid turned by a rotation: a box around the turned one, each new cell with the old cell that holds its
    centre turned back, or zeros."""
    r = [row[:3] for row in matrix[:3]]
    ends = [(grid.origin[k], grid.origin[k] + grid.dims[k] * grid.spacing[k]) for k in range(3)]
    corners = [[sum(r[i][k] * p[k] for k in range(3)) for i in range(3)] for p in ((x, y, z) for x in ends[0] for y in ends[1] for z in ends[2])]
    low = [min(c[i] for c in corners) for i in range(3)]
    high = [max(c[i] for c in corners) for i in range(3)]
    spacing = [sum(abs(r[i][k]) * grid.spacing[k] for k in range(3)) if max(abs(r[i][k]) for k in range(3)) > 0.999 else min(grid.spacing) for i in range(3)]
    dims = [max(1, round((h - lo) / s)) for lo, h, s in zip(low, high, spacing)]
    to = Grid(tuple(dims), tuple(spacing), tuple(low))
    centre = [to.centre(k, F.col(a)) for k, a in enumerate("xyz")]
    back = [sum((r[i][k] * centre[i] for i in range(1, 3)), r[0][k] * centre[0]) for k in range(3)]
    at = [F.floor((back[k] - grid.origin[k]) / grid.spacing[k] + 1e-9) for k in range(3)]
    inside = F.lit(True)
    for k in range(3):
        inside = inside & at[k].between(0, grid.dims[k] - 1)
    kinds = dict(cells.dtypes)
    joined = to.cells(cells.sparkSession).withColumn("_s", F.when(inside, grid.index(*at))).join(cells.select(F.col("idx").alias("_s"), *values), "_s", "left")
    return joined.select("idx", "x", "y", "z", *(F.coalesce(v, F.lit(0).cast(kinds[v])).alias(v) for v in values)), to


def align_vertices(moving: DataFrame, target: DataFrame, by: str = "centroid") -> DataFrame:
    """moving shifted so that its origin (least corner) or centroid meets the target's."""
    f = {"origin": F.min, "centroid": F.avg}[by]
    a = moving.agg(*(f(c).alias(f"_a{c}") for c in "xyz"))
    b = target.agg(*(f(c).alias(f"_b{c}") for c in "xyz"))
    return moving.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).withColumns({c: F.col(c) + F.col(f"_b{c}") - F.col(f"_a{c}") for c in "xyz"}).select(*moving.columns)


def cell_centres(cells: DataFrame, grid: Grid, values: list[str], mask: str | None = None) -> DataFrame:
    """Vertices at the centres of all or masked cells, with columns of the cells."""
    some = cells.where(F.col(mask).cast("boolean")) if mask else cells
    c = grid.with_xyz(some)
    return c.select("idx", *(grid.centre(k, F.col(a)).alias(a) for k, a in enumerate("xyz")), *values)


def point_cloud_hull(points: DataFrame, spacing: tuple[float, float, float], empty: int) -> DataFrame:
    """(x, y, z): mean point of each occupied cell with more than empty unoccupied of its 26 neighbors within the grid."""
    from gridloom.operators.neighbors import grid_around, map_points_to_grid

    grid = grid_around(points, spacing)
    at = map_points_to_grid(points, grid).where("voxel >= 0").groupBy("voxel").agg(*(F.avg(a).alias(a) for a in "xyz"))
    at = cut(at)
    c = grid.with_xyz(at.select("voxel"), "voxel")
    near = c
    for a, n in zip("xyz", grid.dims):
        near = near.withColumn(a, F.explode(F.array(F.col(a) - 1, F.col(a), F.col(a) + 1))).where(F.col(a).between(0, n - 1))
    near = near.select("voxel", grid.index(F.col("x"), F.col("y"), F.col("z")).alias("o")).where("voxel != o")
    full = at.select(F.col("voxel").alias("o"), F.lit(1).alias("f"))
    hull = near.join(full, "o", "left").groupBy("voxel").agg(F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)).alias("e")).where(F.col("e") > empty)
    return at.join(hull, "voxel").select("x", "y", "z")


def laplacian_smooth(vertices: DataFrame, edges: DataFrame, weight: Column | float, iterations: int = 1, taubin: float | None = None) -> DataFrame:
    """Each vertex moves by weight times the mean way to its edge neighbors, all at once; taubin: a second step by
    weight times that factor each time."""
    both = cut(edges.select(F.explode(F.array(F.struct(F.col("v0").alias("idx"), F.col("v1").alias("o")), F.struct(F.col("v1").alias("idx"), F.col("v0").alias("o")))).alias("e")).select("e.*").distinct())
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    for _ in range(iterations):
        for factor in (1.0, taubin) if taubin is not None else (1.0,):
            near = both.join(vertices.select(F.col("idx").alias("o"), *(F.col(a).alias(f"_{a}") for a in "xyz")), "o").groupBy("idx").agg(*(F.avg(f"_{a}").alias(f"_{a}") for a in "xyz"))
            moved = vertices.join(near, "idx", "left")
            vertices = cut(moved.withColumns({a: F.col(a) + F.coalesce(w * factor * (F.col(f"_{a}") - F.col(a)), F.lit(0.0)) for a in "xyz"}).select(*vertices.columns))
    return vertices


def slice_triangles(triangles: DataFrame, vertices: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """(slice, triangle, ax, ay, bx, by): where planes of constant z cut each triangle; a triangle meets only its own planes."""
    t = with_corners(triangles, vertices)
    p = _points()
    zs = [c[2] for c in p]
    first = F.greatest(F.lit(0), F.ceil((F.least(*zs) - low) / step)).cast("int")
    last = F.least(F.lit(int(math.floor((high - low) / step))), F.floor((F.greatest(*zs) - low) / step)).cast("int")
    cut_by = t.where(first <= last).select("idx", "p0", "p1", "p2", F.explode(F.sequence(first, last)).alias("slice")).withColumn("z", low + F.col("slice") * step)

    def meet(a: Column, b: Column) -> Column:
        part = (F.col("z") - a[2]) / (b[2] - a[2])
        crosses = (F.least(a[2], b[2]) <= F.col("z")) & (F.col("z") < F.greatest(a[2], b[2]))
        return F.when(crosses, F.struct((a[0] + part * (b[0] - a[0])).alias("x"), (a[1] + part * (b[1] - a[1])).alias("y")))

    hits = F.filter(F.array(meet(p[0], p[1]), meet(p[1], p[2]), meet(p[2], p[0])), lambda h: h.isNotNull())
    two = cut_by.withColumn("_h", hits).where(F.size("_h") == 2)
    return two.select("slice", F.col("idx").alias("triangle"), F.col("_h")[0]["x"].alias("ax"), F.col("_h")[0]["y"].alias("ay"), F.col("_h")[1]["x"].alias("bx"), F.col("_h")[1]["y"].alias("by"))


def sample_triangles(triangles: DataFrame, vertices: DataFrame, samples: int, seed: int = 5489, mask: str | None = None) -> DataFrame:
    """(sample, triangle, x, y, z): points spread by area; a triangle gets its share of an evenly stepped sum of areas
    with one random start, and random barycentric coordinates."""
    some = triangles.where(F.col(mask).cast("boolean")) if mask else triangles
    t = cut(with_corners(triangle_areas(some, vertices), vertices))
    total = t.agg(F.sum("area")).first()[0] or 0.0
    part = F.spark_partition_id()
    t = t.withColumn("_p", part)
    sums = t.groupBy("_p").agg(F.sum("area").alias("_s"))  # one row for each partition
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.join(F.broadcast(sums.select("_p", before.alias("_b"))), "_p")
    end = F.sum("area").over(Window.partitionBy("_p").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b")
    pace = total / max(samples, 1) or 1.0
    start = F.pmod(F.xxhash64(F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    t = t.withColumn("_e", end).withColumn("_n0", F.floor((F.col("_e") - F.col("area")) / pace + start)).withColumn("_n1", F.floor(F.col("_e") / pace + start))
    t = t.where("_n1 > _n0").withColumn("sample", F.explode(F.sequence(F.col("_n0"), F.col("_n1") - 1)))
    r1, r2 = F.sqrt(uniform(F.col("sample"), seed + 1)), uniform(F.col("sample"), seed + 2)
    p = _points()
    return t.select("sample", F.col("idx").alias("triangle"), *((p[0][i] * (1 - r1) + p[1][i] * r1 * (1 - r2) + p[2][i] * r1 * r2).alias(a) for i, a in enumerate("xyz")))


def quick_surface_mesh(cells: DataFrame, grid: Grid, feature: str = "fid") -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles (v0, v1, v2, label_a, label_b) of the faces between unlike cells and around the grid, two
    triangles a face; -1 is outside. label_a is the side of the lower cell."""
    nx, ny, nz = grid.dims
    inner = face_pairs(cells, grid, [feature]).where(F.col(f"a_{feature}") != F.col(f"b_{feature}"))
    inner = grid.with_xyz(inner).select("x", "y", "z", "axis", F.col(f"a_{feature}").alias("a"), F.col(f"b_{feature}").alias("b"))
    outer = None
    c = grid.with_xyz(cells)
    for axis, (name, n) in enumerate(zip("xyz", grid.dims)):
        upper = c.where(F.col(name) == n - 1).select("x", "y", "z", F.lit(axis).alias("axis"), F.col(feature).alias("a"), F.lit(-1).alias("b"))
        lower = c.where(F.col(name) == 0).select(*((F.col(k) - int(k == name)).alias(k) for k in "xyz"), F.lit(axis).alias("axis"), F.lit(-1).alias("a"), F.col(feature).alias("b"))
        outer = upper.unionByName(lower) if outer is None else outer.unionByName(upper).unionByName(lower)
    faces = inner.unionByName(outer)
    node = lambda dx, dy, dz: (F.col("x") + dx) + (F.col("y") + dy) * (nx + 1) + (F.col("z") + dz) * ((nx + 1) * (ny + 1))
    quads = {0: ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)), 1: ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), 2: ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))}
    corner = lambda k: F.when(F.col("axis") == 0, node(*quads[0][k])).when(F.col("axis") == 1, node(*quads[1][k])).otherwise(node(*quads[2][k]))
    both = F.array(F.array(corner(0), corner(1), corner(2)), F.array(corner(0), corner(2), corner(3)))
    tri = faces.select(F.posexplode(both).alias("_k", "_t"), "x", "y", "z", "axis", F.col("a").alias("label_a"), F.col("b").alias("label_b"))
    order = ((F.col("x") + 1) + (F.col("y") + 1) * (nx + 2) + (F.col("z") + 1) * ((nx + 2) * (ny + 2))) * 6 + F.col("axis") * 2 + F.col("_k")
    tri = cut(tri.select(order.alias("_o"), *(F.col("_t")[k].cast("long").alias(f"_n{k}") for k in range(3)), F.col("label_a").cast("long").alias("label_a"), F.col("label_b").cast("long").alias("label_b")))
    used = tri.select(F.explode(F.array("_n0", "_n1", "_n2")).alias("_n")).distinct()
    number = cut(ranks(used, "_n"))
    place = [F.pmod(F.col("_n"), F.lit(nx + 1)), F.pmod(F.floor(F.col("_n") / (nx + 1)), F.lit(ny + 1)), F.floor(F.col("_n") / ((nx + 1) * (ny + 1)))]
    vertices = number.select(F.col("_rank").alias("idx"), *((grid.origin[k] + place[k] * grid.spacing[k]).alias(a) for k, a in enumerate("xyz")))
    for k in range(3):
        tri = tri.join(number.select(F.col("_n").alias(f"_n{k}"), F.col("_rank").alias(f"v{k}")), f"_n{k}")
    tri = tri.join(ranks(tri, "_o"), "_o").select(F.col("_rank").alias("idx"), "v0", "v1", "v2", "label_a", "label_b")
    return vertices, tri


def crop_vertices(vertices: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Vertices in a closed box, numbered again in order."""
    inside = F.lit(True)
    for a, lo, hi in zip("xyz", low, high):
        inside = inside & F.col(a).between(lo, hi)
    kept = vertices.where(inside)
    return kept.join(ranks(kept, "idx"), "idx").drop("idx").withColumnRenamed("_rank", "idx").select("idx", *(c for c in vertices.columns if c != "idx"))


def sample_mesh_on_grid(triangles: DataFrame, vertices: DataFrame, grid: Grid, label_a: str = "label_a", label_b: str = "label_b") -> DataFrame:
    """(idx, fid): the feature whose surface encloses each cell's centre, 0 if none.

    A triangle meets the columns of cells under it; where it crosses a column's line it adds its winding to both its
    labels, and a running sum along the column tells which feature a cell is in. A hit on an edge counts for one side only.
    """
    t = with_corners(triangles, vertices)
    p = _points()
    ox, oy = grid.origin[0] + 0.5 * grid.spacing[0], grid.origin[1] + 0.5 * grid.spacing[1]
    span = lambda k, o, s, n: (F.greatest(F.lit(0), F.ceil((F.least(*(c[k] for c in p)) - o) / s)).cast("int"), F.least(F.lit(n - 1), F.floor((F.greatest(*(c[k] for c in p)) - o) / s)).cast("int"))
    (x0, x1), (y0, y1) = span(0, ox, grid.spacing[0], grid.dims[0]), span(1, oy, grid.spacing[1], grid.dims[1])
    rows = t.select("p0", "p1", "p2", F.col(label_a).alias("a"), F.col(label_b).alias("b"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).where("x0 <= x1 and y0 <= y1")
    rows = rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    # a tilt far below the spacing keeps lines off edges and corners
    px, py = ox + F.col("x") * grid.spacing[0] + 1.37e-7 * grid.spacing[0], oy + F.col("y") * grid.spacing[1] + 2.11e-7 * grid.spacing[1]
    side = lambda u, v: (v[0] - u[0]) * (py - u[1]) - (v[1] - u[1]) * (px - u[0])
    w0, w1, w2 = side(p[1], p[2]), side(p[2], p[0]), side(p[0], p[1])
    area = w0 + w1 + w2
    hit = ((w0 > 0) & (w1 > 0) & (w2 > 0)) | ((w0 < 0) & (w1 < 0) & (w2 < 0))
    height = (w0 * p[0][2] + w1 * p[1][2] + w2 * p[2][2]) / area
    first = F.ceil((height - grid.origin[2]) / grid.spacing[2] - 0.5).cast("long")
    hits = rows.where(hit).select("x", "y", F.greatest(first, F.lit(0)).alias("z"), F.signum(area).cast("int").alias("w"), "a", "b")
    turns = hits.select("x", "y", "z", F.explode(F.array(F.struct(F.col("a").alias("fid"), (-F.col("w")).alias("w")), F.struct(F.col("b").alias("fid"), F.col("w").alias("w")))).alias("s")).select("x", "y", "z", "s.fid", "s.w").where("fid > 0")
    steps = turns.groupBy("x", "y", "fid", "z").agg(F.sum("w").alias("w"))
    line = Window.partitionBy("x", "y", "fid").orderBy("z")
    runs = steps.withColumn("_in", F.sum("w").over(line)).withColumn("_end", F.least(F.coalesce(F.lead("z").over(line), F.lit(grid.dims[2])), F.lit(grid.dims[2])))
    runs = runs.where((F.col("_in") != 0) & (F.col("z") < F.col("_end"))).withColumn("_z", F.explode(F.sequence(F.col("z"), F.col("_end") - 1)))
    found = runs.select(grid.index(F.col("x"), F.col("y"), F.col("_z")).alias("idx"), "fid").groupBy("idx").agg(F.min("fid").alias("fid"))
    return grid.cells(triangles.sparkSession).select("idx").join(found, "idx", "left").select("idx", F.coalesce("fid", F.lit(0)).cast("long").alias("fid"))


def _to_triangle(q: list[Column]) -> Column:
    """Distance from q to the triangle p0, p1, p2: to its plane where the foot lies within, else to the nearest edge."""
    p = [[c[i] for i in range(3)] for c in _points()]
    diff = lambda a, b: [x - y for x, y in zip(a, b)]
    n = _cross(diff(p[1], p[0]), diff(p[2], p[0]))
    size = _norm(n)
    height = _dot(diff(q, p[0]), n) / F.when(size > 0, size).otherwise(1.0)
    within = size > 0
    edges = []
    for a, b in ((0, 1), (1, 2), (2, 0)):
        e, r = diff(p[b], p[a]), diff(q, p[a])
        within = within & (_dot(_cross(e, r), n) >= 0)
        length = _dot(e, e)
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(r, e) / F.when(length > 0, length).otherwise(1.0)))
        edges.append(_norm([r[i] - part * e[i] for i in range(3)]))
    return F.when(within, F.abs(height)).otherwise(F.least(*edges)) * F.when(height < 0, -1.0).otherwise(1.0)


def vertex_triangle_distances(points: DataFrame, triangles: DataFrame, vertices: DataFrame, width: float, most: int = 40) -> DataFrame:
    """(idx, distance, triangle): the nearest triangle of each point, negative behind its winding.

    Triangles are listed in all cells of a hash grid that their boxes touch; points look in rings of cells that grow until the
    nearest triangle is surely among them; points that are not sure of theirs within most rings are compared with all
    triangles, block by block.
    """
    p = _points()
    t = with_corners(triangles, vertices).select(F.col("idx").alias("triangle"), "p0", "p1", "p2")
    every = t
    for k, a in enumerate("xyz"):
        lo, hi = F.floor(F.least(*(c[k] for c in p)) / width), F.floor(F.greatest(*(c[k] for c in p)) / width)
        t = t.withColumn(f"_c{a}", F.explode(F.sequence(lo, hi)))
    t = cut(t)
    left = cut(points.select("idx", "x", "y", "z", *(F.floor(F.col(a) / width).alias(f"_c{a}") for a in "xyz")))
    done, reach = None, 1
    while True:
        near = left
        for a in "xyz":
            near = near.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_c{a}") - reach, F.col(f"_c{a}") + reach)))
        d = _to_triangle([F.col(a) for a in "xyz"])
        best = near.join(t, ["_cx", "_cy", "_cz"]).withColumn("_d", d).groupBy("idx").agg(F.min(F.struct(F.abs("_d").alias("m"), F.col("triangle"), F.col("_d").alias("d"))).alias("b"))
        got = cut(left.join(best, "idx", "left").withColumn("_ok", F.col("b.m") <= reach * width))
        part = got.where("_ok").select("idx", F.col("b.d").alias("distance"), F.col("b.triangle").alias("triangle"))
        done = part if done is None else done.unionByName(part)
        left = cut(got.where(~F.coalesce("_ok", F.lit(False))).select(*left.columns))
        if left.isEmpty():
            return done
        if reach >= most:
            pairs = every_pair(left.select("idx", "x", "y", "z"), every).withColumn("_d", d).where("_d is not null")
            best = pairs.groupBy("idx").agg(F.min(F.struct(F.abs("_d").alias("m"), F.col("triangle"), F.col("_d").alias("d"))).alias("b"))
            return done.unionByName(best.select("idx", F.col("b.d").alias("distance"), F.col("b.triangle").alias("triangle")))
        reach = min(most, 3 * reach)
