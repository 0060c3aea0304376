"""Connected components on grids and meshes, and what is built on them.

Components are found inside tiles first (numpy, one shuffle), each tile's labels are its least cells, and only labels
that touch across tile borders become edges of a graph, which the contraction of gridloom.operators.components
solves. Feature ids count from 1 in the order of each component's least cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import FACES, Grid, face_pairs, map_tiles, shifted
from gridloom.operators.components import connected_components
from gridloom.operators.threshold import ranks
from gridloom.session import cut

Similar = Callable[[dict, dict], np.ndarray]


def _block_labels(arrays: dict, good: np.ndarray, index: np.ndarray, similar: Similar) -> np.ndarray:
    """Least index of each place's component within a block, by repeated minima along faces and jumps."""
    label = np.where(good, index, np.iinfo(np.int64).max)
    links = []
    for d in FACES[3:]:
        other = {k: shifted(v, *d) for k, v in arrays.items()}
        links.append((d, good & shifted(good, *d, fill=False) & similar(arrays, other)))
    order = np.argsort(index, axis=None)
    keys = index.ravel()[order]
    ok = good.ravel()
    while True:
        before = label
        for d, open_ in links:
            label = np.where(open_, np.minimum(label, shifted(label, *d)), label)
            back = tuple(-x for x in d)
            label = np.where(shifted(open_, *back, fill=False), np.minimum(label, shifted(label, *back)), label)
        flat = label.ravel().copy()  # jump to the label of the label's own place
        flat[ok] = np.minimum(flat[ok], flat[order[np.searchsorted(keys, flat[ok])]])
        label = flat.reshape(label.shape)
        if (label == before).all():
            return label


def segment(cells: DataFrame, grid: Grid, columns: list[str], similar: Similar, mask: str | None = None, tile: tuple[int, int, int] = (64, 64, 64), name: str = "fid") -> DataFrame:
    """cells with name: the feature of each cell, 0 outside the mask. similar(a, b) says which of two cells' columns,
    given as dense arrays, belong together."""
    nx, ny, _ = grid.dims
    inputs = list(dict.fromkeys([*columns, *([mask] if mask else [])]))

    def compute(arrays, inside, first):
        z, y, x = np.indices(inside.shape)
        index = (x + first[0]) + (y + first[1]) * nx + (z + first[2]) * (nx * ny)
        good = inside & (arrays[mask].astype(bool) if mask else True)
        label = _block_labels({c: arrays[c] for c in columns}, good, index.astype(np.int64), similar)
        return {"_label": np.where(good, label, -1)}

    labelled = map_tiles(cells, grid, inputs, {"_label": "long"}, compute, 0, tile)
    base = cut(cells.select("idx", *inputs).join(labelled, "idx"))
    faces = face_pairs(_near_borders(base, grid, tile), grid, [*columns, "_label"]).where("a__label >= 0 and b__label >= 0 and a__label != b__label")
    edges = _similar_rows(faces, columns, similar)
    joined = connected_components(edges, "a__label", "b__label")
    root = _with_names(base, joined.withColumnRenamed("node", "_label"), "_label", 0).select("idx", F.when(F.col("_label") >= 0, F.coalesce("component", "_label")).alias("_root"))
    root = cut(root)
    number = ranks(root.where("_root is not null"), "_root")
    ids = _with_names(root, number, "_root", 0).select("idx", F.coalesce(F.col("_rank") + 1, F.lit(0)).cast("long").alias(name))
    return cells.join(ids, "idx")


def _with_names(cells: DataFrame, names: DataFrame, key: str, least: int) -> DataFrame:
    """cells left-joined with names on key. Cells whose key is null or below least have no name; most cells can be such, so they
    go by their own index instead of meeting in one task."""
    own = F.when(F.col(key) >= least, F.col(key).cast("long")).otherwise(least - 1 - F.col("idx"))
    return cells.withColumn("_own", own).join(names.withColumnRenamed(key, "_own"), "_own", "left").drop("_own")


def _near_borders(cells: DataFrame, grid: Grid, tile: tuple[int, int, int]) -> DataFrame:
    """Cells on either side of a border between tiles."""
    near = F.lit(False)
    for at, n, t in zip((grid.x(), grid.y(), grid.z()), grid.dims, tile):
        if n > t:
            near = near | F.pmod(at, F.lit(t)).isin(0, t - 1)
    return cells.where(near)


def _similar_rows(faces: DataFrame, columns: list[str], similar: Similar) -> DataFrame:
    def run(frames):
        for f in frames:
            a = {c: _dense(f[f"a_{c}"]) for c in columns}
            b = {c: _dense(f[f"b_{c}"]) for c in columns}
            yield f.loc[np.asarray(similar(a, b), dtype=bool) if len(f) else [], ["a__label", "b__label"]]

    return faces.mapInPandas(run, "a__label long, b__label long")


def _dense(series):
    return np.stack(series.to_numpy()) if len(series) and isinstance(series.iloc[0], (list, np.ndarray)) else series.to_numpy()


def scalar_segment(cells: DataFrame, grid: Grid, value: str, tolerance: float, mask: str | None = None, name: str = "fid", tile: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """Face neighbors whose values differ by at most the tolerance belong together."""
    return segment(cells, grid, [value], lambda a, b: np.abs(a[value].astype(np.float64) - b[value]) <= tolerance, mask, tile, name)


def connected_component_image(cells: DataFrame, grid: Grid, value: str, name: str = "label") -> DataFrame:
    """Labels of cells whose value isn't 0."""
    marked = cells.withColumn("_m", F.col(value) != 0)
    return segment(marked, grid, ["_m"], lambda a, b: np.ones(a["_m"].shape, dtype=bool), "_m", name=name).drop("_m")


def identify_sample(cells: DataFrame, grid: Grid, mask: str, fill_holes: bool = False) -> DataFrame:
    """The mask reduced to its largest component (of equal ones the last); holes, components of the rest that don't
    reach the grid's outside, become part of it if wanted."""
    comps = connected_component_image(cells.withColumn(mask, F.col(mask).cast("int")), grid, mask, "_c").select("idx", "_c")
    sizes = comps.where("_c > 0").groupBy("_c").count()
    best = sizes.agg(F.max(F.struct("count", "_c"))["_c"].alias("_best"))
    kept = comps.crossJoin(F.broadcast(best)).select("idx", F.coalesce(F.col("_c") == F.col("_best"), F.lit(False)).alias("_kept"))
    if fill_holes:
        kept = cut(kept)
        rest = connected_component_image(kept.withColumn("_o", (~F.col("_kept")).cast("int")), grid, "_o", "_h")
        edge = F.lit(False)
        for at, n in zip((grid.x(), grid.y(), grid.z()), grid.dims):
            if n > 1:
                edge = edge | (at == 0) | (at == n - 1)
        open_ = rest.where("_h > 0").groupBy("_h").agg(F.max(edge).alias("_open"))
        kept = _with_names(rest, open_, "_h", 1).select("idx", (F.col("_kept") | ~F.coalesce("_open", F.lit(False))).alias("_kept"))
    return cells.drop(mask).join(kept, "idx").withColumnRenamed("_kept", mask).select(*cells.columns)


def fill_bad_data(cells: DataFrame, grid: Grid, feature: str = "fid", minimum: int = 1, carry: tuple[str, ...] = (), new_phase: int | None = None, phase: str | None = None, most: int = 1000) -> DataFrame:
    """Components of feature-0 cells below the minimum size take the most frequent good face neighbor, ring by ring;
    larger ones stay and may become a phase of their own."""
    from gridloom.operators.stencil import erode_dilate_bad_data

    marked = cells.withColumn("_bad", (F.col(feature) == 0).cast("int"))
    comps = connected_component_image(marked, grid, "_bad", "_c").drop("_bad")
    sizes = comps.where("_c > 0").groupBy("_c").agg(F.count("*").alias("_n"))
    out = cut(_with_names(comps, sizes, "_c", 1).withColumn("_large", F.coalesce(F.col("_n") >= minimum, F.lit(False))).drop("_c", "_n"))
    if phase and new_phase is not None:
        out = out.withColumn(phase, F.when("_large", F.lit(new_phase)).otherwise(F.col(phase)).cast(dict(cells.dtypes)[phase]))
    out = out.withColumn("_f", F.when(F.col("_large"), F.lit(-1)).otherwise(F.col(feature)).cast(dict(cells.dtypes)[feature]))
    for _ in range(most):
        left = out.where("_f = 0").count()
        if not left:
            break
        out = cut(erode_dilate_bad_data(out, grid, "_f", "erode", carry=tuple(carry)))
        if out.where("_f = 0").count() == left:
            break
    return out.withColumn(feature, F.when(F.col("_f") < 0, 0).otherwise(F.col("_f")).cast(dict(cells.dtypes)[feature])).select(*cells.columns)


def label_triangles(triangles: DataFrame, corners: tuple[str, str, str] = ("v0", "v1", "v2"), idx: str = "idx") -> DataFrame:
    """triangles with region: components over shared edges, numbered from 1 by least triangle. An edge's triangles are
    chained to its least one, so an edge of many triangles costs a row for each."""
    pairs = [(0, 1), (1, 2), (2, 0)]
    edge = lambda i, j: F.struct(F.least(corners[i], corners[j]).alias("a"), F.greatest(corners[i], corners[j]).alias("b"))
    sides = triangles.select(F.col(idx).alias("t"), F.explode(F.array(*(edge(i, j) for i, j in pairs))).alias("e"))
    first = sides.groupBy("e").agg(F.min("t").alias("m"))
    comps = connected_components(sides.join(first, "e"), "t", "m")
    number = ranks(comps, "component")
    named = comps.join(number, "component").select(F.col("node").alias(idx), (F.col("_rank") + 1).alias("region"))
    return triangles.join(named, idx)


def shared_feature_faces(triangles: DataFrame, label_a: str, label_b: str, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """triangles with face_id, numbered from 1 by the first triangle of each unordered pair of labels; and the faces
    (face_id, low, high, num_triangles)."""
    t = triangles.withColumns({"_lo": F.least(label_a, label_b), "_hi": F.greatest(label_a, label_b)})
    faces = t.groupBy("_lo", "_hi").agg(F.min(idx).alias("_first"), F.count("*").alias("num_triangles"))
    faces = cut(faces)
    faces = faces.join(ranks(faces, "_first"), "_first").select((F.col("_rank") + 1).alias("face_id"), "_lo", "_hi", "num_triangles")
    return t.join(faces.drop("num_triangles"), ["_lo", "_hi"]).drop("_lo", "_hi"), faces.select("face_id", F.col("_lo").alias("low"), F.col("_hi").alias("high"), "num_triangles")


def group_features(features: DataFrame, pairs: DataFrame, feature: str = "fid", name: str = "parent") -> DataFrame:
    """Features joined by pairs (feature, other) get one parent, numbered from 1; as twins or fibres are merged once
    the pairs that belong together are known."""
    comps = connected_components(pairs, feature, "other")
    rooted = cut(features.where(F.col(feature) > 0).select(feature).join(comps.withColumnRenamed("node", feature), feature, "left").select(feature, F.coalesce("component", feature).alias("_root")))
    return rooted.join(ranks(rooted, "_root"), "_root").select(feature, (F.col("_rank") + 1).cast("long").alias(name))


def double_threshold(cells: DataFrame, grid: Grid, value: str, bounds: tuple[float, float, float, float], name: str = "mask") -> DataFrame:
    """Cells of the wide range [bounds 0, bounds 3] whose component holds a cell of the narrow range [bounds 1, bounds 2]."""
    wide = cells.withColumn("_w", F.col(value).between(bounds[0], bounds[3]).cast("int"))
    comps = connected_component_image(wide, grid, "_w", "_c")
    seeds = comps.where((F.col("_c") > 0) & F.col(value).between(bounds[1], bounds[2])).select("_c").distinct().withColumn("_s", F.lit(1))
    return _with_names(comps, seeds, "_c", 1).withColumn(name, F.coalesce("_s", F.lit(0))).select(*cells.columns, name)
