"""Operators on small hand-made inputs, with numpy or plain Python as the judge."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.functions import orientation, scalar
from gridloom.functions.calculator import CalculatorError, calculate
from gridloom.grid import FACES, Grid
from gridloom.operators import aggregates, cluster, iterate, mesh, neighbors, segment, stencil, threshold
from gridloom.operators.components import connected_components
from gridloom.plans.pipeline import Pipeline, PipelineError
from gridloom.plans.structure import Structure, StructureError
from gridloom.sources import binary, store, text
from gridloom.streaming import stateless


def grid_frame(spark, blocks):
    """Cells of equal arrays (z, y, x) by name, and their grid."""
    first = next(iter(blocks.values()))
    names = list(blocks)
    rows = [(i, *(v.ravel()[i].item() for v in blocks.values())) for i in range(first.size)]
    kinds = {"i": "long", "f": "double", "b": "boolean"}
    schema = "idx long, " + ", ".join(f"{n} {kinds[blocks[n].dtype.kind]}" for n in names)
    return spark.createDataFrame(rows, schema), Grid(first.shape[::-1])


def block_of(df, name, shape):
    out = np.zeros(shape, dtype=object)
    for r in df.select("idx", name).collect():
        out.ravel()[r[0]] = r[1]
    return out


def test_statistics_with_mask(spark):
    values = [1, 20, 13, 45, 5, 16, 73, 22, 9, 10, 1]
    mask = [True, True, False, True, True, True, False, True, True, True, True]
    df = spark.createDataFrame(list(zip(values, mask)), "v int, m boolean")
    r = aggregates.array_statistics(df, "v", mask="m").first()
    kept = [v for v, m in zip(values, mask) if m]
    assert (r["length"], r["min"], r["max"], r["sum"]) == (9, 1, 45, sum(kept))
    assert r["mean"] == pytest.approx(np.mean(kept)) and r["median"] == np.median(kept) and r["stddev"] == pytest.approx(np.std(kept))
    assert r["modes"] == [1] and r["n_unique"] == 8


def test_negative_groups_have_their_true_maximum(spark):
    df = spark.createDataFrame([(1, -5.0), (1, -2.0), (2, 3.0)], "g int, v double")
    assert {r["g"]: r["max"] for r in aggregates.array_statistics(df, "v", "g").collect()} == {1: -2.0, 2: 3.0}


def test_histogram_counts_overflow(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 9, 11]], "v double")
    rows = aggregates.array_histogram(df, ["v"], 2, 0, 10).orderBy("bin").collect()
    assert [(r["count"], r["overflow"]) for r in rows] == [(4, 1), (1, 1)]


@pytest.mark.parametrize("expression, want", [("-2^2", 4.0), ("2^3^2", 64.0), ("1+2*3", 7.0), ("log(2, 8)", 3.0), ("root(27, 3)", 3.0), ("1/0", math.inf), ("a - b / 2", 1.0), ("v[1] * 2", 20.0), ("abs(-3) + ceil(1.2)", 5.0), ("ln(0)", -math.inf)])
def test_calculator(spark, expression, want):
    df = spark.createDataFrame([(2, 2, [5.0, 10.0])], "a int, b int, v array<double>")
    assert df.select(calculate(expression, df.columns).alias("x")).first()[0] == pytest.approx(want)


def test_calculator_degrees_and_errors(spark):
    df = spark.createDataFrame([(30.0,)], "a double")
    assert df.select(calculate("sin(a) + acos(0.5)", df.columns, degrees=True)).first()[0] == pytest.approx(60.5)
    for bad in ("", "1 +", "nope", "sin(1, 2)", "foo(1)", "(1", "a[0.5]", "1 2", "#"):
        with pytest.raises(CalculatorError):
            calculate(bad, df.columns)


def test_threshold_trees(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "a int, b double")
    tree = threshold.AnyOf((threshold.Compare("a", ">", 2.7), threshold.Compare("b", "<", 5, True)), True, True)
    assert [r["mask"] for r in threshold.threshold_mask(df, tree).orderBy("a").collect()] == [True] * 5 + [False]
    with pytest.raises(ValueError):
        threshold.threshold_mask(df, threshold.Compare("a", ">=", 1))


@pytest.mark.parametrize("kind, want", [("uint8", [255, 0, 44, 3]), ("int8", [-1, 0, 44, 3]), ("boolean", [True, False, True, True]), ("int32", [-1, 0, 300, 3])])
def test_conversions_wrap_and_cut(spark, kind, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-1.5, 0.0, 300.0, 3.9])], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(scalar.convert(F.col("v"), kind)).collect()] == want


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(300)
    edges = [(int(ids[i]), int(ids[i + 1])) for i in range(120)] + [(1000, 1000 + i) for i in range(80)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent}


def brute_labels(good, same):
    label = np.zeros(good.shape, dtype=int)
    n = 0
    for p in np.ndindex(good.shape):
        if good[p] and not label[p]:
            n += 1
            todo = [p]
            label[p] = n
            while todo:
                q = todo.pop()
                for dx, dy, dz in FACES:
                    r = (q[0] + dz, q[1] + dy, q[2] + dx)
                    if all(0 <= a < b for a, b in zip(r, good.shape)) and good[r] and not label[r] and same(q, r):
                        label[r] = n
                        todo.append(r)
    return label


def test_segments_across_tiles(spark):
    rng = np.random.default_rng(1)
    value = rng.integers(0, 4, (5, 9, 11))
    mask = rng.random(value.shape) < 0.8
    cells, grid = grid_frame(spark, {"v": value, "m": mask})
    out = block_of(segment.scalar_segment(cells, grid, "v", 1, "m", tile=(4, 4, 4)), "fid", value.shape)
    assert (out == brute_labels(mask, lambda p, q: abs(value[p] - value[q]) <= 1)).all()


def test_stencils_do_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    value = rng.integers(0, 50, (6, 7, 8))
    cells, grid = grid_frame(spark, {"v": value, "fid": rng.integers(0, 3, value.shape)})
    whole = {
        "dilate": stencil.grayscale_dilate(cells, grid, "v"), "opening": stencil.opening(cells, grid, "v"), "median": stencil.median(cells, grid, "v"),
        "mask": stencil.erode_dilate_mask(cells.withColumn("v", F.col("v") > 40), grid, "v", "dilate", 2), "bad": stencil.erode_dilate_bad_data(cells, grid, "fid", "erode", 2, carry=("v",)),
    }
    whole = {k: block_of(d, "v", value.shape) for k, d in whole.items()}
    small = stencil.map_tiles
    monkeypatch.setattr(stencil, "map_tiles", lambda cells, grid, a, b, c, rim, **k: small(cells, grid, a, b, c, rim, tile=(3, 3, 3)))
    again = {
        "dilate": stencil.grayscale_dilate(cells, grid, "v"), "opening": stencil.opening(cells, grid, "v"), "median": stencil.median(cells, grid, "v"),
        "mask": stencil.erode_dilate_mask(cells.withColumn("v", F.col("v") > 40), grid, "v", "dilate", 2), "bad": stencil.erode_dilate_bad_data(cells, grid, "fid", "erode", 2, carry=("v",)),
    }
    for k, d in again.items():
        assert (block_of(d, "v", value.shape) == whole[k]).all(), k
    padded = np.pad(value, 1, mode="constant", constant_values=-1)
    want = np.max([padded[1 + a : 7 + a, 1 + b : 8 + b, 1 + c : 9 + c] for a, b, c in itertools.product((-1, 0, 1), repeat=3)], axis=0)
    assert (whole["dilate"] == want).all()


def test_reconstruction(spark):
    value = np.full((1, 5, 5), 5)
    value[0, 2, 2], value[0, 0, 0], value[0, 3, 3] = 1, 2, 9
    cells, grid = grid_frame(spark, {"v": value})
    filled = block_of(iterate.grayscale_fill_hole(cells, grid, "v"), "v", value.shape)
    assert filled[0, 2, 2] == 5 and filled[0, 0, 0] == 2 and filled[0, 3, 3] == 9
    ground = block_of(iterate.grayscale_grind_peak(cells, grid, "v"), "v", value.shape)
    assert ground[0, 3, 3] == 5 and ground[0, 2, 2] == 1
    cut = block_of(iterate.h_maxima(cells, grid, "v", 2), "v", value.shape)
    assert cut[0, 3, 3] == 7 and cut[0, 1, 1] == 5
    top = block_of(iterate.regional_extrema(cells, grid, "v"), "regional_maxima", value.shape)
    assert top[0, 3, 3] == 1 and top.sum() == 1


def test_distances_and_cleanup(spark):
    fid = np.ones((1, 6, 6), dtype=int)
    fid[0, :, 3:] = 2
    fid[0, 1, 1], fid[0, 4, 4] = 0, 3
    cells, grid = grid_frame(spark, {"fid": fid})
    d = block_of(iterate.euclidean_distance_map(cells, grid, manhattan=True), "distance", fid.shape)
    assert d[0, 0, 2] == 0 and d[0, 0, 0] == 2 and d[0, 1, 1] == -1
    clean = block_of(iterate.require_minimum_size(cells, grid, 2), "fid", fid.shape)
    assert set(clean.ravel()) == {1, 2} and clean[0, 4, 4] == 2 and clean[0, 1, 1] == 1
    filled = block_of(segment.fill_bad_data(cells, grid, "fid", 2), "fid", fid.shape)
    assert filled[0, 1, 1] == 1
    kept = block_of(segment.fill_bad_data(cells, grid, "fid", 1), "fid", fid.shape)
    assert kept[0, 1, 1] == 0


def test_thinning_and_section_lists(spark):
    block = np.zeros((1, 9, 20), dtype=int)
    block[0, 2:7, 2:18] = 1
    cells, grid = grid_frame(spark, {"v": block})
    thin = block_of(iterate.binary_thinning(cells, grid, "v", steps=1), "v", block.shape).astype(int)
    assert 0 < thin.sum() < 20 and (thin <= block).all() and (thin.sum(axis=1) <= 1).all()
    layers = np.arange(24).reshape(2, 3, 4)
    cells, grid = grid_frame(spark, {"v": layers})
    moved = block_of(iterate.align_sections_list(cells, grid, [(1, 1, 0), (0, 0, 1)], ["v"]), "v", layers.shape)
    assert (moved[1, :, :3] == layers[1, :, 1:]).all() and (moved[1, :, 3] == 0).all()
    assert (moved[0, :2, :3] == layers[0, 1:, 1:]).all() and (moved[0, 2] == 0).all()


def test_mesh_volumes_and_io(spark, tmp_path):
    fid = np.ones((2, 2, 2), dtype=int)
    fid[0] = 2
    cells, grid = grid_frame(spark, {"fid": fid})
    v, t = mesh.quick_surface_mesh(cells, grid)
    assert {r["fid"]: r["volume"] for r in mesh.triangle_feature_volumes(t, v, "label_a", "label_b").collect()} == {1: pytest.approx(4.0), 2: pytest.approx(4.0)}
    outer = t.where("label_a = -1 or label_b = -1")
    binary.save_parts(binary.stl_bytes(outer, v).withColumnRenamed("group", "part"), str(tmp_path / "a.stl"))
    v2, t2 = binary.read_stl(spark, str(tmp_path / "a.stl"))
    assert t2.count() == outer.count() == 48 and v2.count() == 26
    assert mesh.triangle_areas(t2, v2).agg(F.sum("area")).first()[0] == pytest.approx(24.0)
    regions = segment.label_triangles(t2)
    assert regions.select("region").distinct().count() == 1
    faces, pairs = segment.shared_feature_faces(t, "label_a", "label_b")
    assert pairs.count() == 3 and faces.count() == t.count()
    smooth = mesh.laplacian_smooth(v, t.select("v0", "v1"), 0.5, 2)
    assert smooth.count() == v.count()
    assert mesh.slice_triangles(t, v, 0.5, 1.5, 1.0).count() > 0
    assert mesh.sample_triangles(t, v, 100).count() == 100
    kept, points = threshold.remove_flagged_elements(t.withColumn("m", F.col("label_a") != -1), v, "m", ["v0", "v1", "v2"])
    assert kept.agg(F.max(F.greatest("v0", "v1", "v2"))).first()[0] == points.count() - 1


def test_distances_to_triangles(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 0.0, 0.0, 50.0), (4, 4.0, 0.0, 50.0), (5, 0.0, 4.0, 50.0)], "idx long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "idx long, v0 long, v1 long, v2 long")
    points = spark.createDataFrame([(0, 1.0, 1.0, 2.0), (1, 1.0, 1.0, -3.0), (2, -3.0, 0.0, 4.0), (3, 4.0, 4.0, 0.0), (4, 1.0, 1.0, 45.0)], "idx long, x double, y double, z double")
    got = {r["idx"]: (r["distance"], r["triangle"]) for r in mesh.vertex_triangle_distances(points, t, v, 2.0).collect()}
    assert got[0] == (2.0, 0) and got[1] == (-3.0, 0) and got[2] == (5.0, 0) and got[4] == (-5.0, 1)
    assert got[3][0] == pytest.approx(math.sqrt(8))


def test_raw_and_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1.5, [i, -i]) for i in range(50)], "idx long, v double, w array<int>")
    for big in (False, True):
        binary.save_parts(binary.raw_bytes(df, "v", "float32", big), str(tmp_path / "v.raw"))
        got = [r["value"] for r in binary.read_raw(spark, str(tmp_path / "v.raw"), "float32", big_endian=big).orderBy("idx").collect()]
        assert got == [i * 1.5 for i in range(50)]
    binary.save_parts(binary.raw_bytes(df, "w", "int16"), str(tmp_path / "w.raw"))
    assert [list(r["value"]) for r in binary.read_raw(spark, str(tmp_path / "w.raw"), "int16", 2).orderBy("idx").collect()] == [[i, -i] for i in range(50)]
    text.write_ascii(df, str(tmp_path / "t"), ["v", "w"], "semicolon", index=True)
    back = text.read_csv(spark, str(tmp_path / "t"), {"idx2": "int32", "v": "float64", "a": "int32", "b": "int32"}, ";")
    assert [tuple(r)[1:] for r in back.orderBy("idx").collect()] == [(i, i * 1.5, i, -i) for i in range(50)]
    (tmp_path / "n.txt").write_text("skip\n1 2 3\n4 5 6\n")
    assert [list(r["value"]) for r in text.read_text_array(spark, str(tmp_path / "n.txt"), "int32", 2, 1, "space").orderBy("idx").collect()] == [[1, 2], [3, 4], [5, 6]]
    for bad in ("a,b\n1\n", "a,b\n1,x\n", "a,b\n\n1,2\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            text.read_csv(spark, str(tmp_path / "bad.csv"), {"a": "int32", "b": "int32"}).collect()
    store.save({"a/cells": df}, str(tmp_path / "store"), pipeline=[{"filter": "select"}])
    assert store.load(spark, str(tmp_path / "store"))["a/cells"].count() == 50
    assert store.extract_pipeline(spark, str(tmp_path / "store")) == [{"filter": "select"}]


@pytest.mark.parametrize("kind", [r for r in orientation.REPRESENTATIONS if r != "quaternion"])
def test_orientations_round_trip(spark, kind):
    rng = np.random.default_rng(4)
    q = rng.standard_normal((40, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q *= np.where(q[:, 3:] < 0, -1, 1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "i int, q array<double>")
    there = orientation.convert(F.col("q"), "quaternion", kind)
    back = np.array([r[0] for r in df.orderBy("i").select(orientation.convert(there, kind, "quaternion")).collect()])
    assert np.abs(np.abs((back * q).sum(axis=1)) - 1).max() < 1e-9


def test_symmetry(spark):
    assert len(orientation.cubic_symmetry()) == 24 and len(orientation.hexagonal_symmetry()) == 12
    h = math.sqrt(0.5)
    df = spark.createDataFrame([([0.0, 0.0, h, h], [0.0, 0.0, 0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(orientation.misorientation(F.col("a"), F.col("b"), "cubic").alias("c"), orientation.misorientation(F.col("a"), F.col("b"), "hexagonal").alias("h"), orientation.fundamental_zone(F.col("a"), "cubic").alias("z"), orientation.schmid_factor(F.col("b"), (0, 0, 1), (1, 1, 1), (1, 1, 0)).alias("s")).first()
    assert r["c"] == pytest.approx(0, abs=1e-6) and r["h"] == pytest.approx(math.pi / 6) and r["z"][3] == pytest.approx(1) and r["s"] == pytest.approx(1 / math.sqrt(6))


def test_clusters(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "idx long, v array<double>")
    for f in (cluster.k_means, cluster.k_medoids):
        got = [r["cluster"] for r in f(df, "v", 3, centres=[[1.0, 1.0], [4.0, 0.0], [0.0, 4.0]])[0].orderBy("idx").collect()]
        assert got == [1] * 30 + [2] * 30 + [3] * 30
    got = [r["cluster"] for r in cluster.dbscan(df, "v", 1.0, 3, 2).orderBy("idx").collect()]
    assert got == [1] * 30 + [2] * 30 + [3] * 30


def test_icp_recovers_a_turn(spark):
    rng = np.random.default_rng(7)
    p = rng.random((60, 3)) * 10
    turn = np.array(mesh.rotation_matrix((0, 0, 1), 3.0))
    moved = p @ turn[:3, :3].T + np.array([0.1, -0.1, 0.05])
    frame = lambda a: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], "idx long, x double, y double, z double")
    out, matrix = iterate.iterative_closest_point(frame(p), frame(moved), 15)
    assert np.abs(matrix[:3, :3] - turn[:3, :3]).max() < 1e-6
    assert np.abs(np.array([[r["x"], r["y"], r["z"]] for r in out.orderBy("idx").collect()]) - moved).max() < 1e-6


def test_pipeline_preflight(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    good = Pipeline([{"filter": "calculate", "args": {"expression": "a * b", "name": "c"}}, {"filter": "nope", "disabled": True}, {"filter": "select", "args": {"columns": ["c"]}}])
    assert good.preflight(df)[-1] == "struct<c:double>" and Pipeline.from_json(good.to_json()).run(df).first()["c"] == 2.0
    for bad in ({"filter": "nope"}, {"filter": "calculate", "args": {"expression": "x", "name": "c"}}, {"filter": "select", "args": {"columns": ["zzz"]}}, {"filter": "select", "args": {"what": 1}}):
        with pytest.raises(PipelineError, match="step 0"):
            Pipeline([bad]).preflight(df)


def test_structure(spark):
    s = Structure().create_table(spark, "a/cells", (2, 3)).create_column("a/cells", "v", "int32", 7).create_grid(spark, "a/grid", Grid((2, 2, 1)))
    assert s.table("a/cells").where("v = 7").count() == 6 and s.grids["a/grid"].size == 4
    s = s.copy("a", "b").rename("b/cells:v", "w").copy("a/cells:v", "b/cells:u")
    assert s.table("b/cells").columns == ["idx", "w", "u"]
    s = s.reshape("b/cells", (8,)).delete("a")
    assert set(s.tables) == {"b/cells", "b/grid"} and s.table("b/cells").where("w = 0").count() == 2
    for bad in (lambda: s.delete("zzz"), lambda: s.table("zzz"), lambda: s.create_table(spark, "b/cells", (1,)), lambda: s.rename("b/cells:zzz", "q"), lambda: s.create_column("b/cells", "w", "int32", 1)):
        with pytest.raises(StructureError):
            bad()


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, float(i)) for i in range(10)], "a int, b double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, b double").parquet(str(tmp_path / "in"))
    steps = Pipeline([{"filter": "threshold", "args": {"where": {"column": "a", "op": ">", "value": 6}}}, {"filter": "filter", "args": {"mask": "mask"}}])
    q = stateless.on_stream(steps, stream).writeStream.format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("out").count() == 3
    with pytest.raises(PipelineError):
        stateless.on_stream(Pipeline([{"filter": "standardize", "args": {"column": "a"}}]), stream)


def test_dbscan_query_takes_all_customers(spark, tmp_path):
    rng = np.random.default_rng(3)
    keys = [*range(0, 40), *range(1480, 1520), *range(9000, 9060)]
    at = {k: (round(float(b), 2), int(n)) for k, b, n in zip(keys, rng.uniform(-1000, 4000, len(keys)), rng.integers(0, 6, len(keys)))}
    spark.createDataFrame([(k, *v) for k, v in at.items()], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["idx"]: r["cluster"] for r in catalog.queries()["dbscan"](spark, str(tmp_path)).collect()}
    d = {(a, b): math.hypot(at[a][0] / 100 - at[b][0] / 100, at[a][1] - at[b][1]) for a in keys for b in keys}
    core = [a for a in keys if sum(d[a, b] < 1 for b in keys) >= 3]
    want, clusters = dict.fromkeys(keys, 0), 0
    for a in core:
        if not want[a]:
            clusters += 1
            todo = [a]
            while todo:
                x = todo.pop()
                if not want[x]:
                    want[x] = clusters
                    todo += [b for b in core if d[x, b] < 1]
    for a in set(keys) - set(core):
        near = [(d[a, b], b) for b in core if d[a, b] < 1]
        want[a] = want[min(near)[1]] if near else 0
    assert clusters > 1 and any(want[k] for k in keys if k >= 1500) and got == want


def test_k_means_query_runs_until_centres_stay(spark):
    where = "/root/testdata/sf0.01"
    got = {r["idx"]: r["cluster"] for r in catalog.queries()["k_means"](spark, where).collect()}
    vectors = {r["idx"]: np.array(r["v"], dtype=float) for r in catalog._vectors(spark, where).collect()}
    centres = np.array([np.mean([v for i, v in vectors.items() if got[i] == k], axis=0) for k in range(1, 5)])
    assert all(np.linalg.norm(centres - v, axis=1).argmin() + 1 == got[i] for i, v in vectors.items())


def test_k_means_raises_when_centres_still_move(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "idx long, v array<double>")
    with pytest.raises(RuntimeError):
        cluster.k_means(df, "v", 2, iterations=1, centres=[[0.0], [1.0]])


def test_far_points_find_their_nearest(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 9.0), (4, 1.0, 0.0, 9.0), (5, 0.0, 1.0, 9.0)], "idx long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "idx long, v0 long, v1 long, v2 long")
    points = spark.createDataFrame([(0, 0.2, 0.2, 0.5), (1, 0.2, 0.2, 500.0), (2, 0.2, 0.2, -300.0)], "idx long, x double, y double, z double")
    got = {r["idx"]: (r["distance"], r["triangle"]) for r in mesh.vertex_triangle_distances(points, t, v, 1.0, most=2).collect()}
    assert got == {0: (0.5, 0), 1: (491.0, 1), 2: (-300.0, 0)}
    near = {r["idx"]: (r["nz"], r["distance"]) for r in iterate.nearest_points(points, v, 1.0, most=2).collect()}
    assert {i: n for i, (n, _) in near.items()} == {0: 0.0, 1: 9.0, 2: 0.0}
    assert math.isclose(near[1][1], math.sqrt(0.08 + 491.0**2))


def test_level_rounds_halves_as_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    prices = [198500.0, 297500.0, 24500.0, 25500.0, 1499.99, 500.0, 1500.0, 49500.0]
    spark.createDataFrame([(i, i % 7, p, "1-URGENT") for i, p in enumerate(prices)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("binary_dilate", "resample_rectilinear_grid", "zero_crossing"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        last = "sampled" if name.startswith("resample") else "made"
        want = {i: v for i, v in con.execute(f"SELECT idx, {last} FROM ({catalog.oracle_sql()[name]})").fetchall()}
        got = {r["idx"]: r[last] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert {i: got[i] for i in want} == want


def test_cells_without_name_spread_over_tasks(spark):
    cells = spark.range(4000).select(F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 10 == 1, F.col("id")).cast("long").alias("_c"))
    names = spark.range(1, 4000, 20).select(F.col("id").alias("_c"), F.lit("x").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold_ = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = segment._with_names(cells, names, "_c", 1)
        assert out.where("n = 'x'").count() == 200 and out.count() == 4000
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 1600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold_)


def test_all_pairs_of_many_equal_points(spark):
    at = spark.range(20_000).select(F.col("id").alias("idx"), (F.col("id") % 20).alias("c"), F.array((F.col("id") % 20).cast("double"), F.lit(1.0)).alias("v"))
    began = time.monotonic()
    assert {r["n"] for r in cluster.eps_neighbors(at, "v", 1.5).where("idx % 20 between 1 and 18").select("n").distinct().collect()} == {3000}
    near = {r["silhouette"] for r in cluster.silhouette(at, "v", "c").select("silhouette").distinct().collect()}
    assert near == {1.0}
    placed, centres = cluster.k_medoids(at, "v", 2, centres=[[0.0, 1.0], [19.0, 1.0]])
    assert centres == [[4.0, 1.0], [14.0, 1.0]] and placed.where("cluster = 1").count() == 10_000
    assert time.monotonic() - began < 90


def test_eps_neighbors_of_null_is_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "idx long, v array<double>")
    assert {r["idx"]: r["n"] for r in cluster.eps_neighbors(df, "v", 5.0).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r["idx"]: r["n"] for r in cluster.eps_neighbors(df, "v", 5.0 + 1e-14).collect()} == {1: 2, 2: 2, 3: 0}


def test_k_medoids_query_runs_until_medoids_stay(spark):
    where = "/root/testdata/sf0.01"
    vectors = {r["idx"]: np.array(r["v"], dtype=float) for r in catalog._vectors(spark, where).collect()}
    got = {r["idx"]: r["cluster"] for r in catalog.queries()["k_medoids"](spark, where).collect()}
    ids = {k: [i for i in vectors if got[i] == k] for k in (1, 2, 3)}
    medoid = {}
    for k, mine in ids.items():
        x = np.stack([vectors[i] for i in mine])
        medoid[k] = x[np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1).argmin()]
    assert all(min(medoid, key=lambda k: np.linalg.norm(medoid[k] - v)) == got[i] for i, v in vectors.items())


def test_feature_clustering_counts_many_pairs(spark):
    n = 9000
    f = spark.range(n).select(F.col("id").alias("fid"), F.lit(1).alias("phase"), F.col("id").cast("double").alias("centroid_x"), F.lit(0.0).alias("centroid_y"), F.lit(0.0).alias("centroid_z"))
    began = time.monotonic()
    got = {r["bin"]: (r["lo"], r["hi"], r["count"]) for r in neighbors.feature_clustering(f, 10, "phase", 1).collect()}
    d = np.arange(1, n)
    at = np.minimum(np.floor((d - 1) / ((n - 2) / 10)), 9).astype(int)
    assert got == {k: (1.0, n - 1.0, int((n - d)[at == k].sum())) for k in range(10)}
    assert neighbors.feature_clustering(f.where("fid = 0"), 10, "phase", 1).count() == 0
    assert time.monotonic() - began < 40


def test_graph_steps_broadcast_few_rows_only(spark):
    from gridloom.operators.components import small

    shown = lambda n: small(spark.range(n))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in shown(1000).lower() and "broadcast" not in shown(100_000).lower()
