"""Orientations of grids, and readers of instrument files and images."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import orientation
from gridloom.grid import Grid
from gridloom.operators import crystal
from gridloom.sources import binary, instruments


def turned(degrees):
    h = np.radians(degrees) / 2
    return [0.0, 0.0, float(np.sin(h)), float(np.cos(h))]


def test_segments_averages_and_neighbors(spark):
    rows = [(i, turned(5.0 + 0.5 * (i % 2)) if i % 6 < 3 else turned(30.0), 1) for i in range(12)]
    cells = spark.createDataFrame(rows, "idx long, q array<double>, phase int")
    grid = Grid((6, 2, 1))
    out = crystal.misorientation_segment(cells, grid, "q", np.radians(5), "cubic", "phase").cache()
    assert [r["fid"] for r in out.orderBy("idx").collect()] == [1, 1, 1, 2, 2, 2] * 2
    assert crystal.c_axis_segment(cells, grid, "q", np.radians(5)).select("fid").distinct().count() == 1
    mean = crystal.average_orientations(out, "q").orderBy("fid").collect()
    assert np.degrees(2 * np.arccos(mean[0]["q"][3])) == pytest.approx(5.25, abs=0.1)
    features = spark.createDataFrame([(r["fid"], list(r["q"])) for r in mean], "fid long, q array<double>")
    near = spark.createDataFrame([(1, [2]), (2, [1])], "fid long, neighbors array<long>")
    angles = crystal.neighbor_misorientations(features, near, "q").orderBy("fid").collect()
    assert angles[0]["average"] == pytest.approx(24.75, abs=0.1) and angles[1]["misorientations"][0] == pytest.approx(angles[0]["average"])
    assert crystal.average_c_axes(out.withColumn("hex", F.lit(True)), "q", "hex").first()["c_axis"][2] == pytest.approx(1)


def test_twins(spark):
    h = np.radians(60) / 2
    s = float(np.sin(h) / np.sqrt(3))
    twin = [s, s, s, float(np.cos(h))]
    features = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 1.0]), (2, twin), (3, turned(20.0))], "fid long, q array<double>")
    near = spark.createDataFrame([(1, [2, 3]), (2, [1, 3]), (3, [1, 2])], "fid long, neighbors array<long>")
    parents = {r["fid"]: r["parent"] for r in crystal.merge_twins(features, near, "q").collect()}
    assert parents == {1: 1, 2: 1, 3: 2}
    assert orientation.SYMMETRY["triclinic"]() == [(0.0, 0.0, 0.0, 1.0)]


def png(block):
    h, w, c = block.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows, before = b"", np.zeros((w * c,), np.uint8)
    for y in range(h):
        line = block[y].ravel()
        how = y % 3  # none, sub, up
        left = np.concatenate([np.zeros(c, np.uint8), line[:-c]])
        rows += bytes([how]) + (line - (0, left, before)[how]).astype(np.uint8).tobytes()
        before = line
    color = {1: 0, 3: 2, 4: 6}[c]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 256, (4, 5, 3)).astype(np.uint8) for _ in range(3)]
    for i, b in enumerate(blocks):
        (tmp_path / f"s{i}.png").write_bytes(png(b))
    cells, grid = instruments.image_stack(spark, str(tmp_path), "*.png")
    assert grid.dims == (5, 4, 3)
    got = np.array([r["channels"] for r in cells.orderBy("idx").collect()]).reshape(3, 4, 5, 3)
    assert (got == np.stack(blocks)).all()
    slices = instruments.image_slices(cells.withColumn("v", F.col("channels")[0]), grid, "v").orderBy("part").collect()
    (tmp_path / "a.pgm").write_bytes(slices[1]["content"])
    back = [r["channels"][0] for r in instruments.read_images(spark, str(tmp_path / "a.pgm")).orderBy("idx").collect()]
    assert back == blocks[1][:, :, 0].ravel().tolist()


def test_ipf_colors(spark):
    h = np.radians(45) / 2
    axis = np.arccos(1 / np.sqrt(3)) / 2
    rows = [[0.0, 0.0, 0.0, 1.0], [float(np.sin(h)), 0.0, 0.0, float(np.cos(h))], [float(np.sin(axis) / np.sqrt(2)), float(-np.sin(axis) / np.sqrt(2)), 0.0, float(np.cos(axis))]]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "i int, q array<double>")
    got = [list(r[0]) for r in df.orderBy("i").select(orientation.cubic_ipf_color(F.col("q"))).collect()]
    assert got == [[255, 0, 0], [0, 255, 0], [0, 0, 255]]


def test_meta_image(spark, tmp_path):
    head = "ObjectType = Image\nNDims = 2\nDimSize = 3 2\nElementSpacing = 0.5 2\nElementType = MET_USHORT\nElementDataFile = LOCAL\n"
    (tmp_path / "a.mha").write_bytes(head.encode() + np.arange(6, dtype="<u2").tobytes())
    cells, grid = instruments.read_mha(spark, str(tmp_path / "a.mha"))
    assert grid == Grid((3, 2, 1), (0.5, 2.0, 1.0)) and [r["channels"][0] for r in cells.orderBy("idx").collect()] == list(range(6))


def test_instrument_files(spark, tmp_path):
    (tmp_path / "p.ini").write_text("[EnsembleInfo]\nNumber_Phases=1\n[1]\nCrystalStructure=Cubic_High\nPhaseType=PrimaryPhase\n")
    assert [r["phase_type"] for r in instruments.read_ensemble_info(spark, str(tmp_path / "p.ini")).orderBy("phase").collect()] == ["Unknown_Phase_Type", "PrimaryPhase"]
    (tmp_path / "a.ang").write_text("# HEADER\n# X\n1.0 0.5 0.25 0 0 99.5 0.9 1\n1.1 0.6 0.35 1 0 98.5 0.8 2\n")
    rows = instruments.read_ang(spark, str(tmp_path / "a.ang")).orderBy("idx").collect()
    assert [(r["idx"], r["phase"]) for r in rows] == [(0, 1), (1, 2)] and rows[1]["x"] == 1.0
    (tmp_path / "c.ctf").write_text("Channel Text File\nXCells\t2\nPhase\tX\tY\tBands\tError\tEuler1\tEuler2\tEuler3\tMAD\tBC\tBS\n1\t0,5\t0\t8\t0\t180\t90\t0\t0.4\t100\t50\n")
    row = instruments.read_ctf(spark, str(tmp_path / "c.ctf")).first()
    assert row["x"] == 0.5 and row["euler"][0] == pytest.approx(np.pi, abs=1e-6) and row["bc"] == 100
    np.arange(6, dtype="<f4").tofile(tmp_path / "v.vol")
    (tmp_path / "v.vgi").write_text("{volume1}\n[file1]\nSize = 3 2 1\nName = v.vol\n[geometry]\nresolution = 0.5 0.5 2\n")
    cells, grid = instruments.read_volume_graphics(spark, str(tmp_path / "v.vgi"))
    assert grid == Grid((3, 2, 1), (0.5, 0.5, 2.0)) and cells.agg(F.sum("value")).first()[0] == 15
    lines = instruments.inl_lines(spark.createDataFrame([(0, [0.1, 0.2, 0.3], 1, 1)], "idx long, e array<double>, fid int, phase int"), Grid((1, 1, 1)), "e")
    binary.write_lines(lines, str(tmp_path / "inl"))
    assert spark.read.text(str(tmp_path / "inl")).where("value like '0.100000 0.200000 0.300000 0.5%'").count() == 1
    assert instruments.execute_process(["sh", "-c", "echo hi; exit 3"], 10, str(tmp_path / "log")) == 3 and (tmp_path / "log").read_text() == "hi\n"
