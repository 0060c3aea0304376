"""Binary files in and out: raw arrays, STL meshes, VTK and other grids, Abaqus input.

Readers take files through Spark's binaryFile source, so a path can be anywhere that Spark reads; a file is decoded in one
task. Writers make the bytes of a file, or of a part of it, on the executors and hand them to Spark's text or binary output.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import TYPES
from gridloom.grid import Grid
from gridloom.operators.threshold import ranks
from gridloom.session import cut

#: Numpy kinds of the element types.
NUMPY = {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float32": "f4", "float64": "f8"}
_ROWS = 1 << 16


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """decode(path, content) yields pandas frames of schema."""

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                yield from decode(path, content)

    return files.select("path", "content").mapInPandas(run, schema)


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_raw(spark: SparkSession, path: str, kind: str, components: int = 1, big_endian: bool = False, skip: int = 0) -> DataFrame:
    """(idx, value) of a headerless file of numbers; an incomplete last row is an error."""

    def decode(path, content):
        import pandas as pd

        values = np.frombuffer(content, dtype=(">" if big_endian else "<") + NUMPY[kind], offset=skip)
        if len(values) % components:
            raise ValueError(f"{path}: {len(values)} values are no whole number of rows of {components}")
        rows = values.astype(NUMPY[kind]).reshape(-1, components)
        for at in range(0, len(rows), _ROWS):
            some = rows[at : at + _ROWS]
            value = some[:, 0].astype(_wide(kind)) if components == 1 else list(some.astype(_wide(kind)))
            yield pd.DataFrame({"idx": np.arange(at, at + len(some)), "value": value})

    made = TYPES[kind] if kind != "uint64" else "bigint"
    return _decoded(_files(spark, path), decode, f"idx long, value {made if components == 1 else f'array<{made}>'}")


def _wide(kind: str) -> str:
    return {"uint8": "i2", "uint16": "i4", "uint32": "i8", "uint64": "i8"}.get(kind, NUMPY[kind])


def raw_bytes(df: DataFrame, value: str, kind: str, big_endian: bool = False, idx: str = "idx") -> DataFrame:
    """(part, content): the column's bytes in order of idx, a part for each range of idx."""
    dtype = (">" if big_endian else "<") + NUMPY[kind]
    ordered = df.select(idx, value).repartitionByRange(idx).sortWithinPartitions(idx)

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        made = []
        for f in frames:
            if len(f):
                rows = f[value].to_numpy()
                made.append((np.concatenate(rows) if isinstance(rows[0], (list, np.ndarray)) else rows).astype(dtype).tobytes())
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [b"".join(made)]})

    return ordered.mapInPandas(run, "part long, content binary").where(F.octet_length("content") > 0)


def save_parts(parts: DataFrame, path: str) -> None:
    """Writes (part, content) as one local file, part after part; for paths that the driver itself can open."""
    with open(path, "wb") as out:
        for row in parts.orderBy("part").toLocalIterator():
            out.write(row["content"])


def read_stl(spark: SparkSession, path: str, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles (v0, v1, v2, nx, ny, nz, part) of binary STL files; a folder's files become parts 0, 1, ...
    in the order of their names. Equal vertices are one, numbered in the order of x, y, z."""

    def decode(path, content):
        import pandas as pd

        n = int.from_bytes(content[80:84], "little")
        if len(content) < 84 + 50 * n:
            raise ValueError(f"{path}: not a whole binary STL file")
        raw = np.frombuffer(content, dtype=np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")]), count=n, offset=84)
        for at in range(0, n, _ROWS):
            some = raw[at : at + _ROWS]
            yield pd.DataFrame({"path": path, "k": np.arange(at, at + len(some)), **{f"n{a}": some["n"][:, i] for i, a in enumerate("xyz")}, **{f"c{i}": some["v"][:, i] * np.float32(scale) for i in range(9)}})

    schema = "path string, k long, nx float, ny float, nz float, " + ", ".join(f"c{i} float" for i in range(9))
    raw = cut(_decoded(_files(spark, path), decode, schema))
    corner = lambda j: F.struct(*(F.col(f"c{3 * j + i}").alias(a) for i, a in enumerate("xyz")))
    number = cut(ranks(raw.select(F.explode(F.array(*(corner(j) for j in range(3)))).alias("p")), "p"))
    out = raw.join(F.broadcast(ranks(raw, "path").withColumnRenamed("_rank", "part")), "path") if raw.select("path").distinct().count() > 1 else raw.withColumn("part", F.lit(0).cast("long"))
    for j in range(3):
        out = out.withColumn("p", corner(j)).join(number.withColumnRenamed("_rank", f"v{j}"), "p").drop("p")
    out = out.withColumn("_o", F.struct("part", "k"))
    out = out.join(ranks(out, "_o"), "_o")
    triangles = out.select(F.col("_rank").alias("idx"), "v0", "v1", "v2", "nx", "ny", "nz", "part")
    return number.select(F.col("_rank").alias("idx"), "p.x", "p.y", "p.z"), triangles


def stl_bytes(triangles: DataFrame, vertices: DataFrame, group: str | None = None, title: str = "mesh") -> DataFrame:
    """(group, content): binary STL files, one for each value of group or one in all. A group is one file and so one task's."""
    from gridloom.operators.mesh import triangle_normals, with_corners

    t = with_corners(triangle_normals(triangles, vertices), vertices)
    key = F.col(group) if group else F.lit(0)
    t = t.select(key.cast("long").alias("group"), "idx", F.col("normal"), "p0", "p1", "p2")

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("idx")
        raw = np.zeros(len(frame), dtype=np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")]))
        raw["n"] = np.nan_to_num(np.stack(frame["normal"]))
        raw["v"] = np.concatenate([np.stack(frame[c]) for c in ("p0", "p1", "p2")], axis=1)
        head = title.encode()[:80].ljust(80, b" ") + len(raw).to_bytes(4, "little")
        return pd.DataFrame({"group": [frame["group"].iloc[0]], "content": [head + raw.tobytes()]})

    return t.groupBy("group").applyInPandas(run, "group long, content binary")


def read_vtk_structured_points(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells (or points, if the file has no cell data) and the grid of a legacy VTK file, ascii or binary, scalars only."""
    head = _files(spark, path).select(F.substring(F.col("content"), 1, 4096).alias("h")).first()["h"]
    text = bytes(head).decode("latin-1")
    numbers = lambda word, f: tuple(f(x) for x in re.search(rf"{word}\s+(\S+)\s+(\S+)\s+(\S+)", text).groups())
    dims, origin = numbers("DIMENSIONS", int), numbers("ORIGIN", float)
    spacing = numbers("(?:SPACING|ASPECT_RATIO)", float)
    of_cells = "CELL_DATA" in text or "POINT_DATA" not in text
    grid = Grid(tuple(max(1, d - 1) for d in dims) if of_cells else dims, spacing, origin)
    kinds = {"float": "f4", "double": "f8", "int": "i4", "unsigned_char": "u1", "char": "i1", "short": "i2", "unsigned_short": "u2", "unsigned_int": "u4", "long": "i8"}

    def decode(path, content):
        import pandas as pd

        binary = re.search(rb"^BINARY", content, re.M)
        section = re.search(rb"(CELL|POINT)_DATA\s+(\d+)\s*\n", content)
        n, columns = int(section[2]), {}
        at = section.end()
        while found := re.compile(rb"\s*SCALARS\s+(\S+)\s+(\S+)(?:\s+(\d+))?\s*\n(?:LOOKUP_TABLE\s+\S+\s*\n)?").match(content, at):
            dtype, width = kinds[found[2].decode()], int(found[3] or 1)
            at = found.end()
            if binary:
                values = np.frombuffer(content, dtype=">" + dtype, count=n * width, offset=at).astype(dtype)
                at += values.nbytes
            else:
                words = content[at:].split(None, n * width)
                values = np.array(words[: n * width], dtype=np.float64).astype(dtype)
                at = len(content) - len(words[n * width]) if len(words) > n * width else len(content)
            columns[found[1].decode()] = values.reshape(n, width)[:, 0].astype(np.float64)
        for start in range(0, n, _ROWS):
            stop = min(n, start + _ROWS)
            yield pd.DataFrame({"idx": np.arange(start, stop), "values": [dict((k, float(v[i])) for k, v in columns.items()) for i in range(start, stop)]})

    names = re.findall(r"SCALARS\s+(\S+)", text)
    cells = _decoded(_files(spark, path), decode, "idx long, values map<string,double>")
    return cells.select("idx", *(F.col("values")[c].alias(c) for c in names)), grid


def _text_file(parts: list[DataFrame]) -> DataFrame:
    """(section, line, value) of lines, part after part."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("section"), "line", "value")
        out = p if out is None else out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str, one_file: bool = True) -> None:
    """Lines in the order of section and line: one file, made by one task, or files whose names follow the order."""
    ordered = lines.repartition(1).sortWithinPartitions("section", "line") if one_file else lines.orderBy("section", "line")
    ordered.select("value").write.mode("overwrite").text(path)


def _lines(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line long, value string")


def vtk_structured_points(cells: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """The lines of a legacy ascii VTK file of cell data; write_lines writes them."""
    spark = cells.sparkSession
    parts = [_lines(spark, "# vtk DataFile Version 3.0", "grid", "ASCII", "DATASET STRUCTURED_POINTS", "DIMENSIONS " + " ".join(str(d + 1) for d in grid.dims), "ORIGIN " + " ".join(map(str, grid.origin)), "SPACING " + " ".join(map(str, grid.spacing)), f"CELL_DATA {grid.size}")]
    return _text_file(parts + _vtk_columns(cells, columns))


def _vtk_columns(cells: DataFrame, columns: list[str]) -> list[DataFrame]:
    names = {"float": "float", "double": "double", "int": "int", "bigint": "long", "smallint": "short", "tinyint": "char", "boolean": "char"}
    kinds, parts = dict(cells.dtypes), []
    for c in columns:
        parts.append(_lines(cells.sparkSession, f"SCALARS {c} {names[kinds[c]]} 1", "LOOKUP_TABLE default"))
        value = F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)
        parts.append(cells.select(F.col("idx").alias("line"), value.cast("string").alias("value")))
    return parts


def vtk_rectilinear_grid(cells: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    spark = cells.sparkSession
    head = ["# vtk DataFile Version 2.0", "grid", "ASCII", "DATASET RECTILINEAR_GRID", "DIMENSIONS " + " ".join(str(d + 1) for d in grid.dims)]
    for a, n, s, o in zip("XYZ", grid.dims, grid.spacing, grid.origin):
        head += [f"{a}_COORDINATES {n + 1} float", " ".join(str(o + i * s) for i in range(n + 1))]
    return _text_file([_lines(spark, *head, f"CELL_DATA {grid.size}"), *_vtk_columns(cells, columns)])


def avizo_uniform(cells: DataFrame, grid: Grid, feature: str = "fid", units: str = "microns") -> DataFrame:
    spark = cells.sparkSession
    ends = " ".join(f"{o} {o + n * s}" for o, n, s in zip(grid.origin, grid.dims, grid.spacing))
    head = ["# AmiraMesh 3D ASCII 2.0", "define Lattice " + " ".join(map(str, grid.dims)), "Parameters {", f'    Units {{ Coordinates "{units}" }}', f"    BoundingBox {ends},", '    CoordType "uniform"', "}", "Lattice { int FeatureIds } = @1", "@1"]
    return _text_file([_lines(spark, *head), cells.select(F.col("idx").alias("line"), F.col(feature).cast("string").alias("value"))])


def avizo_rectilinear(cells: DataFrame, grid: Grid, feature: str = "fid", units: str = "microns") -> DataFrame:
    spark = cells.sparkSession
    head = ["# AmiraMesh 3D ASCII 2.0", "define Lattice " + " ".join(map(str, grid.dims)), f"define Coordinates {sum(grid.dims)}", "Parameters {", f'    Units {{ Coordinates "{units}" }}', '    CoordType "rectilinear"', "}", "Lattice { int FeatureIds } = @1", "Coordinates { float xyz } = @2", "@1"]
    tail = ["@2"] + [" ".join(str(o + i * s) for i in range(n)) for n, s, o in zip(grid.dims, grid.spacing, grid.origin)]
    return _text_file([_lines(spark, *head), cells.select(F.col("idx").alias("line"), F.col(feature).cast("string").alias("value")), _lines(spark, *tail)])


def los_alamos_fft(cells: DataFrame, grid: Grid, euler: str, feature: str = "fid", phase: str = "phase") -> DataFrame:
    """phi1 PHI phi2 in degrees, x y z from 1, feature, phase: a line for each cell."""
    c = grid.with_xyz(cells)
    angles = [F.format_string("%.3f", F.degrees(F.col(euler)[i].cast("double"))) for i in range(3)]
    line = F.concat_ws(" ", *angles, *((F.col(a) + 1).cast("string") for a in "xyz"), F.col(feature).cast("string"), F.col(phase).cast("string"))
    return _text_file([c.select(F.col("idx").alias("line"), line.alias("value"))])


def abaqus_hexahedra(cells: DataFrame, grid: Grid, feature: str = "fid", job: str = "job", stiffness: int = 250) -> dict[str, DataFrame]:
    """The lines of the files nodes, elems, elset, sects and master; nodes and elements count from 1."""
    spark = cells.sparkSession
    nx, ny, nz = (d + 1 for d in grid.dims)
    nodes = Grid((nx, ny, nz), grid.spacing, grid.origin).cells(spark)
    place = [F.format_string("%.6f", grid.origin[k] + F.col(a) * grid.spacing[k]) for k, a in enumerate("xyz")]
    node_lines = nodes.select(F.col("idx").alias("line"), F.concat_ws(", ", (F.col("idx") + 1).cast("string"), *place).alias("value"))
    c = grid.with_xyz(cells)
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    ids = [((F.col("x") + dx) + (F.col("y") + dy) * nx + (F.col("z") + dz) * (nx * ny) + 1).cast("string") for dx, dy, dz in corners]
    elements = c.select(F.col("idx").alias("line"), F.concat_ws(", ", (F.col("idx") + 1).cast("string"), *ids).alias("value"))
    some = cells.where(F.col(feature) > 0)
    order = F.col(feature).cast("long") * grid.size + F.col("idx")
    sets = some.select(order.alias("line"), F.concat_ws(", ", F.concat(F.lit("Grain"), F.col(feature)), (F.col("idx") + 1).cast("string")).alias("value"))
    section = F.concat(F.lit("*Solid Section, elset=Grain"), F.col(feature), F.lit("_set, material=Grain_Mat"), F.col(feature))
    sections = some.select(feature).distinct().select(F.col(feature).cast("long").alias("line"), section.alias("value"))
    master = _lines(spark, "*Heading", job, "*Include, Input = nodes.inp", "*Include, Input = elems.inp", "*Include, Input = elset.inp", "*Include, Input = sects.inp", f"*Hourglass Stiffness, {stiffness}")
    files = {"nodes": [_lines(spark, "*NODE"), node_lines], "elems": [_lines(spark, "*ELEMENT, TYPE=C3D8"), elements], "elset": [sets], "sects": [sections], "master": [master]}
    return {name: _text_file(parts) for name, parts in files.items()}
