"""Text and binary formats of instruments, images, and external commands."""

from __future__ import annotations

import configparser
import struct
import subprocess
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.sources.binary import _decoded, _files, _lines, _text_file, read_raw
from gridloom.sources.text import _numbered


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_ensemble_info(spark: SparkSession, path: str) -> DataFrame:
    """Phases of an INI file: section EnsembleInfo with Number_Phases, then a section for each number from 1."""
    ini = configparser.ConfigParser()
    ini.read_string(_whole(spark, path))
    n = ini.getint("EnsembleInfo", "Number_Phases")
    rows = [(0, "Unknown_Crystal_Structure", "Unknown_Phase_Type"), *((k, ini.get(str(k), "CrystalStructure"), ini.get(str(k), "PhaseType")) for k in range(1, n + 1))]
    return spark.createDataFrame(rows, "phase int, crystal_structure string, phase_type string")


def read_volume_graphics(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells (idx, value: float) and the grid of a .vgi header; the .vol file beside it is read where it names it."""
    values: dict[str, str] = {}
    for line in _whole(spark, path).splitlines():
        name, sep, value = line.partition("=")
        if sep:
            values.setdefault(name.strip().lower(), value.strip())
    dims = tuple(int(x) for x in values["size"].split())
    spacing = tuple(float(x) for x in values.get("resolution", "1 1 1").split())
    origin = tuple(float(x) for x in values.get("position", "0 0 0").split())
    raw = path.rsplit("/", 1)[0] + "/" + values["name"]
    return read_raw(spark, raw, "float32"), Grid(dims, spacing, origin)


def read_ang(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an .ang scan: euler (array), x, y, iq, ci, phase; header lines begin with #."""
    rows = _numbered(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    at = rows.select("line", f.alias("f"))
    first = at.agg(F.min("line")).first()[0] or 0
    number = lambda i: F.col("f")[i].cast("float")
    return at.select((F.col("line") - first).cast("long").alias("idx"), F.array(number(0), number(1), number(2)).alias("euler"), number(3).alias("x"), number(4).alias("y"), number(5).alias("iq"), number(6).alias("ci"), F.col("f")[7].cast("int").alias("phase"))


def read_ctf(spark: SparkSession, path: str, radians: bool = True) -> DataFrame:
    """Rows of a .ctf scan: the table after the line of column names."""
    lines = _whole(spark, path).splitlines()[:1000]
    head = next(i for i, x in enumerate(lines) if x.split("\t")[0] == "Phase")
    names = lines[head].split("\t")
    f = F.split("value", "\t")
    at = _numbered(spark, path).where((F.col("line") > head) & (F.trim("value") != ""))
    column = lambda n: F.regexp_replace(f[names.index(n)], ",", ".").cast("float")
    angle = (lambda c: F.radians(c).cast("float")) if radians else (lambda c: c)
    return at.select((F.col("line") - head - 1).cast("long").alias("idx"), column("Phase").cast("int").alias("phase"), column("X").alias("x"), column("Y").alias("y"), F.array(*(angle(column(f"Euler{k}")) for k in (1, 2, 3))).alias("euler"), *(column(n).alias(n.lower()) for n in ("Bands", "Error", "MAD", "BC", "BS") if n in names))


def inl_lines(cells: DataFrame, grid: Grid, euler: str, feature: str = "fid", phase: str = "phase") -> DataFrame:
    """phi1 PHI phi2 x y z feature phase symmetry: a line for each cell, under a header of the grid's numbers."""
    head = ["# File written by gridloom", *(f"# {a}_{n}: {v}" for n, t in (("DIM", grid.dims), ("STEP", grid.spacing), ("MIN", grid.origin)) for a, v in zip("XYZ", t)), "# phi1 PHI phi2 x y z FeatureId PhaseId Symmetry"]
    c = grid.with_xyz(cells)
    angles = [F.format_string("%.6f", F.col(euler)[i].cast("double")) for i in range(3)]
    place = [F.format_string("%.6f", grid.centre(k, F.col(a))) for k, a in enumerate("xyz")]
    line = F.concat_ws(" ", *angles, *place, F.col(feature).cast("string"), F.col(phase).cast("string"), F.lit("0"))
    return _text_file([_lines(cells.sparkSession, *head), c.select(F.col("idx").alias("line"), line.alias("value"))])


def _png(content: bytes) -> np.ndarray:
    """Samples (rows, columns, channels) of a PNG of 8 or 16 bits, not interlaced, without a palette."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data = 8, b""
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += content[at + 8 : at + 8 + n]
        at += 12 + n
    if depth not in (8, 16) or color == 3 or interlace:
        raise ValueError("a kind of PNG that isn't read")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    unit = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 1 + width * unit)
    out = np.zeros((height, width * unit), dtype=np.uint8)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:]
        up = out[y - 1] if y else np.zeros_like(line)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = line + up
        else:
            row, above = bytearray(line.tobytes()), up.tobytes()
            for i in range(len(row)):
                left = row[i - unit] if i >= unit else 0
                corner = above[i - unit] if i >= unit else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    guess = min((left, above[i], corner), key=lambda v: abs(p - v))
                row[i] = (row[i] + guess) & 255
            out[y] = np.frombuffer(bytes(row), dtype=np.uint8)
    return out.reshape(height, width, channels) if depth == 8 else out.view(">u2").reshape(height, width, channels).astype(np.uint16)


def _netpbm(content: bytes) -> np.ndarray:
    words, at = [], 0
    while len(words) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        words.append(content[at:end])
        at = end
    channels = {b"P5": 1, b"P6": 3}[words[0]]
    width, height, most = map(int, words[1:])
    return np.frombuffer(content, dtype=">u2" if most > 255 else "u1", offset=at + 1, count=width * height * channels).reshape(height, width, channels).astype(np.int32)


def read_images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, height, width, idx, channels): pixels of PNG and binary PGM or PPM files, a row each, idx row by row."""

    def decode(path, content):
        import pandas as pd

        block = _png(content) if content[:1] == b"\x89" else _netpbm(content)
        h, w, c = block.shape
        flat = block.reshape(h * w, c).astype(np.int32)
        for at in range(0, h * w, 1 << 16):
            some = flat[at : at + (1 << 16)]
            yield pd.DataFrame({"path": path, "height": h, "width": w, "idx": np.arange(at, at + len(some)), "channels": list(some)})

    return _decoded(_files(spark, path, pattern), decode, "path string, height int, width int, idx long, channels array<int>")


def image_stack(spark: SparkSession, path: str, pattern: str | None = None, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> tuple[DataFrame, Grid]:
    """Cells (idx, channels) of images of one size, one a layer in the order of their names."""
    from gridloom.operators.threshold import ranks

    pixels = read_images(spark, path, pattern)
    sizes = pixels.groupBy("path").agg(F.max("height").alias("h"), F.max("width").alias("w")).collect()
    if len({(r["h"], r["w"]) for r in sizes}) != 1:
        raise ValueError("images of different sizes")
    grid = Grid((sizes[0]["w"], sizes[0]["h"], len(sizes)), tuple(spacing), tuple(origin))
    layer = ranks(pixels, "path").withColumnRenamed("_rank", "z")
    return pixels.join(layer, "path").select((F.col("z") * (grid.dims[0] * grid.dims[1]) + F.col("idx")).alias("idx"), "channels"), grid


def image_slices(cells: DataFrame, grid: Grid, value: str) -> DataFrame:
    """(part, content): a binary PGM file for each layer; values must be whole numbers from 0 to 255."""
    w, h, _ = grid.dims

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("idx")
        head = f"P5\n{w} {h}\n255\n".encode()
        return pd.DataFrame({"part": [int(frame["z"].iloc[0])], "content": [head + frame[value].to_numpy().astype(np.uint8).tobytes()]})

    return grid.with_xyz(cells).select("idx", "z", value).groupBy("z").applyInPandas(run, "part long, content binary")


def read_mha(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells (idx, channels) and the grid of a MetaImage file that holds its own samples, plain or compressed."""
    kinds = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}

    def header(content: bytes) -> tuple[dict, int]:
        values, at = {}, 0
        while "ElementDataFile" not in values:
            end = content.index(b"\n", at)
            name, _, value = content[at:end].decode("latin-1").partition("=")
            values[name.strip()] = value.strip()
            at = end + 1
        return values, at

    head, _ = header(bytes(_files(spark, path).select(F.substring("content", 1, 4096)).first()[0]))
    three = lambda name, f, pad: tuple([f(x) for x in head[name].split()] + [pad] * (3 - len(head[name].split()))) if name in head else (pad,) * 3
    origin = next((n for n in ("Offset", "Position", "Origin") if n in head), "Offset")
    grid = Grid(three("DimSize", int, 1), three("ElementSpacing", float, 1.0), three(origin, float, 0.0))

    def decode(path, content):
        import pandas as pd

        values, at = header(content)
        data = content[at:] if values.get("CompressedData", "False") != "True" else zlib.decompress(content[at:])
        order = ">" if values.get("BinaryDataByteOrderMSB", values.get("ElementByteOrderMSB", "False")) == "True" else "<"
        n = int(values.get("ElementNumberOfChannels", 1))
        rows = np.frombuffer(data, dtype=order + kinds[values["ElementType"]]).reshape(-1, n).astype(np.float64)
        for start in range(0, len(rows), 1 << 16):
            some = rows[start : start + (1 << 16)]
            yield pd.DataFrame({"idx": np.arange(start, start + len(some)), "channels": list(some)})

    return _decoded(_files(spark, path), decode, "idx long, channels array<double>"), grid


def read_hdf5_dataset(path: str, dataset: str, spark: SparkSession) -> DataFrame:
    """(idx, value) of a dataset, rows by its first axis; needs h5py, which reads through the driver's file system."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("h5py is not installed") from e
    with h5py.File(path, "r") as f:
        block = np.asarray(f[dataset])
    flat = block.reshape(len(block), -1)
    kind = "double" if flat.dtype.kind == "f" else "long"
    rows = [(i, r.tolist()) for i, r in enumerate(flat)]
    return spark.createDataFrame(rows, f"idx long, value array<{kind}>")


def execute_process(arguments: list[str], timeout: float | None = None, log: str | None = None) -> int:
    """Runs a command on the driver and returns its code; its output goes to the log file."""
    done = subprocess.run(arguments, capture_output=True, timeout=timeout)
    if log:
        with open(log, "wb") as out:
            out.write(done.stdout + done.stderr)
    return done.returncode
