"""Regular grids as tables: a cell is a row with idx, and x, y, z follow from idx and the grid's dimensions.

Stencils run on tiles. A tile is a block of cells with a rim as wide as the stencil reaches; one shuffle brings each
tile's cells together, numpy works on the dense block, and the block's own cells come back. A task holds one tile,
whose size is a parameter, whatever the grid's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Grid:
    """Dimensions, spacing and origin of a regular grid; x varies fastest."""

    dims: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def size(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    def x(self, idx: str = "idx") -> Column:
        return F.pmod(F.col(idx), F.lit(self.dims[0])).cast("long")

    def y(self, idx: str = "idx") -> Column:
        return F.pmod(F.floor(F.col(idx) / self.dims[0]), F.lit(self.dims[1])).cast("long")

    def z(self, idx: str = "idx") -> Column:
        return F.floor(F.col(idx) / (self.dims[0] * self.dims[1])).cast("long")

    def index(self, x: Column, y: Column, z: Column) -> Column:
        return (x + y * self.dims[0] + z * (self.dims[0] * self.dims[1])).cast("long")

    def with_xyz(self, cells: DataFrame, idx: str = "idx") -> DataFrame:
        return cells.withColumns({"x": self.x(idx), "y": self.y(idx), "z": self.z(idx)})

    def centre(self, axis: int, at: Column) -> Column:
        return self.origin[axis] + (at + 0.5) * self.spacing[axis]

    def placed(self, origin: tuple[float, float, float] | None = None, spacing: tuple[float, float, float] | None = None) -> Grid:
        """The same cells with another origin or spacing."""
        return replace(self, origin=origin or self.origin, spacing=spacing or self.spacing)

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.with_xyz(spark.range(self.size).withColumnRenamed("id", "idx"))


def _tiles_of(n: int, tile: int, rim: int, at: Column) -> Column:
    """Numbers of the tiles along an axis whose block or rim holds the coordinate."""
    last = (n - 1) // tile
    low = F.greatest(F.lit(0), F.floor((at - rim) / tile)).cast("int")
    high = F.least(F.lit(last), F.floor((at + rim) / tile)).cast("int")
    return F.sequence(low, high)


def map_tiles(cells: DataFrame, grid: Grid, inputs: list[str], outputs: dict[str, str], compute: Callable, rim: int | tuple[int, int, int] = 1, tile: tuple[int, int, int] = (64, 64, 64), carry: list[str] | None = None) -> DataFrame:
    """(idx, carry, outputs): compute(arrays, inside, origin) on each tile, its own cells kept.

    arrays: the inputs as dense (z, y, x) blocks, rim included; inside: which places of the block are cells of the
    table; origin: coordinates (x, y, z) of the block's first place. compute returns an array for each output.
    Cells missing from the table are False in inside and 0 in arrays.
    """
    rims = (rim,) * 3 if isinstance(rim, int) else rim
    carry = carry or []
    at = (grid.x(), grid.y(), grid.z())
    key = [_tiles_of(n, t, r, a) for n, t, r, a in zip(grid.dims, tile, rims, at)]
    columns = ["idx", *dict.fromkeys([*inputs, *carry])]
    dealt = cells.select(*columns, key[0].alias("_tx"), key[1].alias("_ty"), key[2].alias("_tz"))
    for k in ("_tx", "_ty", "_tz"):
        dealt = dealt.withColumn(k, F.explode(k))
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    schema = T.StructType([T.StructField("idx", T.LongType())] + [T.StructField(c, kinds[c]) for c in carry])
    for name, kind in outputs.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    nx, ny, _ = grid.dims

    def run(key, frame):
        import pandas as pd

        first = [k * t - r for k, t, r in zip(key, tile, rims)]
        shape = [t + 2 * r for t, r in zip(tile, rims)][::-1]
        idx = frame["idx"].to_numpy(np.int64)
        xyz = (idx % nx, idx // nx % ny, idx // (nx * ny))
        low = [int(c.min()) for c in xyz]
        high = [int(c.max()) + 1 for c in xyz]
        first, shape = low, [h - lo for lo, h in zip(low, high)][::-1]
        place = (xyz[2] - first[2], xyz[1] - first[1], xyz[0] - first[0])
        inside = np.zeros(shape, dtype=bool)
        inside[place] = True
        arrays = {}
        for name in inputs:
            values = frame[name].to_numpy()
            block = np.zeros(shape, dtype=values.dtype if values.dtype != object else np.float64)
            block[place] = values
            arrays[name] = block
        made = compute(arrays, inside, tuple(first))
        own = np.ones(len(idx), dtype=bool)
        for c, k, t in zip(xyz, key, tile):
            own &= (c >= k * t) & (c < (k + 1) * t)
        out = {"idx": idx[own]} | {c: frame[c].to_numpy()[own] for c in carry}
        own_place = tuple(p[own] for p in place)
        return pd.DataFrame(out | {name: made[name][own_place] for name in outputs})

    return dealt.groupBy("_tx", "_ty", "_tz").applyInPandas(run, schema)


#: The six face neighbors in the order -z, -y, -x, +x, +y, +z.
FACES = ((0, 0, -1), (0, -1, 0), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))


def shifted(block: np.ndarray, dx: int, dy: int, dz: int, fill=0) -> np.ndarray:
    """The value at (x + dx, y + dy, z + dz) for each place; fill beyond the block."""
    out = np.full_like(block, fill)
    src, dst = [], []
    for d, n in zip((dz, dy, dx), block.shape):
        src.append(slice(max(0, d), min(n, n + d)))
        dst.append(slice(max(0, -d), min(n, n - d)))
    out[tuple(dst)] = block[tuple(src)]
    return out


def face_pairs(cells: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """One row for each face between two cells: idx, axis, the columns as a_* and b_*; b is on the positive side.

    Three equi-joins of the cells with themselves, moved by one along each axis.
    """
    out = None
    other = cells.select(F.col("idx").alias("_j"), *(F.col(c).alias(f"b_{c}") for c in columns))
    steps = (1, grid.dims[0], grid.dims[0] * grid.dims[1])
    for axis, step in enumerate(steps):
        coordinate = (grid.x(), grid.y(), grid.z())[axis]
        mine = cells.where(coordinate < grid.dims[axis] - 1).select("idx", (F.col("idx") + step).alias("_j"), *(F.col(c).alias(f"a_{c}") for c in columns))
        pairs = mine.join(other, "_j").drop("_j").withColumn("axis", F.lit(axis))
        out = pairs if out is None else out.unionByName(pairs)
    return out
