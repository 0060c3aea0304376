"""Named tables with geometry: creating, renaming, moving, copying and deleting tables and columns.

A structure is a mapping of paths to tables; each has a tuple shape, and columns of one table have its row count.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import TYPES, cast_to
from gridloom.grid import Grid


class StructureError(ValueError):
    """A path that doesn't exist, exists already, or doesn't fit."""


@dataclass(frozen=True)
class Structure:
    """Tables by path, their tuple shapes, and grids by path."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    shapes: dict[str, tuple[int, ...]] = field(default_factory=dict)
    grids: dict[str, Grid] = field(default_factory=dict)

    def table(self, path: str) -> DataFrame:
        if path not in self.tables:
            raise StructureError(f"no table {path!r}")
        return self.tables[path]

    def put(self, path: str, df: DataFrame, shape: tuple[int, ...] | None = None, grid: Grid | None = None) -> Structure:
        shapes = self.shapes | ({path: shape} if shape else {})
        return replace(self, tables=self.tables | {path: df}, shapes=shapes, grids=self.grids | ({path: grid} if grid else {}))

    def create_table(self, spark: SparkSession, path: str, shape: tuple[int, ...]) -> Structure:
        """idx from 0 and no other column."""
        if path in self.tables:
            raise StructureError(f"{path!r} exists")
        n = 1
        for s in shape:
            n *= s
        return self.put(path, spark.range(n).withColumnRenamed("id", "idx"), tuple(shape))

    def create_grid(self, spark: SparkSession, path: str, grid: Grid) -> Structure:
        return self.create_table(spark, path, grid.dims[::-1]).put(path, grid.cells(spark), grid.dims[::-1], grid)

    def create_column(self, path: str, name: str, kind: str, value, components: int = 1) -> Structure:
        df = self.table(path)
        if name in df.columns:
            raise StructureError(f"{path!r} has a column {name!r}")
        one = F.lit(value).cast("string") if kind == "string" else cast_to(F.lit(value), TYPES[kind])
        return self.put(path, df.withColumn(name, one if components == 1 else F.array(*[one] * components)))

    def create_ensemble(self, spark: SparkSession, path: str, phases: list[tuple[int, int, str]]) -> Structure:
        """Row 0 is the unknown phase; then (crystal structure, phase type, name) from 1."""
        rows = [(0, 999, 999, "Unknown"), *((i + 1, *p) for i, p in enumerate(phases))]
        return self.put(path, spark.createDataFrame(rows, "phase int, crystal_structure long, phase_type long, phase_name string"), (len(rows),))

    def delete(self, *paths: str) -> Structure:
        """Tables (and all below them), or columns as table:column."""
        tables = dict(self.tables)
        for p in paths:
            table, _, column = p.partition(":")
            hit = [t for t in tables if t == table or t.startswith(table + "/")]
            if not hit or column and column not in tables[table].columns:
                raise StructureError(f"nothing at {p!r}")
            if column:
                tables[table] = tables[table].drop(column)
            else:
                for t in hit:
                    del tables[t]
        keep = lambda d: {k: v for k, v in d.items() if k in tables}
        return Structure(tables, keep(self.shapes), keep(self.grids))

    def rename(self, path: str, name: str) -> Structure:
        """The last part of a table's path, or a column, gets another name."""
        table, _, column = path.partition(":")
        if column:
            df = self.table(table)
            if column not in df.columns or name in df.columns:
                raise StructureError(f"can't rename {path!r} to {name!r}")
            return self.put(table, df.withColumnRenamed(column, name))
        new = "/".join([*table.split("/")[:-1], name])
        return self.copy(table, new).delete(table)

    def copy(self, path: str, to: str) -> Structure:
        """A table and all below it under another path, or a column within its table or into one of equal shape."""
        table, _, column = path.partition(":")
        other, _, new = to.partition(":")
        if column:
            source, target = self.table(table), self.table(other)
            if table == other:
                return self.put(table, source.withColumn(new, F.col(column)))
            if self.shapes.get(table) != self.shapes.get(other):
                raise StructureError(f"{table!r} and {other!r} have different shapes")
            return self.put(other, target.join(source.select("idx", F.col(column).alias(new or column)), "idx"))
        hit = [t for t in self.tables if t == table or t.startswith(table + "/")]
        if not hit or to in self.tables:
            raise StructureError(f"can't copy {path!r} to {to!r}")
        out = self
        for t in hit:
            out = out.put(to + t[len(table):], self.tables[t], self.shapes.get(t), self.grids.get(t))
        return out

    def move(self, path: str, to: str) -> Structure:
        """A column into a table of equal shape."""
        table, _, column = path.partition(":")
        return self.copy(path, f"{to}:{column}").delete(path)

    def reshape(self, path: str, shape: tuple[int, ...], fill=0) -> Structure:
        """Rows up to the new shape's count; rows that are new get fill in every column."""
        df = self.table(path)
        n = 1
        for s in shape:
            n *= s
        kinds = dict(df.dtypes)
        frame = df.sparkSession.range(n).withColumnRenamed("id", "idx").withColumn("idx", F.col("idx").cast(kinds["idx"]))
        rest = [c for c in df.columns if c != "idx"]
        marked = df.withColumn("_here", F.lit(True))
        out = frame.join(marked, "idx", "left").select("idx", *(F.when(F.col("_here"), F.col(c)).otherwise(F.lit(fill).cast(kinds[c]) if not kinds[c].startswith("array") else F.lit(None)).alias(c) for c in rest))
        return self.put(path, out, tuple(shape))


def concatenate(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several tables in the order given, numbered anew: idx is the old one plus the counts before."""
    out, before = None, 0
    for df in tables:
        part = df.select((F.col("idx") + before).alias("idx"), *columns)
        out = part if out is None else out.unionByName(part)
        before += df.count()
    return out


def append_grids(parts: list[tuple[DataFrame, Grid]], axis: int, columns: list[str], mirror: bool = False) -> tuple[DataFrame, Grid]:
    """Grids one behind the other along an axis; mirror turns the joined grid around along it."""
    first = parts[0][1]
    for _, g in parts[1:]:
        if any(g.dims[k] != first.dims[k] for k in range(3) if k != axis):
            raise StructureError("dimensions differ on another axis")
    total = sum(g.dims[axis] for _, g in parts)
    grid = Grid(tuple(total if k == axis else n for k, n in enumerate(first.dims)), first.spacing, first.origin)
    out, before = None, 0
    for df, g in parts:
        at = [F.col(a) for a in "xyz"]
        at[axis] = at[axis] + before
        if mirror:
            at[axis] = F.lit(total - 1) - at[axis]
        part = g.with_xyz(df).select(grid.index(*at).alias("idx"), *columns)
        out = part if out is None else out.unionByName(part)
        before += g.dims[axis]
    return out, grid
