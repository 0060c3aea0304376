"""Element-wise functions: casts, components, colors, angles, pixel math, filling. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark type for each element type, and the size in bits of those that Spark lacks.
TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "boolean": "boolean"}
UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32}


def cast_to(value: Column, kind: str) -> Column:
    """value as a Spark type; fractions are cut towards zero."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast(kind)
    return value.cast(kind)


def convert(value: Column, to: str) -> Column:
    """Element conversion; unsigned types wrap around, booleans are value != 0 and 1 or 0."""
    if to == "boolean":
        return value.cast("double") != 0
    if to in UNSIGNED:
        whole = cast_to(value.cast("double"), "bigint")
        return F.pmod(whole, F.lit(1 << UNSIGNED[to])).cast(TYPES[to])
    if to in ("int8", "int16", "int32"):
        bits = int(to[3:])
        whole = cast_to(value.cast("double"), "bigint")
        return (F.pmod(whole + (1 << (bits - 1)), F.lit(1 << bits)) - (1 << (bits - 1))).cast(TYPES[to])
    return cast_to(value.cast("double"), TYPES[to]) if to == "int64" else value.cast(TYPES[to])


def change_angle_representation(value: Column, to_degrees: bool) -> Column:
    return value * (180 / math.pi if to_degrees else math.pi / 180)


def combine_arrays(df: DataFrame, columns: list[str], name: str, normalize: bool = False) -> DataFrame:
    """Columns, scalars or arrays, as one array; normalize maps each component to [0, 1], constant ones to 0."""
    kinds = dict(df.dtypes)
    parts = F.concat(*(F.col(c) if kinds[c].startswith("array") else F.array(c) for c in columns))
    if not normalize:
        return df.withColumn(name, parts)
    sizes = df.select(*((F.max(F.size(c)) if kinds[c].startswith("array") else F.max(F.lit(1))).alias(c) for c in columns))
    wide = df.withColumn(name, parts)
    n = sum(v or 0 for v in sizes.first())
    limits = wide.agg(*(f(F.col(name)[i]).alias(f"_{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max))))
    scaled = [F.when(F.col(f"_hi{i}") == F.col(f"_lo{i}"), 0.0).otherwise((F.col(name)[i] - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}"))) for i in range(n)]
    return wide.crossJoin(F.broadcast(limits)).withColumn(name, F.array(*scaled)).select(*df.columns, name)


def split_array(df: DataFrame, column: str, components: list[int], suffix: str = "_") -> DataFrame:
    return df.withColumns({f"{column}{suffix}{i}": F.col(column)[i] for i in components})


def extract_component(df: DataFrame, column: str, component: int, name: str | None = None, remove: bool = False) -> DataFrame:
    out = df.withColumn(name, F.col(column)[component]) if name else df
    if remove:
        rest = F.concat(F.slice(column, F.lit(1), F.lit(component)), F.slice(F.col(column), F.lit(component + 2), F.size(column)))
        out = out.withColumn(column, rest)
    return out


def gray_scale(color: Column, how: str = "luminosity", weights: tuple[float, float, float] = (0.2125, 0.7154, 0.0721), channel: int = 0) -> Column:
    """One number from an array of red, green, blue."""
    r, g, b = color[0], color[1], color[2]
    nearest = lambda c: F.floor(c + 0.5).cast("smallint")
    if how == "luminosity":
        return nearest(r * weights[0] + g * weights[1] + b * weights[2])
    if how == "average":
        return nearest((r + g + b) / 3)
    if how == "lightness":
        return nearest((F.greatest(r, g, b) + F.least(r, g, b)) / 2)
    if how == "channel":
        return color[channel].cast("smallint")
    raise ValueError(f"unknown conversion {how!r}")


def differences_map(a: Column, b: Column) -> Column:
    """The larger minus the smaller, component by component for arrays."""
    return F.greatest(a, b) - F.least(a, b)


def color_map(df: DataFrame, column: str, points: list[tuple[float, int, int, int]], name: str = "color", mask: str | None = None, invalid: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Colors by linear interpolation between control points (position in 0..1, red, green, blue) of the normed value."""
    limits = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    first, last = points[0][0], points[-1][0]
    at = first + at * (last - first)
    made = F.array(*(F.lit(int(v)) for v in points[-1][1:]))
    for low, high in reversed(list(zip(points, points[1:]))):
        part = (at - low[0]) / (high[0] - low[0])
        mixed = F.array(*(F.floor(a * (1 - part) + b * part).cast("int") for a, b in zip(low[1:], high[1:])))
        made = F.when(at < high[0], mixed).otherwise(made)
    if mask:
        made = F.when(F.col(mask).cast("boolean"), made).otherwise(F.array(*map(F.lit, invalid)))
    return df.crossJoin(F.broadcast(limits)).withColumn(name, made).drop("_lo", "_hi")


def vector_color(vector: Column, mask: Column | None = None) -> Column:
    """Red, green, blue of a direction: trend by thirds of the circle, steep ones towards white."""
    norm = F.sqrt(vector[0] ** 2 + vector[1] ** 2 + vector[2] ** 2)
    sign = F.when(vector[2] < 0, -1.0).otherwise(1.0)
    x, y, z = (F.when(norm > 0, sign * vector[i] / norm).otherwise(0.0) for i in range(3))
    trend = F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))
    third = trend / 120.0
    r = F.when(third < 1, 1 - third).when(third < 2, 0.0).otherwise(third - 2)
    g = F.when(third < 1, third).when(third < 2, 2 - third).otherwise(0.0)
    b = F.when(third < 1, 0.0).when(third < 2, third - 1).otherwise(3 - third)
    steep = F.asin(F.least(z, F.lit(1.0))) / (math.pi / 2)
    made = F.array(*(F.floor(255 * (c + (1 - c) * steep)).cast("int") for c in (r, g, b)))
    return made if mask is None else F.when(mask.cast("boolean"), made).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def uniform(idx: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the row's index and the seed alone, so reruns agree."""
    return F.pmod(F.xxhash64(idx, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def initialize_data(df: DataFrame, name: str, how: str, components: int = 1, value: float = 0.0, start: float = 0.0, step: float = 1.0, low: float = 0.0, high: float = 1.0, seed: int = 5489, standardized: bool = True, kind: str = "double", idx: str = "idx") -> DataFrame:
    """A column by value, increments along idx, or random numbers in [low, high)."""
    made = []
    for c in range(components):
        if how == "value":
            made.append(F.lit(value))
        elif how == "incremental":
            made.append(start + step * F.col(idx))
        elif how == "random":
            made.append(low + (high - low) * uniform(F.col(idx), seed if standardized else seed + c))
        else:
            raise ValueError(f"unknown initialization {how!r}")
    made = [cast_to(m, kind) for m in made]
    return df.withColumn(name, made[0] if components == 1 else F.array(*made))


def initialize_box(df: DataFrame, columns: list[str], low: tuple[int, int, int], high: tuple[int, int, int], value: float | None = None, bounds: tuple[float, float] = (0.0, 1.0), seed: int = 5489) -> DataFrame:
    """Cells with x, y, z in the closed box get value, or a random number in bounds."""
    inside = F.lit(True)
    for axis, a, b in zip("xyz", low, high):
        inside = inside & F.col(axis).between(a, b)
    for k, c in enumerate(columns):
        new = F.lit(value) if value is not None else bounds[0] + (bounds[1] - bounds[0]) * uniform(F.col("idx"), seed + k)
        df = df.withColumn(c, F.when(inside, cast_to(new, df.schema[c].dataType.simpleString())).otherwise(F.col(c)))
    return df


def add_bad_data(df: DataFrame, columns: list[str], boundary_distance: str | None = None, boundary_part: float = 0.0, part: float = 0.0, seed: int = 5489) -> DataFrame:
    """Cells chosen at random, near boundaries with one probability and anywhere with another, lose their values."""
    lost = uniform(F.col("idx"), seed) < part
    if boundary_distance:
        lost = lost | ((F.col(boundary_distance) < 1) & (uniform(F.col("idx"), seed + 1) < boundary_part))
    return df.withColumns({c: F.when(lost, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns})


#: Functions of one value.
PIXEL = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan, "exp": F.exp,
    "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "square": lambda c: c * c, "not": lambda c: F.when(c == 0, 1).otherwise(0),
    "bounded_reciprocal": lambda c: 1 / (1 + c),
}


def exp_negative(c: Column, factor: float = 1.0) -> Column:
    return F.exp(-factor * c)


def invert_intensity(c: Column, maximum: float = 255) -> Column:
    return maximum - c


def intensity_window(c: Column, low: float, high: float, out_low: float, out_high: float) -> Column:
    return F.when(c < low, out_low).when(c > high, out_high).otherwise((c - low) * ((out_high - out_low) / (high - low)) + out_low)


def sigmoid(c: Column, alpha: float, beta: float, low: float, high: float) -> Column:
    return (high - low) / (1 + F.exp(-(c - beta) / alpha)) + low


def _with_totals(df: DataFrame, name: str, totals: list[Column], made) -> DataFrame:
    row = df.agg(*(t.alias(f"_a{i}") for i, t in enumerate(totals)))
    out = df.crossJoin(F.broadcast(row))
    return out.withColumn(name, made(*(F.col(f"_a{i}") for i in range(len(totals))))).drop(*(f"_a{i}" for i in range(len(totals))))


def rescale_intensity(df: DataFrame, column: str, out_low: float, out_high: float, name: str | None = None) -> DataFrame:
    """Linear map of the column's range to the output's."""
    scale = lambda lo, hi: F.when(hi == lo, out_low).otherwise((F.col(column) - lo) * (out_high - out_low) / (hi - lo) + out_low)
    return _with_totals(df, name or column, [F.min(column).cast("double"), F.max(column).cast("double")], scale)


def normalize(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Zero mean and unit (sample) variance."""
    return _with_totals(df, name or column, [F.avg(column), F.stddev_samp(column)], lambda m, s: (F.col(column) - m) / s)


def normalize_to_constant(df: DataFrame, column: str, constant: float = 1.0, name: str | None = None) -> DataFrame:
    return _with_totals(df, name or column, [F.sum(column).cast("double")], lambda s: F.col(column) * constant / s)
