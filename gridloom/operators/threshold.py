"""Predicates: threshold trees, masks, conditional values, removal of flagged rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import cast_to
from gridloom.session import cut

_COMPARE = {">": lambda c, v: c > v, "<": lambda c, v: c < v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}


@dataclass(frozen=True)
class Compare:
    """column op value; the value is first cast to the column's type, so 2.7 against whole numbers is 2."""

    column: str
    op: str
    value: float
    invert: bool = False


@dataclass(frozen=True)
class AnyOf:
    """Items joined by union (or) or intersection (and), left to right; may be nested and inverted."""

    items: tuple
    every: bool = False
    invert: bool = False


def predicate(tree: Compare | AnyOf, df: DataFrame) -> Column:
    if isinstance(tree, Compare):
        if tree.op not in _COMPARE:
            raise ValueError(f"unknown comparison {tree.op!r}")
        kind = df.schema[tree.column].dataType
        made = _COMPARE[tree.op](F.col(tree.column), cast_to(F.lit(tree.value), kind.simpleString()))
    else:
        if not tree.items:
            raise ValueError("a set of thresholds needs an item")
        made = predicate(tree.items[0], df)
        for item in tree.items[1:]:
            other = predicate(item, df)
            made = made & other if tree.every else made | other
    return ~made if tree.invert else made


def threshold_mask(df: DataFrame, tree: Compare | AnyOf, name: str = "mask", true=True, false=False, kind: str = "boolean") -> DataFrame:
    return df.withColumn(name, F.when(predicate(tree, df), F.lit(true)).otherwise(F.lit(false)).cast(kind))


def robust_automatic_threshold(df: DataFrame, value: str, gradient: str, name: str = "mask") -> DataFrame:
    """mask = value >= sum(value * gradient) / sum(gradient); one aggregate row joined back."""
    limit = df.agg((F.sum(F.col(value).cast("double") * F.col(gradient)) / F.sum(F.col(gradient).cast("double"))).alias("_t"))
    return df.crossJoin(F.broadcast(limit)).withColumn(name, F.coalesce(F.col(value) >= F.col("_t"), F.lit(False))).drop("_t")


def mask_image(value: str | Column, mask: str | Column, outside=0) -> Column:
    value, mask = (F.col(c) if isinstance(c, str) else c for c in (value, mask))
    return F.when(mask.cast("boolean"), value).otherwise(F.lit(outside))


def binary_threshold(value: str, low: float, high: float, inside=1, outside=0) -> Column:
    return F.when(F.col(value).between(low, high), F.lit(inside)).otherwise(F.lit(outside))


def threshold_image(value: str, low: float, high: float, outside=0.0) -> Column:
    return F.when(F.col(value).between(low, high), F.col(value)).otherwise(F.lit(outside))


def conditional_set(df: DataFrame, target: str, new, mask: str | None = None, replaces=None, invert: bool = False) -> DataFrame:
    """target where mask holds (or where it equals replaces) becomes new."""
    where = F.col(mask).cast("boolean") if mask else F.col(target) == F.lit(replaces)
    where = ~where if invert else where
    return df.withColumn(target, F.when(where, F.lit(new).cast(df.schema[target].dataType)).otherwise(F.col(target)))


def replace_element_attributes(df: DataFrame, target: str, minimum: float, maximum: float, new) -> DataFrame:
    """target outside [minimum, maximum] becomes new."""
    outside = (F.col(target) < minimum) | (F.col(target) > maximum)
    return df.withColumn(target, F.when(outside, F.lit(new).cast(df.schema[target].dataType)).otherwise(F.col(target)))


def ranks(ids: DataFrame, id_col: str) -> DataFrame:
    """(id_col, _rank): the place of each distinct id in ascending order, from 0.

    Ids are range partitioned and sorted; each partition's rows are counted first, so no task sees all ids.
    """
    ordered = cut(ids.select(id_col).distinct().repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_p", F.spark_partition_id()))
    counts = ordered.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))  # one row for each partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(id_col)) - 1
    return ordered.withColumn("_rank", place).join(F.broadcast(offsets), "_p").select(id_col, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))


def remove_flagged_vertices(vertices: DataFrame, mask: str, idx: str = "idx") -> DataFrame:
    """Rows whose mask is false, numbered again in order."""
    kept = vertices.where(~F.col(mask).cast("boolean")).drop(mask)
    return kept.join(ranks(kept, idx), idx).drop(idx).withColumnRenamed("_rank", idx).select(idx, *(c for c in kept.columns if c != idx))


def remove_flagged_elements(elements: DataFrame, vertices: DataFrame, mask: str, corners: list[str], idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Edges or triangles whose mask is false and the vertices they use, both numbered again in order."""
    kept = elements.where(~F.col(mask).cast("boolean")).drop(mask)
    used = kept.select(F.explode(F.array(*corners)).alias(idx)).distinct()
    number = ranks(used, idx)
    points = vertices.join(number, idx).drop(idx).withColumnRenamed("_rank", idx).select(idx, *(c for c in vertices.columns if c != idx))
    out = kept
    for c in corners:
        out = out.join(number.withColumnRenamed(idx, c), c).drop(c).withColumnRenamed("_rank", c)
    out = out.join(ranks(kept, idx), idx).drop(idx).withColumnRenamed("_rank", idx)
    return out.select(idx, *(c for c in kept.columns if c != idx)), points
