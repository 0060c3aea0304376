"""Pipelines: a JSON list of steps over one table, checked against schemas before any data moves.

A step is {"filter": name, "args": {...}}; "disabled": true skips it. preflight() builds the whole plan on an empty table
of the same schema and returns each step's schema, or raises PipelineError with the step's number.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions.calculator import CalculatorError, calculate
from gridloom.operators import aggregates, threshold

Step = Callable[..., DataFrame]
REGISTRY: dict[str, Step] = {}


class PipelineError(ValueError):
    """A step that doesn't exist, has wrong arguments, or doesn't fit its input."""


def register(name: str) -> Callable[[Step], Step]:
    def add(f: Step) -> Step:
        REGISTRY[name] = f
        return f

    return add


def tree(spec: dict):
    """A threshold tree from JSON: {"column", "op", "value"} or {"all": [...]} or {"any": [...]}, each with "invert"."""
    if "column" in spec:
        return threshold.Compare(spec["column"], spec["op"], spec["value"], spec.get("invert", False))
    every = "all" in spec
    return threshold.AnyOf(tuple(map(tree, spec["all" if every else "any"])), every, spec.get("invert", False))


@register("threshold")
def _threshold(df: DataFrame, where: dict, name: str = "mask") -> DataFrame:
    return threshold.threshold_mask(df, tree(where), name)


@register("calculate")
def _calculate(df: DataFrame, expression: str, name: str, degrees: bool = False, kind: str = "float64") -> DataFrame:
    return df.withColumn(name, calculate(expression, df.columns, degrees, scalar.TYPES[kind]))


@register("statistics")
def _statistics(df: DataFrame, column: str, by: str | None = None, mask: str | None = None) -> DataFrame:
    return aggregates.array_statistics(df, column, by, mask)


@register("standardize")
def _standardize(df: DataFrame, column: str, by: str | None = None, name: str | None = None) -> DataFrame:
    return aggregates.standardize(df, column, by, name)


@register("filter")
def _filter(df: DataFrame, mask: str) -> DataFrame:
    return df.where(F.col(mask).cast("boolean"))


@register("convert")
def _convert(df: DataFrame, column: str, to: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, scalar.convert(F.col(column), to))


@register("select")
def _select(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


@register("rename")
def _rename(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumnRenamed(column, name)


@register("delete")
def _delete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


@register("conditional_set")
def _conditional_set(df: DataFrame, target: str, new, mask: str) -> DataFrame:
    return threshold.conditional_set(df, target, new, mask)


@register("rescale")
def _rescale(df: DataFrame, column: str, low: float, high: float, name: str | None = None) -> DataFrame:
    return scalar.rescale_intensity(df, column, low, high, name)


@register("initialize")
def _initialize(df: DataFrame, name: str, how: str, **more) -> DataFrame:
    return scalar.initialize_data(df, name, how, **more)


@register("histogram")
def _histogram(df: DataFrame, columns: list[str], bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    return aggregates.array_histogram(df, columns, bins, low, high)


class Pipeline:
    def __init__(self, steps: list[dict], name: str = "pipeline"):
        self.name, self.steps = name, steps

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        spec = json.loads(text)
        return cls(spec["pipeline"], spec.get("name", "pipeline"))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "pipeline": self.steps}, indent=2)

    def run(self, df: DataFrame) -> DataFrame:
        for n, step in enumerate(self.steps):
            if not step.get("disabled"):
                df = self._step(n, step, df)
        return df

    def preflight(self, df: DataFrame) -> list[str]:
        """Schemas after each step, from an empty table."""
        empty, out = df.sparkSession.createDataFrame([], df.schema), []
        for n, step in enumerate(self.steps):
            if not step.get("disabled"):
                empty = self._step(n, step, empty)
            out.append(empty.schema.simpleString())
        return out

    def _step(self, n: int, step: dict, df: DataFrame) -> DataFrame:
        f = REGISTRY.get(step.get("filter"))
        if f is None:
            raise PipelineError(f"step {n}: no filter {step.get('filter')!r}")
        try:
            inspect.signature(f).bind(df, **step.get("args", {}))
            out = f(df, **step.get("args", {}))
            out.schema  # noqa: B018  analysis happens here
            return out
        except (TypeError, KeyError, ValueError, CalculatorError, PySparkException) as e:
            raise PipelineError(f"step {n} ({step['filter']}): {e}") from e
