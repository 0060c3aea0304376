"""Row-wise pipelines over streams: the same steps on each micro-batch, and running statistics by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.pipeline import Pipeline, PipelineError

#: Steps that read one row at a time and so mean the same on a stream.
ROW_WISE = frozenset(("threshold", "calculate", "filter", "convert", "select", "rename", "delete", "conditional_set"))


def on_stream(pipeline: Pipeline, stream: DataFrame) -> DataFrame:
    wrong = [s["filter"] for s in pipeline.steps if s["filter"] not in ROW_WISE and not s.get("disabled")]
    if wrong:
        raise PipelineError(f"not row-wise: {wrong}")
    return pipeline.run(stream)


def windowed_statistics(stream: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, least, greatest, mean and population deviation by window and group, with a watermark for late rows."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), by).agg(F.count("*").alias("length"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
