"""A store of tables: a folder of Parquet tables and a manifest with geometry and a pipeline.

It takes the place of a hierarchical scientific file: whole structures or some of their paths are read, written, and asked
for the pipeline that made them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], path: str, meta: dict | None = None, pipeline: list | None = None) -> None:
    """Each table under its path, then the manifest, so that a reader never sees a manifest without its tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"tables": sorted(tables), "meta": meta or {}, "pipeline": pipeline or []}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(f"{path}/manifest").agg(F.first("value")).first()
    return json.loads(row[0])


def load(spark: SparkSession, path: str, only: list[str] | None = None) -> dict[str, DataFrame]:
    names = manifest(spark, path)["tables"]
    missing = set(only or ()) - set(names)
    if missing:
        raise KeyError(f"no tables {sorted(missing)} in {path}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if only is None or n in only}


def extract_pipeline(spark: SparkSession, path: str) -> list:
    return manifest(spark, path)["pipeline"]
