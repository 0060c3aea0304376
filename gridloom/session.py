"""Session helpers: building a session, the shared folder, and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to this many rows and bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32_000_000
#: The same for tables of a graph's rounds, of which many stand in the driver at once.
GRAPH_ROWS, GRAPH_BYTES = 40_000, 4_000_000


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of our own is set only where the session names none and runs on one machine, as in tests; on a cluster
    executors wouldn't see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder until no plan refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows written as Parquet into the shared folder and read again."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "gridloom", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if a count shows that its rows and bytes are few; for tables without costly lineage."""
    bytes_ = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(bytes_), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and found["b"] <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
