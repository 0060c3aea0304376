"""Bounded samples of labelled documents for fitting classifiers.

A sample takes labelled rows in the order of a hash of doc_id, up to a number of rows for each label and, from the front,
as many as a number of bytes holds; both bounds are parameters of the operators. The order knows no length, so long texts are
taken as often as short ones; only a text of more than an eighth of all bytes is left out of a sample. Labels of one
doc_id that differ count as the largest; so do texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_checksum(id_col: str | Column) -> Column:
    """CRC32 of the id as text, unsigned; that of nothing for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows_of: dict[int, int], most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of the sample, and how many labelled rows there are of each label.

    allowed: which rows of labels may be learned from, in terms of doc_id.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col(label).isin(list(rows_of)) & allowed).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(29)), F.col("doc_id")]
    parts = [known.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in rows_of.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # at most sum(rows_of.values()) rows reach the driver, of three numbers each
    sized = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("n").alias("n"))
    taken, left = [], most_bytes
    for r in sized.where(F.col("n") <= most_bytes // 8).orderBy(*order).collect():
        if r["n"] > left:
            break
        taken.append((r["doc_id"], r["label"]))
        left -= r["n"]
    # as an Arrow table: a list would go through Python workers, whose own daemon stays in every executor's memory
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([i for i, _ in taken], pa.int64()), "label": pa.array([k for _, k in taken], pa.int32())}))
    found = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return found.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")), counts
