"""Delimited text in and out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import TYPES
from gridloom.sources.binary import _lines, _text_file, write_lines

#: Delimiters by name.
DELIMITERS = {"comma": ",", "semicolon": ";", "space": " ", "colon": ":", "tab": "\t"}


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file: the file is read whole, as numbering its lines needs their order."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("t"))
    return whole.select(F.posexplode(F.split(F.regexp_replace("t", "\n$", ""), "\n")).alias("line", "value"))


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], delimiters: str = ",", start_line: int = 2, header_line: int | None = 1, consecutive: bool = False, skip: set[str] = frozenset()) -> DataFrame:
    """idx and typed columns of a text file, fields separated by any of a set of characters.

    columns: name to element type in the file's order; skip: names to leave out; consecutive: runs of delimiters count as
    one. An empty line, a wrong number of fields or a field that doesn't parse is an error.
    """
    lines = _numbered(spark, path).where(F.col("line") >= start_line - 1)
    split = "[" + re.escape(delimiters) + "]" + ("+" if consecutive else "")
    fields = F.split("value", split, -1)
    n = len(columns)
    ok = F.when(F.col("value") == "", F.raise_error(F.concat(F.lit("empty line "), F.col("line") + 1))).when(F.size(fields) != n, F.raise_error(F.concat(F.lit("wrong number of fields in line "), F.col("line") + 1))).otherwise(fields)
    parts = lines.select((F.col("line") - (start_line - 1)).cast("long").alias("idx"), ok.alias("_f"))
    made = [F.trim(F.col("_f")[i]).cast("string" if kind == "string" else TYPES[kind]).alias(name) for i, (name, kind) in enumerate(columns.items()) if name not in skip]
    bad = [F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a value of {name} doesn't parse"))).otherwise(F.col(name)).alias(name) for name in columns if name not in skip]
    return parts.select("idx", *made).select("idx", *bad)


def header_names(spark: SparkSession, path: str, line: int = 1, delimiters: str = ",") -> list[str]:
    row = _numbered(spark, path).where(F.col("line") == line - 1).first()
    return [x.strip().strip('"') for x in re.split("[" + re.escape(delimiters) + "]", row["value"])] if row else []


def read_text_array(spark: SparkSession, path: str, kind: str, components: int = 1, skip_lines: int = 0, delimiter: str = "comma") -> DataFrame:
    """(idx, value): all numbers of a file in order, components to a row."""
    lines = _numbered(spark, path).where(F.col("line") >= skip_lines)
    mark = re.escape(DELIMITERS[delimiter])
    fields = F.filter(F.split("value", f"{mark}+" if delimiter == "space" else mark), lambda x: F.trim(x) != "")
    whole = lines.groupBy().agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", fields.alias("f")))), lambda x: x["f"])).alias("f"))
    at = whole.select(F.posexplode("f").alias("n", "v"))
    value = F.trim("v").cast(TYPES[kind])
    if components == 1:
        return at.select(F.col("n").cast("long").alias("idx"), value.alias("value"))
    rows = at.groupBy(F.floor(F.col("n") / components).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("n", value.alias("v")))).alias("s"))
    return rows.select("idx", F.col("s.v").alias("value"))


def write_ascii(df: DataFrame, path: str, columns: list[str], delimiter: str = "comma", header: bool = True, index: bool = False, idx: str = "idx", one_file: bool = True) -> None:
    """A text file, or several, in the order of idx; arrays become several fields."""
    mark = DELIMITERS[delimiter]
    kinds = dict(df.dtypes)
    shown = [F.array_join(F.transform(c, lambda x: x.cast("string")), mark) if kinds[c].startswith("array") else F.col(c).cast("string") for c in columns]
    line = F.concat_ws(mark, *([F.col(idx).cast("string")] if index else []), *shown)
    title = mark.join(([idx] if index else []) + columns)
    lines = [df.select(F.col(idx).cast("long").alias("line"), line.alias("value"))]
    if header:
        lines.insert(0, _lines(df.sparkSession, title))
    write_lines(_text_file(lines), path, one_file)


def write_feature_csv(features: DataFrame, path: str, scalars: list[str], lists: list[str] = (), delimiter: str = "comma", count_line: bool = True, feature: str = "fid") -> None:
    """Features as a table, each list column as a section of its own: feature, size, values."""
    mark = DELIMITERS[delimiter]
    spark = features.sparkSession
    table = features.where(F.col(feature) > 0)
    line = F.col(feature).cast("long").alias("line")
    parts = []
    if count_line:
        parts.append(table.groupBy().agg(F.lit(0).cast("long").alias("line"), F.count("*").cast("string").alias("value")))
    parts.append(_lines(spark, mark.join([feature, *scalars])))
    parts.append(table.select(line, F.concat_ws(mark, *(F.col(c).cast("string") for c in (feature, *scalars))).alias("value")))
    for c in lists:
        parts.append(_lines(spark, mark.join([feature, f"num_{c}", c])))
        parts.append(table.select(line, F.concat_ws(mark, F.col(feature).cast("string"), F.size(c).cast("string"), F.array_join(F.transform(c, lambda x: x.cast("string")), mark)).alias("value")))
    write_lines(_text_file(parts), path)
