"""All pairs of rows, block by block.

Rows are dealt to blocks by a hash; a task holds two blocks and numpy meets them in chunks. Each unordered pair of blocks is
formed once, whatever the number of rows; a row is shuffled once for each block, and blocks have about ROWS rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, least number of blocks (so that few rows also keep several tasks busy), and pairs of a chunk.
ROWS, LEAST_BLOCKS, CHUNK = 20_000, 6, 1 << 20


def map_pairs(rows: DataFrame, by: str, meet: Callable, schema: str, group: str | None = None) -> DataFrame:
    """meet(a, b, same) on each pair of blocks, a and b Arrow tables of rows; same: b is a. It returns an Arrow table of schema.

    by: the column whose hash deals rows; group: only rows of one value of that column meet.
    """
    blocks = max(LEAST_BLOCKS, -(-rows.count() // ROWS))
    dealt = rows.withColumn("_k", F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"_a": F.least("_k", "_o"), "_b": F.greatest("_k", "_o")}).drop("_o")
    columns = rows.columns

    def run(key, whole):
        import pyarrow.compute as pc

        a, b = key[-2].as_py(), key[-1].as_py()
        first = whole.filter(pc.equal(whole["_k"], a)).select(columns).combine_chunks()
        if a == b:
            return meet(first, first, True)
        return meet(first, whole.filter(pc.equal(whole["_k"], b)).select(columns).combine_chunks(), False)

    return dealt.groupBy(*([group] if group else []), "_a", "_b").applyInArrow(run, schema)


def matrix(table, name: str) -> np.ndarray:
    """An Arrow column of arrays of one length as rows of a matrix."""
    lists = table[name].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(lists):
        return np.zeros((0, 0))
    if len(flat) % len(lists) or len(set(np.unique(lists.value_lengths().to_numpy(zero_copy_only=False)))) > 1:
        raise ValueError(f"arrays of {name} differ in length")
    return flat.reshape(len(lists), -1).astype(np.float64, copy=False)


def chunks(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows so that each meets m others in about CHUNK pairs."""
    step = max(1, CHUNK // max(1, m))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))
