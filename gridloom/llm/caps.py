"""Embedding near-duplicates by spherical-cap filters.

Filter directions form a structured product code: after a fixed random rotation a vector's coordinates fall into two
blocks, each with its own random codebook, and a direction is one word of either. A vector is list-decoded to all
directions whose score exceeds a threshold (and at least to its FLOOR best): only words that can still reach it with
the other block's best one are combined, so the code's square is never written out. Vectors of one label that share a
direction are candidates, verified by cosine in double precision. The code grows with the number of vectors, so
a direction's list stays short; RATE directions a vector find a pair of cosine 0.98 nearly always (tests
measure the recall against brute force).

Equal vectors are merged first by partial aggregation, with their count, so a vector that a third of all rows
repeat is one row from there on. Tables that meet in joins on directions are plain ones, which the adaptive skew join splits.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with nothing, nor do
rows without label; vectors of different length are not compared; repeated rows are vectors of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.session import cut

RATE, FLOOR = 32, 8
#: Vectors of a label that a direction should hold by chance.
LIST = 4


class ProductCode:
    """Codebooks and threshold for vectors of dim coordinates; the same for equal arguments."""

    def __init__(self, dim: int, directions: int, rate: float = RATE):
        rng = np.random.default_rng([dim, directions])
        self.dim = dim
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        if dim < 8:
            self.parts = [slice(0, dim)]
            words = directions
        else:
            self.parts = [slice(0, dim // 2), slice(dim // 2, dim)]
            words = math.ceil(math.sqrt(directions))
        self.books = []
        for part in self.parts:
            book = rng.standard_normal((words, part.stop - part.start))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
        self.words = words
        probe = rng.standard_normal((200, dim))
        scores = self.scores(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        each = [self._best(x, int(4 * rate)) for x in zip(*scores)]
        self.least = float(np.sort(np.concatenate(each))[-min(int(rate * 200), sum(map(len, each)))])

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.turn
        return [turned[:, p] @ book.T for p, book in zip(self.parts, self.books)]

    def _best(self, scores: tuple[np.ndarray, ...], n: int) -> np.ndarray:
        """The n greatest sums, one word of each block; they lie within the n best words of either."""
        top = [np.sort(s)[::-1][:n] for s in scores]
        sums = top[0] if len(top) == 1 else np.add.outer(top[0], top[1]).ravel()
        return np.sort(sums)[::-1][:n]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row the directions above the threshold."""
        scores = self.scores(unit)
        out = []
        for row in zip(*scores):
            least = min(self.least, float(self._best(row, FLOOR)[-1]))
            if len(row) == 1:
                out.append(np.nonzero(row[0] >= least)[0])
                continue
            i = np.nonzero(row[0] >= least - row[1].max())[0]
            j = np.nonzero(row[1] >= least - row[0].max())[0]
            a, b = np.nonzero(np.add.outer(row[0][i], row[1][j]) >= least)
            out.append(i[a] * self.words + j[b])
        return out


def _listed(vectors: DataFrame, directions: int, rate: float) -> DataFrame:
    """(node, label, dim, direction) for (node, label, embedding)."""

    def run(batches):
        import pyarrow as pa

        codes: dict[int, ProductCode] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                nodes, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                by_dim: dict[int, list[tuple[int, list]]] = {}
                for k, v in enumerate(batch.column(2).to_pylist()):
                    by_dim.setdefault(len(v), []).append((k, v))
                rows: list[tuple] = []
                for dim, some in by_dim.items():
                    if dim not in codes:
                        codes[dim] = ProductCode(dim, directions, rate)
                    code = codes[dim]
                    x = np.array([v for _, v in some], dtype=np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    rows += [(nodes[k], labels[k], dim, int(d)) for (k, _), found in zip(some, code.decode(x)) for d in found]
                if rows:
                    n, lab, dims, ds = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.binary()), pa.array(lab, pa.string()), pa.array(dims, pa.int32()), pa.array(ds, pa.int64())], names=["node", "label", "dim", "direction"])

    return vectors.select("node", "label", "embedding").mapInArrow(run, "node binary, label string, dim int, direction long")


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cap_links(vectors: DataFrame, least: float = 0.98, rate: float = RATE) -> DataFrame:
    """(a, b), a < b: the linked pairs of (node, label, embedding array<double>), all nodes different and all vectors valid."""
    n = vectors.count()
    directions = max(256, n * int(rate) // LIST)
    lists = cut(_listed(vectors, directions, rate))
    other = lists.withColumnRenamed("node", "b")
    met = lists.withColumnRenamed("node", "a").join(other, ["label", "dim", "direction"]).where("a < b")
    pairs = met.select("a", "b").distinct()
    side = lambda k: vectors.select(F.col("node").alias(k), F.col("embedding").alias(f"v{k}"), F.sqrt(_dot("embedding", "embedding")).alias(f"n{k}"))
    cosine = _dot("va", "vb") / (F.col("na") * F.col("nb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(cosine >= least).select("a", "b")


def valid_vector(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; see the module's text."""
    v = F.col("embedding")
    base = rows.select(rows[id_col].alias("vec_id"), rows[label_col].cast("string").alias("label"), rows[vector_col].cast("array<double>").alias("embedding"))
    # scaled by a power of two, so that no square overflows or vanishes; cosines stay the same
    usable = F.coalesce(F.col("label").isNotNull() & valid_vector(v), F.lit(False))
    power = F.pow(F.lit(2.0), -F.floor(F.log2(F.array_max(F.transform(v, lambda x: F.abs(x))))).cast("double"))
    base = base.withColumn("embedding", F.when(usable, F.transform(v, lambda x: x * power)))
    name = F.concat_ws(":", F.length("label").cast("string"), "label", F.col("embedding").cast("string"))
    base = cut(base.withColumn("node", F.when(F.col("embedding").isNotNull(), F.substring(F.unhex(F.sha2(name, 256)), 1, 16))))
    classes = base.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = cut(classes)
    links = cut(cap_links(classes.select("node", "label", "embedding"), least))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    copies = classes.select(F.col("node").alias("other"), F.col("copies").alias("more"))
    linked = both.join(copies, "other").groupBy("node").agg(F.sum("more").alias("more"))
    comps = connected_components(links, "a", "b")
    least_id = comps.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = comps.join(least_id, "component").select("node", "component_id")
    facts = classes.join(linked, "node", "left").join(named, "node", "left")
    facts = cut(facts.select("node", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    out = base.select("vec_id", "node").join(facts, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), comp AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(comp.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(comp.b, v.vec_id)) AS kept
FROM v LEFT JOIN counted ON counted.a = v.vec_id LEFT JOIN comp ON comp.a = v.vec_id
"""
