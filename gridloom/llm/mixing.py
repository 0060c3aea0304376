"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code point order, null last, weigh 1, 2, 3, repeating. Targets share the total of all sizes by weight;
a target stops at three times its source's size and what exceeds it is shared again by weight until no target
is above. That fixed point is a water level: with sources sorted by cap over weight, the first level that the next
cap doesn't cut is the answer, so window sums give it without a loop.

Within a source every document expects rate = target / source size copies. Documents are laid out by size, the
expected copies are summed from the front, the source's one random offset is added, and a document is emitted once for each
integer boundary that its share crosses. As neighbours have nearly equal sizes, the words taken differ from the target by
about the largest document's size at most, which is a small share unless a source holds few documents.

Ranks within a source are counted in chunks, by (size class, hash), so that a source with a third of all rows is
spread over many tasks; the number of hash buckets follows the row count.

Defined cases: a null text has size 0; a null source is a source; a source of size 0 has target and rate 0;
repeated rows are sampled one by one; an empty table gives no rows; ties of size go by hash, then by doc_id; a very long
text is one size among others; repeated carries other columns, whatever their names, in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut, small

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
_BUCKET_ROWS = 4096
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
_PAST = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size) with weight and target. One row for each source, a table that sums have made small."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    rank = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    past, whole = rank.rowsBetween(*_PAST), Window.partitionBy().rowsBetween(*_ALL)
    total, weights = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(past), F.lit(0.0)))
    s = s.withColumn("_level", level).withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("weight"))
    s = s.withColumn("_level", F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(rank.rowsBetween(*_ALL)))
    return s.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"))


def systematic_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies, taken, and the columns of keep.

    keep is carried through the sampling; its names must differ from the others'.
    """
    keep = keep or []
    base = cut(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *keep))
    buckets = min(1 << 16, max(1, base.count() // _BUCKET_ROWS))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bits = F.length(F.bin("size"))
    scale = F.when(bits > 4, F.concat(bits.cast("string"), F.substring(F.bin("size"), 1, 4))).otherwise(F.col("size").cast("string")).cast("long")
    laid = base.withColumn("_class", scale).withColumn("_bucket", F.pmod(_hex_number(digest, 8), F.lit(buckets)))
    chunk = ["source", "_class", "_bucket"]
    counts = laid.groupBy(*chunk).agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    counts = cut(counts)
    mix = targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size"))).select(F.col("source").alias("_source"), "source_size", "target")
    name = F.concat_ws(":", F.lit(str(seed)), F.col("_source").isNull().cast("string"), F.coalesce("_source", F.lit("")))
    mix = mix.withColumn("_rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(0.0))
    mix = mix.withColumn("_turn", _hex_number(F.md5(name.cast("binary")), 13) / float(1 << 52))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(*_PAST))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).join(mix, F.col("source").eqNullSafe(F.col("_source")))
    offsets = offsets.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), "_before", "source_size", "target", "_rate", "_turn")
    rank = F.row_number().over(Window.partitionBy(*chunk).orderBy("size", "doc_id"))
    ranked = laid.withColumn("_rank", rank)
    ranked = ranked.join(offsets, (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    ranked = cut(ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).select("doc_id", "source", "size", *keep, "source_size", "target", "_rate", "_turn", "_rank"))

    at = lambda r: F.floor(r * F.col("_rate") + F.col("_turn"))
    out = ranked.withColumn("copies", at(F.col("_rank")) - at(F.col("_rank") - 1))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source", *keep)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """docs with each row as often as the mix takes it; texts are not shuffled unless the counts are too many to broadcast."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    own = docs.select(F.struct(*columns).alias("row"), docs[id_col].alias("id"), F.xxhash64(*columns).alias("mark"))
    keyed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"), F.xxhash64(*columns).alias("mark"))
    counts = systematic_mix(keyed, "doc_id", "text", "source", seed, ["mark"])
    # rows that are equal in full share a mark and their copies; the least of them carries the sum
    counts = counts.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sum("copies").cast("long").alias("copies"), F.count("*").alias("same"))
    counts = cut(counts)
    joined = own.join(small(counts), own["id"].eqNullSafe(counts["_id"]) & (own["mark"] == counts["_mark"]))
    single = joined.where("same = 1")
    again = joined.where("same > 1").dropDuplicates(["id", "mark"])
    out = single if counts.where("same > 1").isEmpty() else single.unionByName(again)
    out = out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}
), laid AS (
  SELECT *, CASE WHEN length(bin(size)) > 4 THEN (length(bin(size))::VARCHAR || substr(bin(size), 1, 4))::BIGINT ELSE size END AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % least(65536, greatest(1, (SELECT count(*) FROM base) // 4096)) AS bucket FROM base
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sources
), leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed
), level AS (
  SELECT first(level ORDER BY cap / weight, source IS NULL, source) FILTER (level <= cap / weight) AS level FROM leveled
), mix AS (
  SELECT source, source_size, least(cap, coalesce(level.level * weight, cap)) AS target,
    ('0x' || substr(md5('11:' || (source IS NULL)::VARCHAR || ':' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS turn FROM weighed, level
), ranked AS (
  SELECT l.doc_id, l.size, l.source, m.source_size, m.target, m.turn, CASE WHEN m.source_size > 0 THEN least(3.0::DOUBLE, m.target / m.source_size) ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY l.source ORDER BY class, bucket, size, doc_id NULLS FIRST) AS r
  FROM laid l JOIN mix m ON l.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, size, source_size, target, ((floor(r * rate + turn) - floor((r - 1) * rate + turn)) * size)::BIGINT AS taken FROM ranked
"""
