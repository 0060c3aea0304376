"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import caps, chat, media, minhash, mixing, packing, pii, quality, sharding, toxicity
from gridloom.llm.samples import id_checksum
from gridloom.session import table


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_text"))
    out = sharding.balanced_label_propagation(rows, "doc_id", ["_text"], 8, order=["text_crc32", "_text"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payload = media.payload_of(F.col("text"))
    catalog = media.read_media(media.store_media(docs.select(payload.alias("payload"), F.sha2(payload, 256).alias("digest"))))
    name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    page = F.concat(F.lit("<article><p>"), name, F.lit('</p><figure><img src="sha256:'), F.sha2(payload, 256), F.lit('"><figcaption>'), name, F.lit("</figcaption></figure></article>"))
    pages = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.parse_html(page).alias("sequence"))
    refs = media.references(pages, "sequence", ["doc_id", "n_bytes"])
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
    return media.resolve(refs, catalog).select(*columns)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "n_kmers")


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed_chats(table(spark, sf_dir, "conversations"))


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cost_balanced_packing(table(spark, sf_dir, "documents"))


def op6_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(id_checksum("doc_id"), F.lit(3)) == 1
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.embedding_components(table(spark, sf_dir, "embeddings"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(id_checksum("doc_id"), F.lit(5)) == 0
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def queries() -> dict:
    found = (op1_label_propagation, op2_interleaved_media, op3_order_minhash, op4_snapshot_collapse, op5_cost_balanced_packing, op6_systematic_mixing, op7_compression_toxicity, op8_spherical_caps, op9_bootstrapped_pii, op10_random_indexing_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_snapshot_collapse": chat.ORACLE, "op6_systematic_mixing": mixing.ORACLE.format(docs="documents"), "op8_spherical_caps": caps.ORACLE}
