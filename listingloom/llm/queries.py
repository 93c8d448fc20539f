"""The operators over the tables of a data folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, centroids, decontaminate, language_id, media, merkle, nearest, secrets, shards, shingle_join, token_files, toxicity, warc
from .common import held_out, table
from .oracles import ORACLES


WORD_BPE = "word_bpe_49k.json"
#: Appended to each document in the token-id files.
END_ID = 2
SHARDS = 8
NEIGHBOURS = 10


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    response = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(response, F.col("payload_length")).otherwise(F.col("full_length")).alias("payload_bytes"),
        F.when(response, F.col("payload_sha1")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", F.col("refers_to_page").alias("refers_to"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, usable = table(spark, sf_dir, "documents"), F.col("doc_id").isNotNull() & ~held_out("doc_id")
    model = toxicity.train(toxicity.examples(docs, table(spark, sf_dir, "labels"), usable))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.components(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(spark, language=secrets.language_of(docs)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return rows.select(
        "doc_id", "start", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.crc32("ids_le").alias("ids_crc32")
    )


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_pairs.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, NEIGHBOURS)


def op11_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.document_leaves(table(spark, sf_dir, "documents")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
