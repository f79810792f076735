"""The registered queries of this subpackage, with production parameters, and
the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civisphere.llm import byte_bpe, language_id, line_dedup, merkle, mixing, sharding, simhash, token_counts, toxicity, transport_stream

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = transport_stream.demux_streams(transport_stream.mux_texts(_table(spark, sf_dir, "documents")))
    es = F.get("ts.streams", 0)
    payload, stamps = es["data"], es["stamps"]
    first, last = F.get(stamps, 0), F.element_at(stamps, -1)
    feature = F.concat_ws(
        ";",
        F.format_string("programs=%d pid=%d type=%d", "ts.programs", es["pid"], es["stream_type"]),
        F.format_string("packets=%d pes=%d", "ts.packets", F.size(stamps)),
        F.format_string("continuity_errors=%d table_errors=%d lost=%d", es["continuity_errors"], "ts.table_errors", "ts.lost_bytes"),
        F.format_string("pts=%d..%d random_access=%d", first["pts"], last["pts"], F.size(F.filter(stamps, lambda s: s["random_access"]))),
    )
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id",
        (~toxicity.learnable(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").alias("n_offending"),
        F.get("offending", 0)["start"].alias("worst_start"),
        F.get("offending", 0)["end"].alias("worst_end"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", (~language_id.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def bpe_digests(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Encode, decode and describe every whole text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    both = byte_bpe.decode_documents(ids, path, public_tokenizers.PATTERN)
    kept = ["ids"] if keep_ids else []
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *kept,
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_transport_stream, op2_toxicity, op3_sharding, op4_line_dedup, op5_language_id, op6_byte_bpe, op7_simhash, op8_merkle, op9_mixing, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {"op8_merkle": merkle.ORACLE, "op9_mixing": mixing.oracle()}
