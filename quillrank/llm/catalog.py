"""Registered queries of the operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from quillrank.llm import ann, divergence, langid, maxent, merkle, mixing, neardup, packing, pii, quality, sharding, simhash, suffixes
from quillrank.llm.common import id_crc32


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op2_pigeonhole_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "embeddings").select("vec_id", "label", "embedding"))


def op3_pivotal_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.sized(_table(spark, folder, "documents")).select("doc_id", "source", "size")
    mixed = mixing.mix(sizes, mixing.targets(sizes))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_deletion_variant_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_class_maxent(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", (id_crc32() % 10 == 0).alias("held_out"), "text")
    return maxent.fit_and_score(docs)


def op7_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def op8_dominance_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_bitmask_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held = langid.held_out(id_crc32())
    model = langid.fit(docs.filter(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op10_sparse_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_spans(_table(spark, folder, "documents"))


def op11_chunk_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents").select("lang", "source", "text"))


def op12_window_merkle(spark: SparkSession, folder: str) -> DataFrame:
    proofs = merkle.manifest(_table(spark, folder, "documents"), merkle.tampers(id_crc32()))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held = quality.held_out(id_crc32())
    model = quality.fit(docs.filter(~held), _table(spark, folder, "labels"))
    return quality.score(docs.withColumn("held_out", held), model)


def registry() -> dict:
    """name → (query, SQL or None)."""
    return {
        "op1_weak_supervision_pii": (op1_weak_supervision_pii, None),
        "op2_pigeonhole_neardup": (op2_pigeonhole_neardup, None),
        "op3_pivotal_mixing": (op3_pivotal_mixing, None),
        "op4_learned_partitions": (op4_learned_partitions, None),
        "op5_deletion_variant_simhash": (op5_deletion_variant_simhash, None),
        "op6_class_maxent": (op6_class_maxent, None),
        "op7_hilbert_sharding": (op7_hilbert_sharding, sharding.SQL),
        "op8_dominance_packing": (op8_dominance_packing, None),
        "op9_bitmask_langid": (op9_bitmask_langid, None),
        "op10_sparse_suffixes": (op10_sparse_suffixes, None),
        "op11_chunk_divergence": (op11_chunk_divergence, divergence.SQL),
        "op12_window_merkle": (op12_window_merkle, merkle.SQL),
        "op13_compression_quality": (op13_compression_quality, None),
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
