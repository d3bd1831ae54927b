"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.llm import (
    extraction,
    lattice,
    learning,
    merkle,
    mixing,
    neardup,
    packing,
    pii,
    quality,
    repeats,
    rules,
    sharding,
    sql,
    toxicity,
    whitening,
)
from tidewire.session import cut

QUERIES = {}
ORACLES: dict[str, str] = {
    "op4_rules": sql.RULES,
    "op8_lattice": sql.LATTICE,
    "op9_minhash": sql.NEARDUP,
    "op11_repeats": sql.REPEATS,
    "op13_merkle": sql.MERKLE,
}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return sharding.shard(cut(docs, "op1-sizes"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size")
    )
    return mixing.taken(mixing.mix(cut(docs, "op2-sizes"), "size", "source"), ["doc_id"])


@register
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, C.table(spark, sf, "labels"))
    return scored.select(
        "row.doc_id",
        learning.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


@register
def op4_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "source", "text")
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(docs, "source").select("row.doc_id", *shown)


@register
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs, C.table(spark, sf, "labels"), F.col("source"), F.col("lang"))
    return judged.select("row.doc_id", "p", "host_rate", "site_rate", "score", "kept")


@register
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs, "text", packing.vocabulary(), carry=["doc_id"]).select(
        "row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@register
def op7_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(C.table(spark, sf, "pages"))


@register
def op8_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.near_vectors(C.table(spark, sf, "embeddings"))


@register
def op9_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.duplicates(C.table(spark, sf, "documents"))


@register
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, "text", pii.DEMO_KEY, count="n_replaced")


@register
def op11_repeats(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, "embedding").select(
        "row.vec_id",
        "component",
        "n",
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


@register
def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.table(spark, sf, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    leaves = docs.select(
        "doc_id",
        "source",
        merkle.leaf(*head, F.col("text")).alias("leaf"),
        F.when(tampered.isNotNull(), merkle.leaf(*head, tampered)).alias("tampered"),
    )
    proven = merkle.manifest(leaves, "source", "doc_id", "leaf")
    return proven.select(
        "row.doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.joined(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
        merkle.fold(F.coalesce("row.tampered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@register
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
