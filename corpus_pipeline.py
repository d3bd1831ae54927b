"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept, as the columns of ``documents``, and is written
before the next one reads it.  The decisions take effect: rejected and repeated documents are
gone, personal data is replaced, and the mix holds sources at their target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import common as C
from tidewire.llm import mixing, neardup, packing, pii, quality
from tidewire.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    judged = quality.judge(docs, C.table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return neardup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms."""
    return measured(pii.pseudonymize(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, taken once or more, or cut at the end."""
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    return measured(mixing.realised(mixing.mix(sized, "size", "source"), docs.columns, "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, as pieces of documents."""
    # Beside what earlier stages have left in the workers, little is held here.
    pieces = packing.pack(docs, "text", packing.vocabulary(), carry=["doc_id"], cache=32 << 20)
    return pieces.select(
        "row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("quality", good), ("neardup", unlike), ("pii", private), ("mixing", mixed), ("packing", packed)]

# Trained weights, hashes and drawn permutations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
