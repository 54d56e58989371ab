"""From documents to token ids: quality rules, exact and near deduplication, mixing, encoding.

Each stage reads what the one before kept; all but the last return the columns of documents, whatever their names and
whatever columns come with them. Every stage takes whole texts of any length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoutline.llm import byte_bpe, exact_dedup, quality_rules, simhash_dedup, source_mixing
from scoutline.llm.common import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal up to white space, the smallest doc_id.

    Null counts as empty; rows without doc_id sort last; of rows that repeat doc_id and text the one written least stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the smallest doc_id.

    Wordless and null texts are one component; rows without doc_id link like others and stay only where no row of the component
    has one; of rows that repeat doc_id and text the one written least stays, as in every run.
    """
    return simhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them (0 to 3 times).

    A null source is a source of its own; null and empty texts have size 0; ties are drawn singly, and reruns agree.
    """
    return source_mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of each document; null and empty texts have no ids; repeated rows each get a row."""
    return byte_bpe.public(docs, with_ids=True)


STAGES = [("quality_rules", keep_good), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("source_mixing", mix), ("byte_bpe", encode)]

#: The fingerprints and the draw use XXH64 and the ids byte-level BPE, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
