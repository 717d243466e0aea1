"""A corpus pipeline over documents: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame, which run()
writes and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import materialize, table
from tabloom.llm.jaccard import keep_one
from tabloom.llm.mixing import mix
from tabloom.llm.packing import pack
from tabloom.llm.pii import mask_pii
from tabloom.llm.quality import filter_documents
from tabloom.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or certified cutoffs reject go; null and empty texts are among them."""
    return filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8: the smallest doc_id of each group stays; texts without words stay."""
    return keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become tags; every row stays, null texts stay null."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates ask, 0 or more times; rows without an id take part."""
    return mix(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 1024 ids; a null or empty text still has its end id."""
    out = pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), 0)
    return out.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids_crc32", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]
#: Iterative joins, trained models and a tokenizer are not SQL; the tests run every stage and compare the join and the packed ids with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
