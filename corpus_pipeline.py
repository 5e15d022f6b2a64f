"""From raw documents to packed training sequences, in five stages.

1. toxicity: documents that the factorization machine scores 0.3 or more go.
2. exact: of texts equal up to white space the longest stays.
3. near: of documents linked by five-word shingles at a similarity of 0.8 or more, found by SimHash keys and confirmed
   on full sets, the smallest doc_id stays.
4. mixing: documents are repeated or left out so that sources reach their target weights.
5. packing: what is left becomes token sequences; one row per piece.

Every stage works on all rows that the one before it kept and its table is written to the shared folder. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.llm import exact, mixing, packing, simhash, toxicity
from kinetrove.llm.common import stage, table, word_count
from kinetrove.llm.tokens import public_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.unique_texts(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, lambda doc: word_count(doc["text"]), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_path(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a learnt model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
