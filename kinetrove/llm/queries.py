"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrove.llm import exact, minhash, mixing, neighbours, packing, prefix_trie, quality, secrets, simhash, token_files, toxicity, warc, whitening
from kinetrove.llm.common import table, word_count
from kinetrove.llm.tokens import public_path


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_path(), end_id=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0).drop("digest_ok")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path(), end_id=1)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only what the report needs goes through the shuffle; the pipeline mixes whole documents.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("words"))
    mixed = mixing.mix(docs, lambda doc: doc["words"], weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select(mixed["doc.doc_id"].alias("doc_id"), "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base=100, heads=6)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=85)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality": op2_quality,
    "op3_neighbours": op3_neighbours,
    "op4_exact_groups": op4_exact_groups,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_minhash": op13_minhash,
}
