"""Registered queries of the corpus operators over the given tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import (collocations, coverdedup, digest, kdshards, langid, mixing, permindex, pieces, quality, rmqsearch, secrets,
                           simhash, suffixdedup)
from cohortkit.llm.common import table
from cohortkit.llm.oracle_sql import ORACLE  # noqa: F401  (registered beside the queries)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprint_table(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.hex_fp(F.col("fp")).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest(table(spark, sf_dir, "embeddings"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.shard(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.systematic_copies(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return d.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rmqsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverdedup.digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


SPARK = {f.__name__: f for f in (
    op1_sentencepiece, op2_fingerprints, op3_language_id, op4_simhash, op5_suffix_dedup, op6_permutation_index,
    op7_kd_shards, op8_secrets, op9_quality, op10_mixing, op11_lexical_search, op12_cover_dedup, op13_collocations)}
