"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts
from .clustering import cluster_vectors
from .common import read_table
from .conversation_repair import conversation_digests, damaged, repair_conversations
from .decontamination import leaks
from .embedding_dedup import link_vectors
from .language_id import predict_language
from .language_model import score_texts
from .packing import pack
from .quality import grade_of, judge_quality
from .simhash import simhash_groups
from .substring_dedup import remove_repeats
from .token_files import token_file_index
from .url_filter import judge_urls

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(read_table(spark, sf_dir, "documents"), folds=4, held_out=2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return judge_quality(read_table(spark, sf_dir, "documents"), labels.where("grade is not null"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), length=400)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), folds=7, held_out=2)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), path), path)
    return texts.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(repair_conversations(damaged(read_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_model": op8_language_model,
    "op9_token_files": op9_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_bpe": op11_bpe,
    "op12_clustering": op12_clustering,
    "op13_conversation_repair": op13_conversation_repair,
}
