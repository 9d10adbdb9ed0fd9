"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat_format, divergence, language_id, lexical_search, mixing, near_dups, piece_codec, quality_classifier, quality_rules, token_counts, token_files, url_filters
from .common import crc32_mod, load, materialise

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(PIECES)).drop("text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.fit(docs, mixing.label_domains(load(spark, sf_dir, "labels")))
    return mixing.rates(docs, model, mixing.TARGETS)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod("doc_id", 3) == 1
    model = quality_classifier.fit(docs, load(spark, sf_dir, "labels").filter(~held_out))
    return quality_classifier.classify(docs.withColumn("held_out", held_out), model).drop("text")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.RULES, url_filters.GLOBS).drop("url")


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(load(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    stored = audio.store(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return audio.digest(audio.expand(materialise(spark, stored, "media"))).drop("media", "pcm")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_digest(token_files.write(docs, public_tokenizers.path(WORDS), end_id=1))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.codec_digest(docs, public_tokenizers.path(PIECES)).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod("doc_id", 5) == 0
    model = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents")).drop("d2")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(load(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(json.dumps(chat_format.ADDED),)], "record string")
    turns = chat_format.canonical_turns(chat_format.as_records(table).unionByName(added))
    return chat_format.digest(materialise(spark, chat_format.format_turns(turns), "chat"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_near_dups": op5_near_dups,
    "op6_media_columns": op6_media_columns,
    "op7_token_files": op7_token_files,
    "op8_piece_codec": op8_piece_codec,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_chat_format": op12_chat_format,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {"op4_url_filters": url_filters.ORACLE, "op10_quality_rules": quality_rules.oracle(), "op11_source_divergence": divergence.ORACLE, "op12_chat_format": chat_format.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
