"""The corpus pipeline: documents to encoded training texts, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Every stage takes any table with doc_id, text, lang and source: empty ones, null or
repeated ids, null, empty and very long texts, repeated rows (each is judged, and
kept or not, like its copies; near_dups keeps one of rows equal in id and text) and
further columns of any name but _row, n_tokens, posterior, rate, copies, reached
and converged. A stage that keeps nothing hands on an empty table. Without labels
all rates of mixing are those of uniform posteriors.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixing, near_dups, piece_codec, quality_rules
from tidemark.llm.common import crc32_mod, discard, load, materialise, ship

PIECES = "piece_bpe_32k.model"


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Rows of docs that judge() keeps, with their key _row in place of its doc_id.

    The key is the id (null ids last) and a digest of the columns that judge()
    reads: rows of one key are judged alike, others each by itself, whatever their ids.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5(F.to_json(F.struct(*columns))).alias("digest"))
    keyed = docs.withColumn("_row", row)
    kept = judge(keyed.withColumn("doc_id", F.col("_row")).drop("_row")).filter("kept").select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(kept, "_row", "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter or with an unsure one go."""
    ship(spark)
    model = language_id.fit(docs.filter(crc32_mod("doc_id", 5) != 0))
    return language_id.predict(docs, model).filter("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    ship(spark)
    return _kept(docs, quality_rules.judge, ["text", "lang", "source"]).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one of rows equal in id and text."""
    ship(spark)
    return _kept(docs, near_dups.near_duplicates, ["text"]).dropDuplicates(["_row"]).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates ask for."""
    ship(spark)
    model = mixing.fit(docs, mixing.label_domains(load(spark, sf_dir, "labels")))
    mixed = mixing.mix(docs, model, mixing.TARGETS)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text back."""
    ship(spark)
    path = public_tokenizers.path(PIECES)
    return piece_codec.round_trip(docs.select("doc_id", "lang", "source", "text"), path).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dups", remove_near_duplicates),
    ("mixing", mix_to_targets),
    ("piece_codec", encode_pieces),
]

#: Trained models and hash forests stand between the tables: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table goes when the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, name)
            if before is not None:
                discard(spark, before)
            before = docs
    return docs
