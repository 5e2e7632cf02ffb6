"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.

Defined results. Null and empty texts have no language and go in the first
stage; taken alone, the later stages keep them, and packing gives them the end
id. Long texts are worked on whole. Of equal texts the smallest doc_id stays
(rows that share it stay together); a null doc_id is never a copy of another
row, loses no passage and removes none. Ties in a score fall by the rules of
each operator. Columns beyond those of documents are dropped at once, so names
cannot clash. An empty table passes every stage as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import language_id, near_dedup, packing, substring_dedup, toxicity
from matchspark.llm._tables import keep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is named where its probability is at least this.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und``, and with a probability of at least SURE."""
    docs = docs.select(*COLUMNS)
    found = language_id.predict(docs, language_id.train(docs), COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; learned from the labels of those that are here."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates on five-word shingles at 0.8. A null doc_id stays."""
    docs = docs.select(*COLUMNS)
    copies = keep(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    return docs.hint("merge").join(copies, "doc_id", "left_anti").select(*COLUMNS)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that stand earlier; texts without any stay as they are, and documents of nothing else go."""
    found = substring_dedup.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", clean), ("near_dedup", unique), ("substring_dedup", unrepeated), ("packing", packed)]
#: Language, toxicity and tokenisation are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
