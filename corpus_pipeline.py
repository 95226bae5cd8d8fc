"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontamination, jaccard_join, langid, sentencepiece_codec, substring_dedup
from touchline.llm.common import documents, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages that documents are labelled with and gives each document one by its text.

    A null language is filled with the network's. Documents go whose text is
    null or has no letter, and those that the network cannot tell from chance.
    """
    return langid.with_language(docs.select(*COLUMNS), langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of five-word Jaccard similarity 0.8 or more, that with the least id stays.

    A null id is in no group, and rows that share an id stay or go together.
    """
    later = jaccard_join.link(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 20-word window that starts earlier are taken out; documents left without words go.

    Texts without such words stay as they are, the others are their kept words
    joined by one space.
    """
    made = substring_dedup.remove_repeats(docs, carry=COLUMNS[1:4])
    made = made.filter("n_words > n_removed or n_removed = 0")
    made = made.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return made.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit budget go."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    made = sentencepiece_codec.encode(docs, model, carry=("lang", "source", "n_chars"), decoded=True)
    return made.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: a trained network and a tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir, with Parquet between them in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
