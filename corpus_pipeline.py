"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result
is written as Parquet and read again as the next one's documents. All stages but the last return
the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veracell.functions.session import scratch_path
from veracell.llm import classifier, contamination, near_duplicates, packing, repeats
from veracell.llm.queries import fold, table

#: Bytes of a passage that the repeats stage removes: 51 words of five bytes, the space included.
#: Shorter passages, also such of over 50 words that are shorter still, stay.
PASSAGE_BYTES = 256
#: SQL expresses none of a learned network, walks over sets, and a tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; null and empty texts are scored like others,
    repeated rows alike. Without labels of both kinds all get one score."""
    network = classifier.fit_classifier(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return docs.where(classifier.quality_score(network) >= 0.7)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Of rows that share an id the smallest in the order of the columns stays. Rows without an id
    belong to no group and stay; so do null and empty texts, which are like no other.
    """
    kept = near_duplicates.near_duplicates(docs).where("kept").select("doc_id")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*").select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE_BYTES`` that also begin elsewhere; n_chars is counted
    anew. Null texts and shorter ones stay as they are; equal longer ones become empty."""
    cut = repeats.without_repeats(docs, length=PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those with null and empty texts hold none."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2048 ids, with the ids; a null or empty text is its
    end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicate),
          ("repeated bytes", repeated_bytes), ("decontamination", decontaminate),
          ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
