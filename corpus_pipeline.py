"""A corpus from raw documents to packed sequences: quality rules, language, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import language_id, near_texts, packing, quality_rules
from evalloom.llm.common import documents, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go: null and empty texts do, as they have no words."""
    labels = documents(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_rules.apply_rules(docs.select(*COLUMNS), labels).filter("rules.kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null texts and texts without letters do, and all if nothing can be learned."""
    model = language_id.train_on(docs)
    return docs.select(*COLUMNS, language_id.identify(F.col("text"), model).alias("p")).filter("p.accepted").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id.

    Of rows that share an id the one stays that comes first by its columns in their order; rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    gone = materialize(near_texts.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "duplicates")
    twice = materialize(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    kept = docs.join(gone, "doc_id", "left_anti")
    first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(twice, "doc_id", "left_anti").select(*COLUMNS).union(first.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows: all ids of all documents, repeated rows and rows without an id too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written and read again; an empty table gives no pieces, other columns are left out."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
