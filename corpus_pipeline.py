"""A corpus pipeline over the training-data operators: poor and toxic documents go, one of each group of near copies stays, languages are
brought to their target weights, and what is left is packed into sequences.

Defined cases, for every stage: a null text counts as empty; null ids, sources and languages are kept and are groups of their own; rows that repeat are judged alike, and
the near-duplicate stage keeps one of them (rows without a doc_id take no part in it and stay); several texts under one doc_id are several documents; an empty
table, or one without labels, loses no document to the classifiers; all other columns, whatever their names, are kept up to packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import mixing, neighbours, packing, quality, toxicity
from memlake.llm.shared import remove, settled, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Without labels of both kinds all stay."""
    return quality.remove_poor(docs, table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Without a positive label all have the prior, and stay."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id. Empty texts are near to none."""
    return neighbours.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of languages under their target more often."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document; an empty text is its end id alone."""
    import public_tokenizers

    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each one's result written as Parquet and read again; what a stage read and wrote on its way is deleted
    once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            remove(docs)
        docs = made
    return docs


#: Learned models and tokenizers can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None
