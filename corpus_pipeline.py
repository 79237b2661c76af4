"""From raw documents to packed training sequences: stages that each read what the one before has written.

All stages but the last return rows of their input unchanged, with all columns it has, whatever their names. Null, empty and wordless texts are
judged like others; the quality rules reject them. Rows with a null id are judged by the first two stages and kept by the next two, which compare
documents by id; rows that repeat an id are one document to those. An empty table gives an empty table. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofia.llm.classifier import keep_accepted, train
from asofia.llm.decontam import contaminated
from asofia.llm.jaccard import jaccard_components
from asofia.llm.packing import packed_sequences
from asofia.llm.queries import tokenizer_path
from asofia.llm.rules import keep_passing
from asofia.llm.scratch import Scratch

#: Ids to remove are broadcast up to this number (8 bytes each); a sort-merge join takes over beyond it.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    ids = scratch.table(ids.select("doc_id").distinct(), "removed")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those that aren't held out, rejects go. Without labels it scores 0.5, so all go."""
    return keep_accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, each row by its own text."""
    return keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of copies stays. Rows with one id count as one document: if any of its texts is a copy of an
    earlier document's, all go, else all stay."""
    return _without(docs, jaccard_components(docs).filter("doc_id <> component_id"), Scratch(spark, "near-duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), Scratch(spark, "decontaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, as one row per piece of a document; rows are packed each on its own, also those that repeat an id."""
    return packed_sequences(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Boosted trees, alignment and column generation are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents below ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
