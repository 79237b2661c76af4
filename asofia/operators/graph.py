"""Operators on the graph of edges between documents, as of a day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.functions import temporal

AMENDERS = 3


def amendments_in_force(given: DataFrame, edges: DataFrame, docs: DataFrame, today: str) -> DataFrame:
    """``qid, doc_id, issued_date``: documents that amend a given one and are in force on the question's day, those given left out.

    ``given`` has ``qid, doc_id, as_of``. A document that amends several given ones is found once.
    """
    amends = edges.filter("type = 'amends'").select(F.col("src").alias("amender"), F.col("dst").alias("doc_id"))
    found = given.join(amends, "doc_id").select("qid", "as_of", F.col("amender").alias("doc_id")).distinct()
    found = found.join(docs.select("doc_id", "issued_date", "valid_from", "valid_to", "is_withdrawn"), "doc_id")
    ok = temporal.searchable(F.col("valid_from"), F.col("valid_to"), F.col("is_withdrawn"), F.col("as_of"), F.lit(today).cast("date"))
    return found.filter(ok).select("qid", "doc_id", "issued_date").join(given.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def best_passages(wanted: DataFrame, passages: DataFrame, scores: DataFrame) -> DataFrame:
    """For each ``qid, doc_id`` the passage that scores highest, the first one among equals or if none matches."""
    rows = wanted.join(passages.select("doc_id", "chunk_id", "ord"), "doc_id").join(scores.select("qid", F.col("id").alias("chunk_id"), "score"), ["qid", "chunk_id"], "left")
    rows = rows.withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "ord")
    return rows.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def expand_with_amendments(hits: DataFrame, edges: DataFrame, docs: DataFrame, passages: DataFrame, scores: Callable[[DataFrame], DataFrame], today: str, limit: int = AMENDERS) -> DataFrame:
    """Hits (``qid, doc_id, chunk_id, as_of, score``) and the best passage of the newest amenders, with score 0.

    ``scores`` gives the scores of passages of the documents it is given (``qid, doc_id``). The limit counts amenders before those without passages
    fall out.
    """
    given = hits.select("qid", "doc_id", "as_of").distinct()
    amenders = amendments_in_force(given, edges, docs, today)
    newest = Window.partitionBy("qid").orderBy(F.desc("issued_date"), "doc_id")
    amenders = amenders.withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= limit).select("qid", "doc_id")
    added = best_passages(amenders, passages, scores(amenders)).select("qid", "doc_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(True).alias("added"))
    return hits.select("qid", "doc_id", "chunk_id", "score", F.lit(False).alias("added")).unionByName(added)


#: Section of a timeline by direction and edge type.
SECTIONS = {("in", "amends"): "amended_by", ("out", "amends"): "amends", ("in", "supersedes"): "superseded_by", ("in", "repeals"): "superseded_by", ("out", "supersedes"): "supersedes"}


def _with_other(both: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """Rows with what ``docs`` (``other``) says of the other document, dealt to so many tasks by ``doc_id``."""
    return both.repartition(tasks, "other").join(docs.repartition(tasks, "other"), "other").repartition(tasks, "doc_id")


def timeline(edges: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """``doc_id, section, other, type, method, issued_date, place``: what happened to each document and what it did, newest first.

    ``tasks`` share the joins and sorts; take as many as the edges ask for (``parts.tasks``).
    """
    both = edges.select(F.col("dst").alias("doc_id"), F.col("src").alias("other"), F.lit("in").alias("way"), "type", "method")
    both = both.union(edges.select("src", "dst", F.lit("out"), "type", "method"))
    section = F.lit(None).cast("string")
    for (way, kind), name in SECTIONS.items():
        section = F.when((F.col("way") == way) & (F.col("type") == kind), name).otherwise(section)
    rows = both.withColumn("section", section).filter("section is not null")
    rows = _with_other(rows, docs.select(F.col("doc_id").alias("other"), "issued_date"), tasks)
    order = Window.partitionBy("doc_id", "section").orderBy(F.desc("issued_date"), "other", "type", "method")
    return rows.select("doc_id", "section", "other", "type", "method", "issued_date", F.row_number().over(order).cast("long").alias("place"))


def amendment_chain(edges: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """Every edge at a document but mere references, in both directions, newest other document first; repeated ``edges`` count once.

    ``tasks`` share the work, as in ``timeline``.
    """
    strong = edges.filter("type <> 'refers'").select("src", "dst", "type").repartition(tasks, "src", "dst", "type").distinct()
    both = strong.select(F.col("src").alias("doc_id"), F.col("dst").alias("other"), F.lit("out").alias("way"), "type")
    both = both.union(strong.select("dst", "src", F.lit("in"), "type"))
    both = _with_other(both, docs.select(F.col("doc_id").alias("other"), "issued_date", "title"), tasks)
    order = Window.partitionBy("doc_id").orderBy(F.desc("issued_date"), "other", "way", "type")
    return both.select("doc_id", "other", "way", "type", "issued_date", "title", F.row_number().over(order).cast("long").alias("place"))
