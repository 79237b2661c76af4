"""The driver's tables seen as the data model: documents with validity windows, questions, edges, follows.

What the tables lack (dates, types, reference numbers) is derived from ids by integer arithmetic, so that another
engine can derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofia.operators import parts

#: The day that counts as today.
TODAY = "2026-10-04"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(table(spark, sf_dir, "documents"))


def documents_of(docs: DataFrame) -> DataFrame:
    """Rows of the table of documents, also as a stream, with the fields that the table lacks."""
    return docs.sparkSession.sql(
        r"""
        select *, date_add(issued_date, if(doc_id % 7 = 0, 30, 0)) as valid_from,
          if(doc_id % 4 = 0, date_add(issued_date, int(if(doc_id % 7 = 0, 30, 0) + 200 + (doc_id * 13) % 700)), null) as valid_to,
          doc_id % 4 = 0 or doc_id % 31 = 0 as is_withdrawn
        from (
          select doc_id, string(doc_id) as source_id, substring(substring_index(text, '\n', 1), 1, 80) as title,
            source as department, element_at(array('circular', 'master_direction', 'notification'), int(doc_id % 3) + 1) as doc_type,
            date_add(date'2015-01-01', int((doc_id * 37) % 3650)) as issued_date,
            timestamp'2024-01-01 00:00:00' + make_dt_interval(0, doc_id) as created_at, text
          from {docs}
        )""",
        docs=docs,
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "select item_id as qid, text as question, element_at(array(date'2026-10-04', date'2019-01-01', date'2022-01-01'), int(item_id % 3) + 1) as as_of from {items}",
        items=table(spark, sf_dir, "benchmark"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between documents: the order lines' keys fold into document ids."""
    edges = relations_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "documents"))
    return edges.repartition(relation_tasks(spark, sf_dir), *edges.columns).distinct()


def relation_tasks(spark: SparkSession, sf_dir: str, times: int = 1) -> int:
    """Tasks for ``times`` as many rows as there are order lines."""
    return parts.tasks(spark, times * table(spark, sf_dir, "lineitem").count())


def relations_of(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The edge that each order line, also of a stream, stands for; repeats are kept."""
    return lines.sparkSession.sql(
        """
        select l_orderkey % n as src, l_partkey % n as dst, element_at(array('amends', 'supersedes', 'repeals', 'refers'), l_linenumber % 4 + 1) as type,
          if(l_linenumber % 2 = 0, 'link', 'regex') as method
        from {lines}, (select max(doc_id) + 1 as n from {docs}) where l_orderkey % n <> l_partkey % n""",
        lines=lines, docs=docs,
    )
