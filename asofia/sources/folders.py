"""Folders and files shared by all executors: stream state, sinks, and questions in JSON lines."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "id string, question string, relevant array<string>, as_of string, tags array<string>, note string, _bad string"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only where Spark runs in one process, as in local tests, a temporary one may take its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="asofia-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in a work folder: computed once for all that read it, and of known size."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines, ids as text; blank lines are skipped, unreadable ones keep their text in ``_bad``."""
    rows = spark.read.schema(GOLDEN).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumnRenamed("as_of", "as_of_text").select("*", F.col("_metadata.file_path").alias("file"))


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
