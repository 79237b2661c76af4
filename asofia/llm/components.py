"""Connected components of an edge table, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label each node that has an edge with the smallest node of its component.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and loops don't matter, rows with a null
    end are ignored. Returns ``node`` and ``component``; no edges give an empty table. A round hangs each node below its smallest neighbour, follows these
    steps down to the end by pointer jumping, and draws the edges anew between ends, where most become loops and go, so that later rounds
    have few edges. Every step is written to the scratch folder; no label ever reaches the driver.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = scratch.table(edges.filter("a is not null and b is not null").select(*ordered("a", "b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    edges = edges.filter("a < b")
    while not edges.isEmpty():
        up = scratch.table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("end")), "up")
        while True:
            further = up.select(F.col("node").alias("end"), F.col("end").alias("further"))
            up = scratch.table(up.join(further, "end", "left").select("node", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), "up")
            if up.filter("moved").isEmpty():
                break
        end = lambda c: up.select(F.col("node").alias(c), F.col("end").alias(f"end_{c}"))  # noqa: E731, B023
        edges = edges.join(end("b"), "b").filter("a <> end_b").join(end("a"), "a", "left").select(*ordered(F.coalesce("end_a", "a"), "end_b"))
        edges = scratch.table(edges.filter("a < b").distinct(), "edges")
        labels = scratch.table(labels.join(end("component"), "component", "left").select("node", F.coalesce("end_component", "component").alias("component")), "labels")
    return labels.select("node", "component")
