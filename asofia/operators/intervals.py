"""Joins of days with windows ``[start, end)``, both of any number, as equi-joins.

The calendar is a binary tree of days: a node of level k has 2**k days. A window is the disjoint union of at most two nodes of each level, and a day is
in exactly one node of each level, so a day meets a window that holds it in exactly one node and no other window at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofia.operators.parts import PART, PIECE, parted

#: The tree spans 2**22 days from the first of the year 1 on, more than the dates that Spark has.
LEVELS, FIRST = 22, 719_162
NODE = ("_level", "_node")


def _number(day: Column) -> Column:
    return F.unix_date(day).cast("long") + FIRST


def window_nodes(start: Column, end: Column) -> Column:
    """The nodes that make up a window, as an array of ``_level, _node``. No start: none. No end: open for good.

    On level k the nodes wholly inside begin at ceil(start / 2**k) and end before floor(end / 2**k); those that can't be paired into the next level stay.
    """
    low, high = _number(start), F.coalesce(_number(end), F.lit(1 << LEVELS).cast("long"))
    found = []
    for k in range(LEVELS + 1):
        a, b = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high, k)
        node = lambda n, k=k: F.struct(F.lit(k).alias("_level"), n.alias("_node"))
        found += [F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1))]
    return F.filter(F.array(*found), lambda n: n.isNotNull())


def day_nodes(day: Column) -> Column:
    """The nodes that hold a day, one of each level; none for a null."""
    nodes = F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(_number(day), k).alias("_node")) for k in range(LEVELS + 1)))
    return F.when(day.isNotNull(), nodes)


def effective_end(end: Column, withdrawn: Column, today: Column) -> Column:
    """The end that makes ``temporal.searchable`` a plain window: what is withdrawn isn't found from today on."""
    return F.when(withdrawn, F.least(end, today)).otherwise(end)


def _at_nodes(rows: DataFrame, nodes: Column) -> DataFrame:
    return rows.withColumn("_at", F.explode(nodes)).select(*rows.columns, "_at._level", "_at._node")


def on_day(days: DataFrame, windows: DataFrame, day: str, start: str, end: str, measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows of ``days`` with measures over the windows that hold their day; without such a window counts are 0, other measures null.

    ``measures`` names a kind (``count``, ``sum``, ``min`` or ``max``) and what it is of. No pairs are made: windows are aggregated by node before
    they are shuffled, so what meets grows with the calendar, not with the tables. Other columns of ``windows`` don't come out.
    """
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    whole = first | {"count": F.sum}
    columns = [of.alias(f"_{name}") for name, (_, of) in measures.items()]
    rows = _at_nodes(windows.select(F.col(start).alias("_start"), F.col(end).alias("_end"), *columns), window_nodes(F.col("_start"), F.col("_end")))
    totals = rows.groupBy(*NODE).agg(*(first[kind](f"_{name}").alias(f"_{name}") for name, (kind, _) in measures.items()))
    asked = days.select(F.col(day).alias("_day")).distinct()
    met = _at_nodes(asked, day_nodes(F.col("_day"))).join(totals, list(NODE))
    by_day = met.groupBy("_day").agg(*(whole[kind](f"_{name}").alias(f"_{name}") for name, (kind, _) in measures.items()))
    value = lambda name, kind: (F.coalesce(F.col(f"_{name}"), F.lit(0)) if kind == "count" else F.col(f"_{name}")).alias(name)
    return days.join(by_day, F.col(day) == F.col("_day"), "left").select(*days.columns, *(value(name, kind) for name, (kind, _) in measures.items()))


def day_pairs(days: DataFrame, windows: DataFrame, day: str, start: str, end: str, day_id: str, window_id: str, part: int = PART) -> DataFrame:
    """Pairs ``day_id, window_id`` of days and the windows that hold them, each once; rows that are there twice pair twice.

    A node with many rows is cut into pieces on either side, so one popular day or a third of all windows in one node is many tasks. The ids are salts too:
    rows with one id stay together.
    """
    left = _at_nodes(days.select(F.col(day_id).alias("_day_id"), F.col(day).alias("_day")), day_nodes(F.col("_day"))).drop("_day")
    right = _at_nodes(windows.select(F.col(window_id).alias("_window_id"), F.col(start).alias("_start"), F.col(end).alias("_end")), window_nodes(F.col("_start"), F.col("_end")))
    left, right = parted(left, right.drop("_start", "_end"), NODE, "_day_id", "_window_id", part)
    return left.join(right, [*NODE, *PIECE]).select(F.col("_day_id").alias(day_id), F.col("_window_id").alias(window_id))
