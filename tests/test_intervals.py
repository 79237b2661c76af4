"""Joins of days and windows against nested loops, and the nodes they meet in."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from asofia.operators import intervals

DAY = datetime.date


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    some = lambda: DAY(1969, 1, 1) + datetime.timedelta(rng.randrange(900))
    days = [(i, some()) for i in range(150)] + [(i, DAY(1970, 1, 1)) for i in range(150, 260)] + [(900, None), (901, DAY(1, 1, 1)), (902, DAY(9999, 12, 31)), (903, DAY(1969, 12, 31)), (903, DAY(1969, 12, 31))]
    windows = [(i, some(), rng.choice([None, some(), some()])) for i in range(400)] + [(i, DAY(1970, 1, 1), None) for i in range(400, 600)]
    windows += [(900, None, DAY(2000, 1, 1)), (901, DAY(1970, 1, 1), DAY(1970, 1, 1)), (902, DAY(1970, 1, 1), DAY(1970, 1, 2)), (903, DAY(1, 1, 1), DAY(9999, 12, 31)), (903, DAY(1, 1, 1), None), (None, DAY(1, 1, 1), None)]
    return days, windows, spark.createDataFrame(days, "qid long, day date"), spark.createDataFrame(windows, "doc long, start date, end date")


def inside(day, start, end):
    return day is not None and start is not None and start <= day and (end is None or day < end)


@pytest.mark.parametrize("part", [7, 32_768])
def test_pairs(tables, part):
    days, windows, left, right = tables
    want = sorted((q, -1 if w is None else w) for q, d in days for w, a, b in windows if inside(d, a, b))
    got = sorted((r.qid, -1 if r.doc is None else r.doc) for r in intervals.day_pairs(left, right, "day", "start", "end", "qid", "doc", part).collect())
    assert got == want and len(got) > 10_000


def test_measures(tables):
    days, windows, left, right = tables
    measures = {"n": ("count", F.lit(1)), "ids": ("sum", F.col("doc")), "least": ("min", F.col("start")), "most": ("max", F.col("doc"))}
    got = sorted((tuple(r) for r in intervals.on_day(left, right, "day", "start", "end", measures).collect()), key=str)
    want = []
    for q, d in days:
        met = [(w, a) for w, a, b in windows if inside(d, a, b)]
        ids = [w for w, _ in met if w is not None]
        want.append((q, d, len(met), sum(ids) if ids else None, min((a for _, a in met), default=None), max(ids, default=None)))
    assert got == sorted(want, key=str)


def test_a_window_has_few_nodes_and_they_make_it_up(spark):
    spans = [(0, 1), (1, 1000), (0, 1 << intervals.LEVELS), (123_456, 654_321), (719_162, 719_163), (5, 5), (9, 3)]
    rows = spark.createDataFrame([(DAY(1, 1, 1) + datetime.timedelta(a), DAY(1, 1, 1) + datetime.timedelta(b) if b < 3_000_000 else None) for a, b in spans], "a date, b date")
    for (a, b), r in zip(spans, rows.select(intervals.window_nodes(F.col("a"), F.col("b")).alias("n")).collect(), strict=True):
        pieces = sorted((n["_node"] << n["_level"], (n["_node"] + 1) << n["_level"]) for n in r.n)
        assert len(pieces) <= 2 * intervals.LEVELS and sum(y - x for x, y in pieces) == max(0, b - a)
        assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:], strict=False)) and (not pieces or (pieces[0][0], pieces[-1][1]) == (a, b))


def test_plan_has_no_nested_loop(spark, tables):
    _, _, left, right = tables
    plan = intervals.day_pairs(left, right, "day", "start", "end", "qid", "doc")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
