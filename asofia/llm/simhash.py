"""Near duplicates by SimHash: fingerprints embedded by the bit counts of their segments, joined on a grid, then compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.llm import textkernel as tk
from asofia.llm.components import connected_components
from asofia.llm.scratch import Scratch
from asofia.llm.wordtable import gather

SHINGLE, SEED, MOST = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 16, 4
#: Fingerprints of a grid cell that are compared pair by pair at most; fuller cells meet by the fingerprints one bit away.
FULL = 32
_CHUNK = 1 << 15


def _hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle, repeats included, and its row. Fewer words than a shingle has are one; a row without words has none."""
    starts, ends = tk.spans(~tk.SEPARATOR[data], offs)
    row = tk.row_of(starts, offs)
    joined = tk.LOWER[gather(data, starts, ends, b" ")]  # words with one space behind each
    end = np.cumsum(ends - starts + 1) - 1
    start = end - (ends - starts)
    count = np.bincount(row, minlength=len(offs) - 1)
    begin = np.cumsum(count) - count
    whole = np.flatnonzero(row[: max(len(row) - SHINGLE + 1, 0)] == row[SHINGLE - 1 :])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    first, last = np.concatenate([whole, begin[short]]), np.concatenate([whole + SHINGLE - 1, begin[short] + count[short] - 1])
    order = np.argsort(first)
    first, last = first[order], last[order]
    return tk.xxh64(joined, start[first], end[last], SEED), row[first]


def fingerprints_of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: a bit is 1 if more than half of the row's hashes have it."""
    hashes, row = _hashes(data, offs)
    rows = len(offs) - 1
    ones, total = np.zeros((rows, 64), dtype=np.int64), np.bincount(row, minlength=rows)
    for low in range(0, len(hashes), _CHUNK):
        part, owner = hashes[low : low + _CHUNK], row[low : low + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ones[owner[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: one row per row, ``fp`` with the fingerprint's 64 bits as a long. A text without words has zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, 1):
                found = fingerprints_of(*tk.byte_column(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_counts(fp: Column) -> Column:
    """A fingerprint's place on the grid: how many bits are set in each of 16 segments of 4 bits, as 16 digits of 4 bits in one long."""
    nth = lambda n: F.shiftrightunsigned(fp, n).bitwiseAND(F.lit(0x1111111111111111))
    return nth(0) + nth(1) + nth(2) + nth(3)


def _cells(place: Column) -> Column:
    """The place itself and those one step away in one segment. Two places at Manhattan distance 2 or less have one of these in common."""
    found = [place]
    for n in range(0, SEGMENTS * SEGMENT_BITS, SEGMENT_BITS):
        digit, step = F.shiftright(place, n).bitwiseAND(F.lit(15)), F.lit(1 << n)
        found += [F.when(digit < SEGMENT_BITS, place + step), F.when(digit > 0, place - step)]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def near_fingerprints(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (``fp``) that connect all those at ``MOST`` (2) or fewer differing bits, and no others.

    The bit counts of two fingerprints differ by no more, in the sum over segments, than their bits do. So both go to the grid cells at
    Manhattan distance 1 or less from their places, where all such pairs meet; what meets is then compared bit by bit. A cell with many
    fingerprints isn't compared pair by pair: each is put to those patterns one bit away that lie in the cell, and fingerprints of one
    pattern, 65 at most, differ by two bits or less.
    """
    place = bit_counts(F.col("fp"))
    cells = fps.select("fp", F.explode(_cells(place)).alias("cell"))
    busy = cells.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("n > 1")
    busy = scratch.table(busy, "cells")
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    few = busy.filter(F.col("n") <= FULL).groupBy("cell").agg(F.collect_list("fp").alias("f"))
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.filter(F.slice("f", i + 2, FULL), lambda y: differ(x, y) <= MOST), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    edges = few.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    # a pattern's cell is the one its own bit counts give, so cells needn't be told apart after this
    patterns = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    many = busy.filter(F.col("n") > FULL).select("fp", "cell", F.explode(patterns).alias("pattern")).filter(bit_counts(F.col("pattern")) == F.col("cell"))
    many = many.groupBy("pattern").agg(F.collect_list("fp").alias("f")).filter(F.size("f") > 1).select(F.array_min("f").alias("a"), F.explode("f").alias("b")).filter("a <> b")
    return edges.union(many).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest id that is reachable by fingerprints with two or fewer differing bits.

    Every row has its result. Null, empty and wordless texts have fingerprint zero, and are linked like others. Rows that repeat an id are
    linked each by its own text; a null id belongs to its component but never names it (a component without other ids has null). Equal
    fingerprints fold into one before the join. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = connected_components(near_fingerprints(fps, scratch), scratch)
    named = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
