"""Chat formatting after cumulative snapshots are collapsed, in DataFrame functions only.

A logged conversation that grows is often stored again after every exchange. Each turn gets a hash with its number in it, and the
running sum of these over a conversation's turns is a rolling hash that names every prefix of it. A conversation whose whole is a proper
prefix of another one is a snapshot; anti-joins leave the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns that one step of a window or one list handles together; a longer conversation is first split into such blocks.
BLOCK = 32
#: Turns of a rendered row; a longer conversation has several.
PART = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    """63 - 24 bits, so that sums of many stay far from the range of a long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("turn").isNull(), F.coalesce("turn", F.lit(0)), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))), 25)


def collapse_and_render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render each maximal conversation: ``conv_id``, ``part``, ``n_turns``, ``n_snapshots`` and ``rendered``.

    A conversation is dropped if its turns (number, role and text, in order) are the first turns of one with more
    turns. Of conversations with equal turns that with the smallest id stays. ``n_snapshots`` counts the conversations, itself included,
    that a kept one stands for: those with equal turns and those that are its first turns, even if they are another one's too. A conversation
    of over 1024 turns is rendered in several rows, numbered by ``part`` from 0; the other columns are the whole conversation's.

    Turns are ordered by number (null first), role and text; repeated rows are turns of their own. A
    null role or text is rendered as an empty one but isn't equal to an empty one. Rows with a null conversation id form one conversation.
    Other columns are ignored; an empty table gives an empty table.

    Sums and counts of turns are pre-aggregated by blocks of turn numbers, so that a conversation with a third of all
    turns is many small groups; a prefix that many conversations share is one row after map-side aggregation. No list holds more than a part.
    """
    turns = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    hashed = turns.select("*", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"), _turn_hash(17).alias("h1"), _turn_hash(29).alias("h2"))
    blocks = hashed.groupBy("conv", "block").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    base = blocks.select(
        F.col("conv").alias("c"), F.col("block").alias("b"),
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("h1", "h2", "n")),
        *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("h1", "h2", "n")),
    )
    within = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), "h1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE)).alias("line")
    placed = F.col("c").eqNullSafe(F.col("conv")) & (F.col("b") == F.col("block"))

    def numbered(*columns: str) -> DataFrame:
        """Each turn with the hash and the number of the turns up to it."""
        running = hashed.select("conv", "block", *columns, *(F.sum(c).over(within).alias(c) for c in ("h1", "h2")), F.count(F.lit(1)).over(within).alias("n"))
        return running.join(base, placed).select("conv", *columns, *((F.col(c) + F.col(f"before_{c}")).alias(c) for c in ("h1", "h2", "n")), F.col("all_n").alias("of"))

    prefixes = numbered()
    key = ["h1", "h2", "n"]
    longest = prefixes.groupBy(*key).agg(F.max("of").alias("of")).filter("of > n").select(*key)
    totals = base.groupBy("c").agg(*(F.first(f"all_{c}").alias(c) for c in key))
    distinct = totals.groupBy(*key).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("copies"))
    stood_for = prefixes.join(distinct.select(*key, "copies"), key).groupBy("conv").agg(F.sum("copies").alias("n_snapshots")).withColumnRenamed("conv", "s")
    kept = distinct.join(longest, key, "left_anti").select("c", F.col("n").alias("n_turns"))
    kept = kept.join(stood_for, F.col("c").eqNullSafe(F.col("s"))).drop("s")
    rows = numbered("role", "text").select("conv", F.floor((F.col("n") - 1) / PART).alias("part"), "n", line)
    rows = rows.join(kept, F.col("conv").eqNullSafe(F.col("c")))
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda t: t["line"]), "")
    out = rows.groupBy("conv", "part").agg(F.first("n_turns").alias("n_turns"), F.first("n_snapshots").alias("n_snapshots"), rendered.alias("rendered"))
    return out.select(F.col("conv").alias(conv_col), "part", "n_turns", "n_snapshots", "rendered")
