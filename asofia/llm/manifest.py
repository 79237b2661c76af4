"""A Merkle manifest of a dataset: leaf digests rolled up by the digits of their ranks, with a proof for each leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.llm.scratch import Scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run, and levels of a block: 3**6 = 729 nodes are nested in one row at most.
RUN, LEVELS = 3, 6
SPAN = RUN**LEVELS
#: Rows of places of range partitions that are broadcast at most, some 50 bytes each.
BROADCAST_PLACES = 200_000


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256 of a row: each value as its number of UTF-8 bytes, a colon and itself, null as ``-``."""
    coded = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(coded(c.cast("string")) for c in columns.values())), 256)


def _ranked(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``tree``, ``n`` and ``rank``: a number for each value of ``tree_key``, its number of nodes, and a node's place among them by ``order_key``.

    Nodes are sorted by ranges, so that a large tree is spread over many tasks; what is counted per range, and per tree, are few rows.
    Equal nodes differ by ``tie``, so that even these can be cut apart.
    """
    order = ["tree_key", "order_key", "h", "tie"]
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id()) if "tie" not in nodes.columns else nodes
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = scratch.table(ranged.withColumn("part", F.shiftright("at", 33)), "ranged")
    places = scratch.table(ranged.groupBy("tree_key", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("low")), "places")
    within = Window.partitionBy("tree_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0)) - F.col("low")
    places = places.select("tree_key", "part", before.alias("shift"), F.sum("size").over(Window.partitionBy("tree_key")).alias("n"), "low")
    # the first node of a tree is the tree's number: places are told apart and in the order of the keys
    first = F.min("low").over(Window.partitionBy("tree_key"))
    places = scratch.table(places.select("tree_key", "part", "shift", "n", first.alias("tree")), "shifts")
    few = places.count() <= BROADCAST_PLACES
    found = places.select(F.col("tree_key").alias("key"), F.col("part").alias("of"), "shift", "n", "tree")
    joined = ranged.join(F.broadcast(found) if few else found, F.col("tree_key").eqNullSafe(F.col("key")) & (F.col("part") == F.col("of")))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("key", "of", "shift", "at", "part", "tie")


def _hashed(kids: Column, level: int) -> Column:
    """A run's digest. A tree of one node left is done, so its node goes up unchanged."""
    parts = F.transform(kids, lambda k: k["h"])
    return F.when(F.col("n") > RUN ** (level - 1), F.sha2(F.concat_ws("", parts), 256)).otherwise(parts[0])


def _rolled(nodes: DataFrame) -> DataFrame:
    """Blocks of up to 729 nodes: ``tree, rank`` (of the block), ``n`` (blocks of the tree), ``h`` and ``body``, the nested runs down to the nodes' own bodies.

    Nodes are shuffled once, by block; a block's rank digits are then grouped away one after another where they are.
    """
    digits = [F.expr(f"rank div {RUN**i} % {RUN}").alias(f"d{i + 1}") for i in range(LEVELS)]
    rows = nodes.select("tree", "n", "h", "body", F.expr(f"rank div {SPAN}").alias("block"), *digits).repartition("tree", "block")
    for level in range(1, LEVELS + 1):
        keys = ["tree", "n", "block", *(f"d{i}" for i in range(level + 1, LEVELS + 1))]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "h", "body"))).alias("kids"))
        rows = rows.select(*keys, _hashed(F.col("kids"), level).alias("h"), F.col("kids").alias("body"))
    return rows.select("tree", F.col("block").alias("rank"), "n", F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("blocks"), "h", "body")


def _opened(rows: DataFrame) -> DataFrame:
    """The nodes of blocks with their ``path``: for each run up to the root, what stands left and right of it there. Nested runs are taken apart one level at a time."""
    names = lambda kids: F.concat_ws("", F.transform(kids, lambda k: k["h"]))
    for level in range(LEVELS, 0, -1):
        kids = F.col("body")
        each = F.transform(kids, lambda k, i: F.struct(k["d"].alias("d"), k["body"].alias("body"), names(F.slice(kids, 1, i)).alias("left"), names(F.slice(kids, i + 2, RUN)).alias("right")))  # noqa: B023
        rows = rows.select("tree", "n", "rank", "path", "root", "subroot", F.explode(each).alias("k"))
        path = F.when(F.col("n") > RUN ** (level - 1), F.concat(F.array(F.struct("k.left", "k.right")), "path")).otherwise(F.col("path"))
        rows = rows.select("tree", "n", (F.col("rank") * RUN + F.col("k.d")).alias("rank"), path.alias("path"), "root", "subroot", F.col("k.body").alias("body"))
    return rows


def _tree(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all trees, lowest first, and the trees' roots as ``tree, h``. A round divides the nodes by 729."""
    levels = []
    while True:
        levels.append(scratch.table(_rolled(nodes), "blocks"))
        if levels[-1].filter("blocks > 1").isEmpty():
            return levels, levels[-1].select("tree", "h")
        nodes = levels[-1].select("tree", "rank", F.col("blocks").alias("n"), "h", F.lit(None).cast("int").alias("body"))


def _paths(levels: list[DataFrame], roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the lowest blocks with their whole paths. ``roots`` has ``tree, path, root, subroot``. Above the blocks one row a block is joined."""
    top = roots.withColumn("rank", F.lit(0).cast("long"))
    for blocks in reversed(levels[1:]):
        top = scratch.table(_opened(blocks.join(top, ["tree", "rank"])).drop("n", "body"), "paths")
    return _opened(levels[0].join(top, ["tree", "rank"]))


def _fold(start: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.col("path"), start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A source's leaves, in the order of their ids, are hashed in runs of three until one is left, its subroot; subroots, in the order of the
    sources (null first, then by bytes), give the root. ``altered`` has columns that stand for a later copy of the rows: the root is
    computed anew from such a leaf and the siblings of the original, so that a change shows. Without it, copies are the rows themselves.

    Every row is a leaf, repeated rows too (rows with one id are ordered by digest); null ids come first. A table with one row has its leaf
    as its root. An empty table gives an empty one. Only the columns named are hashed, whatever others there are.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    plain = {name: F.col(name) for name in COLUMNS}
    rows = docs.select(F.col("source").cast("string").alias("tree_key"), F.col("doc_id").alias("order_key"), leaf(plain).alias("h"), leaf(plain | (altered or {})).alias("other"))
    rows = rows.select("tree_key", "order_key", "h", F.nullif("other", "h").alias("other"), F.monotonically_increasing_id().alias("tie"))
    nodes = _ranked(scratch.table(rows, "leaves"), scratch)
    body = F.struct(F.col("order_key").alias("doc_id"), "h", "other")
    levels, subroots = _tree(nodes.select("tree", "rank", "n", "h", body.alias("body")), scratch)
    # a tree's number grows with its source, so it orders the subroots
    above = subroots.select(F.lit(0).alias("tree_key"), F.col("tree").alias("order_key"), "h")
    tops, root = _tree(_ranked(above, scratch).select("tree", "rank", "n", "h", F.struct(F.col("order_key").alias("tree"), "h").alias("body")), scratch)
    start = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("root"), F.lit(None).cast("string").alias("subroot"))
    sources = scratch.table(_paths(tops, start, scratch).select("body.tree", "path", "root", F.col("body.h").alias("subroot")), "sources")
    found = _paths(levels, sources, scratch).select("body.*", "path", "root", "subroot")
    beside = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    found = found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), _fold(F.coalesce("other", "h")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
