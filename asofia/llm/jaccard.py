"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds its distinct word shingles. Sets are dealt to size bands. For two sets of one band (or on
the two sides of one band boundary) with a Jaccard similarity of num/den or more, the symmetric difference is at
most ``k = (den-num)/(den+num) * (|s|+|t|)``. The shingle domain is hashed into more than k/2 first-level partitions and each of
these into SECOND second-level ones. The difference can't touch two second-level partitions in every first-level one, so in one at
least both sets agree on all second-level partitions but one. Each set emits a signature for every
subset of SECOND - 1 second-level partitions of every first-level one, unless the subset holds no shingle. Two linked
sets therefore share a signature, unless every subset they agree on is empty.

Exactness for frequent signatures. A signature held by more than ``hot`` documents is only compared with one leader.
From the number of second-level partitions with shingles follows how many signatures a set shares with any linked one at least. A set with
as many hot signatures or more could lose a link to
another such set; these sets, few in ordinary data, are joined once more by an exact prefix filter on their own
shingles, rarest first. Every other linked pair shares a signature of at most ``hot`` documents, whose pairs are
compared unless they already are in one component. Nothing is capped, sampled or dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.llm import textkernel as tk
from asofia.llm.components import connected_components
from asofia.llm.scratch import Scratch

#: Second-level partitions of each first-level one; signatures leave out one of them.
SECOND = 3
BAND_RATIO = 2.35
SLACK = 1.15
BUCKET_BYTES = 1 << 20
#: Groups of frequent signatures whose leaders are broadcast at most (16 bytes each).
BROADCAST_LEADERS = 500_000
SKETCH_BITS = 1024
SKETCH_SET = 1200


def band_bounds(limit: int) -> np.ndarray:
    """Upper sizes of the bands, up to one that holds ``limit``. The step is over 16/9, so boundary zones don't overlap at 0.75."""
    bounds = [1]
    while bounds[-1] < limit:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * BAND_RATIO)))
    return np.array(bounds, dtype=np.int64)


def schemes(sizes: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set: scheme number, first-level partitions (0: not in a scheme) and the largest difference to a partner.

    The first scheme joins sets of one band, the second those on the two sides of the nearest boundary.
    """
    bounds = band_bounds(int(sizes.max(initial=1)) * 2)
    size = np.maximum(sizes, 1)
    share = lambda total: total * (den - num) // (den + num)
    parts = lambda k: np.ceil(SLACK * (k + 1) / 2).astype(np.int64) + 2
    partner = size * den // num
    band = np.searchsorted(bounds, size, "left")
    high = bounds[band]
    own = (band * 2, np.where(sizes > 0, parts(share(2 * high)), 0), share(size + np.minimum(high, partner)))
    # the nearest boundary: the band's upper one if a larger partner can lie above it, else its lower one
    above = size * den >= num * (high + 1)
    low = np.where(band > 0, bounds[np.maximum(band - 1, 0)], 0)
    below = ~above & (band > 0) & (size <= low * den // num)
    edge = np.where(above, high, low)
    reach = edge * den // num
    used = (sizes > 0) & (above | below) & (reach > edge)
    most = np.where(above, share(size + np.minimum(reach, partner)), share(size + edge))
    zone = (np.where(above, band, band - 1) * 2 + 1, np.where(used, parts(share(edge + reach)), 0), most)
    return [own, zone]


def signatures(values: np.ndarray, bounds: np.ndarray, scheme: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature and row of every subset with shingles; and for each row, how many of its first-level partitions have shingles in just one second-level one, and in several."""
    rows = len(parts)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    chosen = parts[row] > 0
    row, values = row[chosen], values[chosen]
    start = np.concatenate([[0], np.cumsum(parts)])
    spread = tk.mix(values + tk.U64(0x632BE59BD9B4E019)) >> tk.U64(32)
    cell = start[row] * SECOND + ((spread * (parts[row] * SECOND).astype(np.uint64)) >> tk.U64(32)).astype(np.int64)
    total = np.zeros((start[-1], SECOND), dtype=np.uint64)
    np.add.at(total.reshape(-1), cell, values)
    used = np.zeros((start[-1], SECOND), dtype=bool)
    used.reshape(-1)[cell] = True
    filled = used.sum(axis=1)
    owner = np.repeat(np.arange(rows), parts)
    group, out = np.nonzero(filled[:, None] > used)  # the subset without ``out`` has a shingle
    rest = total.sum(axis=1, dtype=np.uint64)[group] - total[group, out]
    place = (group - start[owner[group]]) * SECOND + out
    sig = rest + tk.mix((place.astype(np.uint64) << tk.U64(16)) + scheme[owner[group]].astype(np.uint64))
    return tk.mix(sig), owner[group], np.bincount(owner[filled == 1], minlength=rows), np.bincount(owner[filled > 1], minlength=rows)


def shared_at_least(single: np.ndarray, several: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Signatures that a set has in common with any other whose difference touches ``most`` second-level partitions.

    One touch takes SECOND - 1 signatures from a first-level partition, either all it has (``single``) or all but one (``several``); a second
    touch takes that one.
    """
    both = single + several
    whole = (SECOND - 1) * single + SECOND * several
    return whole - (SECOND - 1) * np.minimum(most, both) - np.clip(most - both, 0, several)


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set: equal sets share it, different ones with a probability of about 2**-63."""
    total = np.concatenate([[tk.U64(0)], np.cumsum(tk.mix(values ^ tk.U64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    named = tk.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return (named >> tk.U64(1)).astype(np.int64)


def sketch_level(sizes: np.ndarray) -> np.ndarray:
    """Level 0 has 1024 bits, each further one eight times as many, so that the sketches of large sets don't fill up."""
    return np.ceil(np.maximum(np.log2(np.maximum(sizes, 1) / SKETCH_SET), 0) / 3).astype(np.int64)


def sketch(values: np.ndarray, level: int) -> np.ndarray:
    """The parities of a set's shingles in 1024 * 8**level slots, as longs. Two sets differ in at least as many shingles as their parities do."""
    bits = SKETCH_BITS << 3 * level
    odd = np.bincount((tk.mix(values) % tk.U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def about_rows(fixed: np.ndarray, values: np.ndarray, bounds: np.ndarray, num: int, den: int) -> bytes:
    """Number of rows, their lengths, and the rows: six numbers, the length of the first sketch, a sketch for the set's own
    size, and a second one if the largest partner's level differs."""
    sizes = np.diff(bounds)
    own, partner = sketch_level(sizes), sketch_level(sizes * den // num)
    rows = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        first = sketch(values[a:b], int(own[i]))
        rows.append(np.concatenate([fixed[i], [len(first)], first, *([sketch(values[a:b], int(partner[i]))] if partner[i] > own[i] else [])]))
    return np.concatenate([[len(rows)], [len(r) for r in rows], *rows]).astype(np.int64).tobytes()


_CELLS = "bucket long, uid long, cells binary"
_FOUND = "kind int, key long, ids array<long>"


def _emit(n: int, num: int, den: int, bits: int):
    def run(batches):
        uid = TaskContext.get().partitionId() << 24
        for batch in batches:
            for piece in tk.pieces(batch, 1, max_rows=4096):
                data, offs = tk.byte_column(piece.column(1))
                values, bounds = tk.shingle_sets(data, offs, n)
                sizes, names = np.diff(bounds), set_ids(values, bounds)
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                _, first = np.unique(np.where(sizes > 0, names, -1 - np.arange(len(names))), return_index=True)
                alone = np.zeros(len(names), dtype=bool)
                alone[first] = True  # copies inside the piece emit once
                keys, owners, margins = [], [], []
                for slot, (scheme, parts, most) in enumerate(schemes(np.where(alone, sizes, 0), num, den)):
                    sig, owner, single, several = signatures(values, bounds, scheme, parts)
                    margins.append(np.where(parts > 0, shared_at_least(single, several, most), 1 << 40))
                    keys.append(sig)
                    owners.append((owner << 1 | slot).astype(np.uint64))
                sig, owner = np.concatenate(keys), np.concatenate(owners)
                bucket = (sig >> tk.U64(64 - bits)).astype(np.int64)
                cell = ((sig & tk.U64((1 << 48) - 1)) << tk.U64(16)) | owner
                order = np.argsort(bucket, kind="stable")
                bucket, cell = bucket[order], cell[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                stop = np.append(edge[1:], len(bucket))[: len(edge)]
                about = np.stack([ids, sizes, names, (uid << 16) + np.arange(len(ids)), *margins], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([bucket[edge], [-1 - uid % (1 << bits)]]), pa.int64()),
                        pa.array(np.full(len(edge) + 1, uid), pa.int64()),
                        pa.array([cell[a:b].tobytes() for a, b in zip(edge, stop, strict=True)] + [about_rows(about, values, bounds, num, den)], pa.binary()),
                    ],
                    names=["bucket", "uid", "cells"],
                )
                uid += 1

    return run


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _meet(hot: int):
    """Inside one bucket: the documents of each shared signature."""

    def run(table: pa.Table) -> pa.Table:
        bucket, uid = table.column("bucket")[0].as_py(), table.column("uid").to_numpy()
        blobs = [np.frombuffer(x, dtype=np.int64) for x in table.column("cells").to_pylist()]
        if bucket < 0:
            length = np.concatenate([b[1 : 1 + b[0]] for b in blobs])
            rows, n = np.concatenate([b[1 + b[0] :] for b in blobs]), len(length)
            return pa.table({"kind": pa.array(np.zeros(n), pa.int32()), "key": pa.array(np.zeros(n), pa.int64()), "ids": _lists(rows, np.concatenate([[0], np.cumsum(length)]))})
        cell = np.concatenate(blobs).view(np.uint64)
        low = cell & tk.U64(0xFFFF)
        loc = (np.repeat(uid, [len(b) for b in blobs]) << 16) + (low >> tk.U64(1)).astype(np.int64)
        sig, slot = cell >> tk.U64(16), (low & tk.U64(1)).astype(np.int64)
        order = np.lexsort((loc, sig))
        sig, loc, slot = sig[order], loc[order], slot[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        run_of = np.cumsum(new) - 1
        count = np.bincount(run_of)
        many = count[run_of] > 1
        sig, loc, slot, run_of = sig[many], loc[many], slot[many], run_of[many]
        if not len(sig):
            return pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        start = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
        size = np.diff(np.concatenate([start, [len(run_of)]]))
        cold = np.repeat(size <= hot, size)
        # groups of few documents, each member list once
        named = np.add.reduceat(tk.mix(loc.astype(np.uint64)), start)[size <= hot]
        _, keep = np.unique(named, return_index=True)
        at, length = start[size <= hot][keep], size[size <= hot][keep]
        gather = np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(at) else np.zeros(0, np.int64)
        # groups of many: each member meets the leader, and the member's hot signatures are counted
        lead = np.repeat(loc[start], size)[~cold]
        trio = np.stack([lead, loc[~cold], slot[~cold]], axis=1)
        trio, times = np.unique(trio, axis=0, return_counts=True) if len(trio) else (trio.reshape(0, 3), np.zeros(0, np.int64))
        flat = np.concatenate([trio[:, 1:], times[:, None]], axis=1).ravel()
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.full(len(at), 1), np.full(len(trio), 2)]), pa.int32()),
                "key": pa.array(np.concatenate([named[keep].view(np.int64), trio[:, 0]]), pa.int64()),
                "ids": _lists(np.concatenate([loc[gather], flat]), np.concatenate([[0], np.cumsum(np.concatenate([length, np.full(len(trio), 3)]))])),
            }
        )

    return run


def _confirm(n: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            for half in tk.pieces(batch, 2, max_rows=2048):
                for piece in tk.pieces(half, 3, max_rows=2048):
                    a, b = (piece.column(i).to_numpy() for i in (0, 1))
                    sets = [tk.shingle_sets(*tk.byte_column(piece.column(i)), n) for i in (2, 3)]
                    named = (set_ids(*sets[0]) == a) & (set_ids(*sets[1]) == b)  # a repeated id may stand for another text
                    good = [i for i in np.flatnonzero(named) if _linked(sets, i, num, den)]
                    yield piece.select([0, 1]).take(pa.array(good, pa.int64()))

    return run


def _linked(sets, i: int, num: int, den: int) -> bool:
    (u, ub), (v, vb) = sets
    u, v = u[ub[i] : ub[i + 1]], v[vb[i] : vb[i + 1]]
    if min(len(u), len(v)) * den < num * max(len(u), len(v)):
        return False
    at = np.searchsorted(v, u)
    both = int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0
    return den * both >= num * (len(u) + len(v) - both) and both > 0


def _explode_sets(n: int):
    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, 1):
                values, bounds = tk.shingle_sets(*tk.byte_column(piece.column(1)), n)
                names, sizes = piece.column(0).to_numpy(), np.diff(bounds)
                good = set_ids(values, bounds) == names
                row = np.repeat(np.arange(len(names)), sizes)
                row, values = row[good[row]], values[good[row]]
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(sizes[row], pa.int64()), pa.array(values.view(np.int64))], names=["node", "size", "gram"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100, hot: int = 24) -> DataFrame:
    """Classes of documents that are linked, directly or through others, by a shingle similarity of num/den or more.

    Returns one row per input row with a non-null id: the id, ``n_shingles`` and ``component_id``, the smallest id
    that links reach. Null, empty or wordless texts have no shingles and are linked with nothing, each its own
    component. Exact copies have equal sets and are one class. A row with a null id has no name to link and is left
    out; rows that repeat an id are each returned. Other columns are ignored. An empty table gives an empty table.
    ``docs`` must be a deterministic plan (a scan with filters and projections); write it to a table first otherwise.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).filter("id is not null")
    total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(4, int(total // BUCKET_BYTES).bit_length())
    found = docs.mapInArrow(_emit(shingle, num, den, bits), _CELLS).groupBy("bucket").applyInArrow(_meet(hot), _FOUND)
    found = scratch.table(found, "found")

    about = found.filter("kind = 0").select(*(F.col("ids")[i].alias(c) for i, c in enumerate(("id", "size", "node", "loc", "margin0", "margin1"))), F.expr("slice(ids, 8, int(ids[6]))").alias("sketch"), F.expr("slice(ids, 8 + int(ids[6]), size(ids))").alias("wider"))
    rows = about.select("id", "size", "node")
    place = about.filter("size > 0").select("loc", "node", "size")
    nodes = scratch.table(about.filter("size > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("wider").alias("wider")), "nodes")

    lists = found.filter("kind = 1").groupBy("key").agg(F.first("ids").alias("ids"))
    lists = lists.select("key", F.explode("ids").alias("loc")).join(place, "loc").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("node", "size"))).alias("members"))
    lists = scratch.table(lists.filter("size(members) > 1").select("members").distinct(), "lists")
    frequent = found.filter("kind = 2").select(F.col("key").alias("lead"), *(F.col("ids")[i].alias(c) for i, c in enumerate(("loc", "slot", "times"))))
    frequent = frequent.groupBy("lead", "loc", "slot").agg(F.sum("times").alias("times"))
    frequent = scratch.table(frequent.join(place, "loc"), "frequent")
    # leaders are few beside the members that meet them, so those stay where they are
    few = lambda df, name: (lambda t: F.broadcast(t) if t.count() <= BROADCAST_LEADERS else t)(scratch.table(df, name))
    leaders = few(frequent.select(F.col("lead").alias("loc")).distinct().join(place, "loc").select(F.col("loc").alias("lead"), F.col("node").alias("leader")), "leaders")
    # the member whose signatures are frequent for the greatest part is the least edited copy: it links to any member that has a link
    share = F.sum("times").over(Window.partitionBy("loc")) / F.col("size")
    middle = few(frequent.withColumn("share", share).groupBy("lead").agg(F.max_by("node", F.struct("share", "node")).alias("middle")), "middle")
    stars = frequent.join(leaders, "lead").select(F.col("leader").alias("x"), "node").union(frequent.join(middle, "lead").select("middle", "node")).filter("x <> node")

    fits = lambda x, y: F.least(x["size"], y["size"]) * den >= F.greatest(x["size"], y["size"]) * num
    star = lists.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, hot)).alias("b"))
    star = star.filter(fits(F.col("a"), F.col("b"))).select("a.node", "b.node").union(stars.select(F.least("x", "node"), F.greatest("x", "node"))).toDF("a", "b").distinct()
    check = lambda pairs, name: scratch.table(_verified(pairs, nodes, docs, scratch, shingle, num, den), name)
    star = scratch.table(_comparable(star, nodes, num, den), "star")
    links = check(star, "links")
    comps = connected_components(links, scratch)

    # pairs of the remaining groups that lie in different components
    labelled = lists.select(F.xxhash64("members").alias("key"), F.inline("members")).join(comps, "node", "left")
    labelled = labelled.select("key", F.struct(F.coalesce("component", "node").alias("comp"), "node", "size").alias("m"))
    labelled = labelled.groupBy("key").agg(F.array_sort(F.collect_set("m")).alias("ms")).filter("ms[0].comp <> ms[size(ms) - 1].comp")
    cross = labelled.select(F.explode("ms").alias("x"), "ms").select("x", F.explode(F.filter("ms", lambda y: (y["comp"] > F.col("x.comp")) & fits(F.col("x"), y))).alias("y"))
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    # sets that could have met a partner only in frequent signatures
    counted = frequent.groupBy("loc").agg(*(F.sum(F.when(F.col("slot") == s, F.col("times"))).alias(f"hot{s}") for s in (0, 1)))
    tight = about.filter("size > 0").join(counted, "loc", "left")
    tight = tight.filter(" or ".join(f"margin{s} <= coalesce(hot{s}, 0)" for s in (0, 1))).select("node").distinct()
    tight = scratch.table(tight.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "tight")
    cross = cross.union(_prefix_pairs(tight, nodes, docs, scratch, shingle, num, den)).distinct()
    cross = scratch.table(_comparable(cross, nodes, num, den).join(star, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        more = check(cross, "more")
        if not more.isEmpty():
            comps = connected_components(links.union(more), scratch)

    named = comps.join(nodes.select("node", "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    label = nodes.select("node", F.col("id").alias("own")).join(named.select("node", "component"), "node", "left").join(least, "component", "left")
    label = label.select("node", F.coalesce("least", "own").alias("component_id"))
    out = rows.join(label, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _comparable(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and sketches don't rule out a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("size", "sketch", "wider")))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num)
    # the smaller set has a second sketch where the larger one's is wider
    level = lambda c, d: F.when(F.size(f"sketch_{c}") < F.size(f"sketch_{d}"), F.col(f"wider_{c}")).otherwise(F.col(f"sketch_{c}"))
    apart = F.aggregate(F.zip_with(level("a", "b"), level("b", "a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return sized.filter(apart * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num)).select("a", "b")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Node and text of the wanted nodes. The ids are broadcast only when they are few enough; a sort-merge join takes over beyond that."""
    ids = wanted.join(nodes, "node").select("node", "id")
    if wanted.count() <= 500_000:
        ids = F.broadcast(ids)
    return docs.join(ids, "id").select("node", "body")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, n: int, num: int, den: int) -> DataFrame:
    wanted = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    texts = _texts(wanted, nodes, docs)
    side = lambda c: texts.select(F.col("node").alias(c), F.col("body").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(n, num, den), "a long, b long").distinct()


def _prefix_pairs(tight: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, n: int, num: int, den: int) -> DataFrame:
    """Pairs of ``tight`` sets in different components that share one of their rarest shingles.

    ``common`` counts a set's shingles that other components have too; no partner can share more. A link needs
    ``num/den * size`` of them at least, so it shows among the rarest ``common - ceil(num/den * size) + 1``. In a group of many
    near copies the counts and the sketches rule out nearly all pairs with a copy that has been edited too much for a
    link, before the join puts them out.
    """
    grams = _texts(tight.select("node"), nodes, docs).mapInArrow(_explode_sets(n), "node long, size long, gram long").distinct()
    grams = scratch.table(grams.join(tight, "node"), "grams")
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mine = Window.partitionBy("node")
    ranked = grams.join(df.filter("lo < hi"), "gram").withColumn("pos", F.row_number().over(mine.orderBy("df", "gram"))).withColumn("common", F.count(F.lit(1)).over(mine))
    ranked = ranked.filter(F.col("pos") <= F.col("common") - F.ceil(F.col("size") * num / den) + 1)
    ranked = scratch.table(ranked.select("gram", "node", "comp", "size", "common"), "prefixes")
    # the largest component of a shingle is compared with the others only
    main = ranked.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("gram", "main")
    ranked = ranked.join(scratch.table(main, "main"), "gram")
    words = SKETCH_BITS // 64
    fold = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.aggregate(F.filter("sketch", lambda _, j: j % words == i), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)))
    folded = nodes.join(ranked.select("node").distinct(), "node").select("node", fold.alias("s"))
    folded = folded.select("node", *(F.col("s")[i].alias(f"s{i}") for i in range(words)))
    # both sides of the join below are read from a table, so Spark can split a frequent shingle's rows
    ranked = scratch.table(ranked.join(folded, "node"), "sides")
    rest = ranked.filter("comp <> main").select("gram", F.col("node").alias("x"), F.col("comp").alias("xc"), F.col("size").alias("xs"), F.col("common").alias("xm"), *(F.col(f"s{i}").alias(f"x{i}") for i in range(words)))
    apart = (F.col("xc") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("x") < F.col("node")))
    apart &= F.least("xs", "size") * den >= F.greatest("xs", "size") * num
    apart &= F.least("xm", "common") * (num + den) >= (F.col("xs") + F.col("size")) * num
    odd = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}"))) for i in range(words)), F.lit(0))
    apart &= odd * (num + den) <= (F.col("xs") + F.col("size")) * (den - num)
    return rest.join(ranked, "gram").filter(apart).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
