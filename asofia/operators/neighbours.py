"""Filtered approximate vector search: a neighbour graph per block of vectors, walked by a beam that widens until the filter leaves enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.operators.vectors import BROADCAST_QUERIES, rows_of
from asofia.operators.windows import NULL, Allow

#: Vectors of a graph; the nearest that each is linked with, and links to any others; entries that every query is compared with.
BLOCK, NEAR, FAR, ENTRIES = 4096, 12, 3, 24
#: Beam of a search for n vectors, as multiples of n and at least; queries of one walk; nodes whose links a step follows.
BEAM, LEAST_BEAM, WALK, STEP = 4, 100, 256, 4
#: Where a filter lets no more than this share of a block pass, what passes is compared as a whole.
FEW = 0.15
#: Vectors of a block that are compared with the others at once.
PRODUCT = 256


def linked(x: np.ndarray) -> np.ndarray:
    """Links of each unit vector: to the nearest others of its block, and to some random ones that keep far groups in reach.

    A block is small, so its neighbours are exact, by blocks of one matrix product; estimating them would cost more.
    """
    m, near = len(x), min(NEAR, len(x) - 1)
    found = np.zeros((m, near), dtype=np.int32)
    for low in range(0, m if near else 0, PRODUCT):
        score = x[low : low + PRODUCT] @ x.T
        score[np.arange(len(score)), np.arange(low, low + len(score))] = -np.inf
        found[low : low + PRODUCT] = np.argpartition(score, m - near, axis=1)[:, m - near :]
    return np.concatenate([found, np.random.default_rng(7).integers(0, m, (m, FAR), dtype=np.int32)], axis=1)


def _walk(q: np.ndarray, x: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The beam of each query, its nodes' scores, best first, and a mask of the vectors that it was compared with. All queries step at once."""
    entries = np.random.default_rng(3).permutation(len(x))[:ENTRIES]
    seen = np.zeros((len(q), len(x)), dtype=bool)
    seen[:, entries] = True
    score = q @ x[entries].T
    order = np.argsort(-score, axis=1, kind="stable")
    score, ids = np.take_along_axis(score, order, axis=1), entries[order].astype(np.int32)
    fresh, live = np.ones(ids.shape, dtype=bool), np.arange(len(q))
    while len(live):
        # a query with fewer fresh nodes than a step takes follows old links again, which lead nowhere new
        pick = np.argsort(~fresh[live], axis=1, kind="stable")[:, :STEP]
        new = np.sort(graph[ids[live[:, None], pick]].reshape(len(live), -1), axis=1)
        fresh[live[:, None], pick] = False
        open_ = ~seen[live[:, None], new]
        open_[:, 1:] &= new[:, 1:] != new[:, :-1]
        row, column = np.nonzero(open_)
        node = new[row, column]
        seen[live[row], node] = True
        value = np.full(new.shape, -np.inf, dtype=q.dtype)
        value[row, column] = np.einsum("ij,ij->i", q[live[row]], x[node])
        if score.shape[1] < width:
            more = ((0, 0), (0, min(width - score.shape[1], new.shape[1])))
            score, ids, fresh = np.pad(score, more, constant_values=-np.inf), np.pad(ids, more), np.pad(fresh, more)
        every, names, flags = (np.concatenate(pair, axis=1) for pair in ((score[live], value), (ids[live], new), (fresh[live], open_)))
        keep = np.argsort(-every, axis=1, kind="stable")[:, : score.shape[1]]
        score[live], ids[live], fresh[live] = (np.take_along_axis(a, keep, axis=1) for a in (every, names, flags))
        live = live[fresh[live].any(axis=1)]
    return ids, score, seen


def search_block(q: np.ndarray, x: np.ndarray, graph: np.ndarray, allowed: np.ndarray, n: int, names: np.ndarray, few_share: float = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of up to n ``allowed`` vectors for each query, and the number of vectors that it was compared with.

    A beam that the filter leaves with too few rows is doubled, until it is as wide as the block if need be.
    """
    passing, compared = allowed.sum(axis=1), np.zeros(len(q), dtype=np.int64)
    rows, columns = [], []
    few = np.flatnonzero(passing <= few_share * len(x))
    for i in few.tolist():
        hit = np.flatnonzero(allowed[i])
        best = hit[np.lexsort((names[hit], -np.round(x[hit].astype(float) @ q[i].astype(float), 6)))[:n]]
        rows.append(np.full(len(best), i))
        columns.append(best)
        compared[i] = len(hit)
    left, width = np.flatnonzero(passing > few_share * len(x)), max(LEAST_BEAM, BEAM * n)
    ever = np.zeros((len(left), len(x)), dtype=bool)
    place = np.arange(len(left))
    while len(left):
        ids, score, seen = _walk(q[left], x, graph, width)
        ever[place] |= seen
        compared[left] = ever[place].sum(axis=1)
        fits = np.isfinite(score) & allowed[left[:, None], ids]
        enough = (fits.sum(axis=1) >= np.minimum(n, passing[left])) | (width >= len(x))
        nth = np.cumsum(fits, axis=1)
        row, column = np.nonzero(fits & (nth <= n) & enough[:, None])
        rows.append(left[row])
        columns.append(ids[row, column])
        left, place, width = left[~enough], place[~enough], width * 2
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(columns or [np.zeros(0, np.int64)]), compared


def neighbour_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", attributes: tuple[str, ...] = (), size: int = BLOCK) -> DataFrame:
    """The index, to be written as a table: blocks of up to ``size`` unit vectors with their graph and ``attributes`` (columns of whole numbers, days as numbers).

    Rows with a null id or vector are left out. A block has rows of one task, so nothing is shuffled, and a table that grows has more blocks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), *(F.col(a).cast("long") for a in attributes)).filter("id is not null and v is not null")

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        x = np.asarray(table["v"].chunk(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(table), -1)
        numbers = [table[c].fill_null(NULL).to_numpy().astype(np.int64).tobytes() for c in ("id", *attributes)]
        columns = [numbers[0], x.tobytes(), linked(x).astype(np.int32).tobytes(), *numbers[1:]]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["ids", "matrix", "graph", *attributes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == size:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in ("ids", "matrix", "graph", *attributes)))


def graph_nearest(queries: DataFrame, index: DataFrame, n: int = 10, allow: Allow | None = None, attributes: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """``qid, vec_id, cosine, rank, compared``: about the n nearest vectors that each query (``qid, embedding``) may find, itself left out.

    ``index`` comes from ``neighbour_index``; ``allow`` takes a query's ``attributes`` and a block's. Queries are broadcast in blocks while they are few; beyond
    that Spark deals pairs of blocks to its tasks. A task gives n rows per query and block. With ``exact`` a query is compared with all vectors that it may find.
    """
    kept = [c for c in index.columns if c not in ("ids", "matrix", "graph")]
    rows = queries.select(F.col("qid").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"), *(F.col(a).cast("long") for a in attributes)).filter("id is not null and v is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, WALK):
                part = batch.slice(low, WALK)
                flat = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
                numbers = [part.column(i).fill_null(NULL).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i in (0, *range(2, part.num_columns))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (numbers[0], flat.tobytes(), *numbers[1:])], names=["qids", "q", *(f"q_{a}" for a in attributes)])

    asked = rows.mapInArrow(pack, ", ".join(f"{c} binary" for c in ("qids", "q", *(f"q_{a}" for a in attributes))))
    if queries.count() <= BROADCAST_QUERIES:
        asked = F.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda raw: np.frombuffer(raw, np.int64)
        for r in rows_of(batches):
            ids, qids = whole(r["ids"]), whole(r["qids"])
            x, q = (np.frombuffer(r[c], np.float32).reshape(len(names), -1) for c, names in (("matrix", ids), ("q", qids)))
            allowed = qids[:, None] != ids[None, :]
            if allow:
                block = {c: whole(r[c]) for c in kept} | {"id": ids}
                for i in range(len(qids)):
                    allowed[i] &= allow({a: int(whole(r[f"q_{a}"])[i]) for a in attributes}, block)
            row, column, compared = search_block(q, x, np.frombuffer(r["graph"], np.int32).reshape(len(ids), -1), allowed, n, ids, 1.0 if exact else FEW)
            cosine = np.round(np.einsum("ij,ij->i", q[row].astype(float), x[column].astype(float)), 6)
            yield pa.RecordBatch.from_pydict({"qid": qids[row], "vec_id": ids[column], "cosine": cosine, "compared": np.zeros(len(row), np.int64)})
            yield pa.RecordBatch.from_pydict({"qid": qids, "vec_id": np.full(len(qids), -1), "cosine": np.full(len(qids), -np.inf), "compared": compared})

    found = index.crossJoin(asked).mapInArrow(run, "qid long, vec_id long, cosine double, compared long")
    mine = Window.partitionBy("qid")
    ranked = found.withColumn("rank", F.row_number().over(mine.orderBy(F.desc("cosine"), "vec_id")).cast("long")).withColumn("compared", F.sum("compared").over(mine))
    return ranked.filter(F.col("rank") <= n).filter(F.col("cosine") > float("-inf")).select("qid", "vec_id", "cosine", "rank", "compared")
