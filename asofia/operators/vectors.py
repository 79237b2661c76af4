"""Vector search, weighted rank fusion and document roll-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.operators.extract import detail_url
from asofia.operators.windows import Allow

RRF_K = 60
LIST_WEIGHTS = {"keyword": 0.3, "vector": 1.0}
CANDIDATES = 50
BUCKETS = 384
#: Vectors of a block, and queries that are broadcast as blocks at most (3 kB each at 384 dimensions).
BLOCK, BROADCAST_QUERIES = 2048, 20_000
#: Queries of a block whose scores are held at once.
SCORED = 256


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def blocks(rows: DataFrame, id_col: str, *keys: str, vector: str = "embedding", size: int = BLOCK) -> DataFrame:
    """Rows as blocks of up to ``size`` vectors: ``key``s, ``ids`` and ``matrix`` (doubles, row by row). Rows with a null id or vector are left out.

    A block has rows of one task with equal keys, so nothing is shuffled.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *keys).filter("id is not null and v is not null")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = table.select(keys).group_by(list(keys)).aggregate([]).to_pylist() if keys else [{}]
            for group in groups:
                some = table
                for name, value in group.items():
                    some = some.filter(pc.is_null(some[name]) if value is None else pc.equal(some[name], pa.scalar(value, some.schema.field(name).type)))
                for low in range(0, len(some), size):
                    part = some.slice(low, size)
                    ids, flat = part["id"].to_numpy(), part["v"].combine_chunks()
                    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
                    matrix = flat.flatten().to_numpy(zero_copy_only=False)
                    columns = [part[name].slice(0, 1).combine_chunks() for name in keys]
                    columns = [c if isinstance(c, pa.Array) else c.chunk(0) for c in columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([ids.astype(np.int64).tobytes()]), pa.array([matrix.astype(np.float64).tobytes()])], names=[*keys, "ids", "matrix"])

    return rows.mapInArrow(run, (kinds + ", " if kinds else "") + "ids binary, matrix binary")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Buffer]]:
    """Rows of binary columns one by one, where they lie: a batch isn't copied."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            yield {name: column[i].as_buffer() for name, column in columns.items()}


def _read(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, dtype=np.int64)
    return names, np.frombuffer(matrix, dtype=np.float64).reshape(len(names), -1 if len(names) else 0)


def _leading(score: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's n greatest scores, equal ones by name."""
    if score.shape[1] > n:
        least = np.partition(score, score.shape[1] - n, axis=1)[:, -n][:, None]
        row, column = np.nonzero(score >= least)
    else:
        row, column = np.nonzero(np.ones(score.shape, dtype=bool))
    order = np.lexsort((names[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < n) & np.isfinite(score[row, column])
    return row[keep], column[keep]


def exact_nearest(queries: DataFrame, vectors: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """``qid, vec_id, cosine, rank``: the n nearest vectors of each query, itself left out.

    Blocks of queries meet blocks of vectors in one matrix product each, and only n per query of a block go on. The query blocks are
    broadcast while they are few; beyond that, block rows are paired by the cluster. Nothing passes the driver.
    """
    left = blocks(queries, "qid").select(F.col("ids").alias("qids"), F.col("matrix").alias("q"))
    if queries.count() <= BROADCAST_QUERIES:
        left = F.broadcast(left)
    near = blocks(vectors, "vec_id").crossJoin(left).mapInArrow(_nearest(n), "qid long, vec_id long, cosine double")
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def _nearest(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            (names, right), (every, rows) = _read(r["ids"], r["matrix"]), _read(r["qids"], r["q"])
            for low in range(0, len(every), SCORED):
                asked, left = every[low : low + SCORED], rows[low : low + SCORED]
                score = np.round(left @ right.T, 6)
                score[asked[:, None] == names[None, :]] = -np.inf
                row, column = _leading(score, names, n)
                yield pa.RecordBatch.from_pydict({"qid": asked[row], "vec_id": names[column], "cosine": score[row, column]})

    return run


def centres(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres of ``lists`` clusters, by k-means on at most ``sample`` vectors, those with the smallest hashes of their ids."""
    rows = vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), dtype=float)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def clustered_nearest(queries: DataFrame, vectors: DataFrame, n: int = 10, lists: int = 128, probes: int = 72, sample: int = 20_000) -> DataFrame:
    """Approximate search: every vector is in the list of its nearest centre, and a query is compared with the ``probes`` nearest lists exactly.

    The centres are fitted on a bounded sample (``sample`` vectors), every vector is indexed. A list is kept as blocks, so a long one is many
    rows. Returns ``qid, vec_id, cosine, rank``, and ``compared``, the number of vectors that the query was compared with.
    """
    c = centres(vectors, lists, sample)

    @F.pandas_udf("array<int>")
    def nearest_lists(column: pd.Series) -> pd.Series:
        near = np.argsort(-(np.array(column.tolist(), dtype=float).reshape(len(column), -1) @ c.T), axis=1, kind="stable")
        return pd.Series(list(near.astype(np.int32)))

    named = lambda df: df.filter("embedding is not null").withColumn("near", nearest_lists("embedding"))
    index = blocks(named(vectors).withColumn("list", F.col("near")[0]).repartition("list"), "vec_id", "list")
    asked = named(queries).withColumn("list", F.explode(F.slice("near", 1, probes)))
    left = blocks(asked.repartition("list"), "qid", "list").select("list", F.col("ids").alias("qids"), F.col("matrix").alias("q"))
    sizes = index.select("list", F.octet_length("ids").alias("bytes")).groupBy("list").agg((F.sum("bytes") / 8).cast("long").alias("size"))
    compared = asked.select("qid", "list").join(sizes, "list").groupBy("qid").agg(F.sum("size").alias("compared"))
    near = index.join(left, "list").select("ids", "matrix", "qids", "q").mapInArrow(_nearest(n), "qid long, vec_id long, cosine double")
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).join(compared, "qid")


def hashed_embedding(rows: DataFrame, id_col: str = "id", term_col: str = "term") -> DataFrame:
    """Bag of words hashed to 384 buckets and scaled to unit length, as a sparse table ``id, bucket, value``.

    The test double for an embedding model: a real one is any function from a text column to an array column.
    """
    bucket = F.conv(F.substring(F.md5(F.col(term_col)), 1, 8), 16, 10).cast("long") % BUCKETS
    counts = rows.groupBy(F.col(id_col).alias("id"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("value"))


def nearest_rows(n: int, allow: Allow | None = None, filters: tuple[str, ...] = (), attributes: tuple[str, ...] = ()):
    """The n nearest of each query in pairs of blocks, among those that it may find and that have anything in common with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            (names, right), (every, rows) = _read(r["ids"], r["matrix"]), _read(r["qids"], r["q"])
            for low in range(0, len(every) if len(names) else 0, SCORED):
                asked, left = every[low : low + SCORED], rows[low : low + SCORED]
                score = np.round(left @ right.T, 6)
                score[score == 0] = -np.inf
                if allow:
                    block = {c: np.frombuffer(r[c], np.int64) for c in filters} | {"id": names}
                    for i in range(len(asked)):
                        score[i, ~allow({a: int(np.frombuffer(r[f"q_{a}"], np.int64)[low + i]) for a in attributes}, block)] = -np.inf
                row, column = _leading(score, names, n)
                yield pa.RecordBatch.from_pydict({"qid": asked[row], "id": names[column], "cosine": score[row, column]})

    return run


def fuse(lists: DataFrame, k: int = 10, weights: dict[str, float] = LIST_WEIGHTS) -> DataFrame:
    """Weighted reciprocal rank fusion of ``qid, id, list, rank``: the sum of weight / (60 + rank).

    Ties go to the better keyword rank, then the better vector rank. The ranks in both lists are reported.
    """
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("list"))
    rank_in = lambda name: F.max(F.when(F.col("list") == name, F.col("rank")))
    fused = lists.groupBy("qid", "id").agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 12).alias("score"), rank_in("keyword").alias("keyword_rank"), rank_in("vector").alias("vector_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("vector_rank"), "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= max(1, k))


def passage_results(lists: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Fused hits with title, issue date and url of their documents. ``k`` is brought into 1 to 20."""
    hits = fuse(lists, min(max(k, 1), 20)).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "source_id", "title", "issued_date"), "doc_id")
    return hits.select("qid", "doc_id", "title", "issued_date", detail_url(F.col("source_id")).alias("url"), "rank")


def rank_documents(hits: DataFrame) -> DataFrame:
    """Documents in the order of their best passage; hits without a document are skipped."""
    best = hits.filter("source_id is not null").groupBy("qid", "source_id").agg(F.min("rank").alias("best"))
    return best.select("qid", "source_id", F.row_number().over(Window.partitionBy("qid").orderBy("best", "source_id")).cast("long").alias("rank"))
