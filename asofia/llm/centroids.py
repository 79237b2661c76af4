"""Centroid clustering of integer vectors: exact squared distances by bit planes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.llm.scratch import Scratch

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components reach from -2**26 to 2**26 - 1, so that 27 planes are the most and every squared distance fits a long.
MOST_PLANES = 27
_PIECE = 4096


def planes_of(whole: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 integers: ``planes[i, p]`` has bit p of all components of row i, component j at bit j.

    Two's complement with as many planes as the rows need; the last plane is the sign.
    """
    top = int(np.where(whole < 0, ~whole, whole).max(initial=0)).bit_length() + 1
    bits = (whole[:, None, :] >> np.arange(top)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8").reshape(len(whole), top)


def components_of(planes: np.ndarray) -> np.ndarray:
    """The integers behind bit planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return (bits.astype(np.int64) * _weights(planes.shape[1])[None, :, None]).sum(axis=1)


def _weights(n: int) -> np.ndarray:
    weight = np.int64(1) << np.arange(n, dtype=np.int64)
    weight[-1] *= -1
    return weight


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot product of each row of ``left`` with the one row ``right``, both as planes: an AND-popcount for each pair of planes, weighted by both places."""
    total = np.zeros(len(left), dtype=np.int64)
    for p, a in enumerate(_weights(left.shape[1]).tolist()):
        for q, b in enumerate(_weights(len(right)).tolist()):
            if right[q]:
                total += np.bitwise_count(left[:, p] & right[q]).astype(np.int64) * (a * b)
    return total


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared length of each row, by the AND-popcounts of its own planes."""
    total, weight = np.zeros(len(planes), dtype=np.int64), _weights(planes.shape[1]).tolist()
    for p, a in enumerate(weight):
        for q in range(p, len(weight)):
            total += np.bitwise_count(planes[:, p] & planes[:, q]).astype(np.int64) * (a * weight[q] * (1 if p == q else 2))
    return total


def nearest(planes: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, of equally near ones the smallest, and the squared distance."""
    own = norms(planes)
    best, least = np.zeros(len(planes), dtype=np.int32), None
    for k, centroid in enumerate(centroids):
        distance = own + norms(centroid[None])[0] - 2 * dots(planes, centroid)
        if least is None:
            least = distance
        else:
            nearer = distance < least
            best[nearer], least[nearer] = k, distance[nearer]
    return best, least


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and the vector's ``planes``, 8 bytes each: component x becomes floor(64 * x).

    Left out are vectors that are null, don't have 64 components or have a null, non-finite or too large one (``MOST_PLANES``).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.size("v") == DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _PIECE):
                part = batch.slice(low, _PIECE)
                flat = part.column(1).flatten()
                whole = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(part.num_rows, DIMENSIONS)
                if flat.null_count:
                    whole = np.where(np.asarray(flat.is_null()).reshape(whole.shape), np.nan, whole)
                with np.errstate(invalid="ignore", over="ignore"):
                    whole = np.floor(whole * SCALE)
                    keep = np.flatnonzero((np.isfinite(whole) & (whole >= -(2.0 ** (MOST_PLANES - 1))) & (whole < 2.0 ** (MOST_PLANES - 1))).all(axis=1))
                planes = planes_of(whole[keep].astype(np.int64))
                packed = pa.array([row.tobytes() for row in planes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), packed], names=["vec_id", "planes"])

    return rows.mapInArrow(run, "vec_id long, planes binary")


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and planes of rows with equally many planes, some thousand at a time."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, size = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(offsets)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for low in range(0, len(at), _PIECE):
            some = at[low : low + _PIECE]
            yield some, np.ascontiguousarray(data[offsets[some][:, None] + np.arange(n)]).view("<u8")


def _sums(rows: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """Number and componentwise sum of each centroid's vectors. A task gives one row per centroid, so the shuffle doesn't grow with the table's rows."""
    columns = [f"s{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), DIMENSIONS), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, planes in _read(batch.column(0)):
                best, _ = nearest(planes, centroids)
                np.add.at(total, best, components_of(planes))
                count += np.bincount(best, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(DIMENSIONS))], names=["cluster", "n", *columns])

    parts = rows.select("planes").mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} long" for c in columns))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns))


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of 64 components, by exact integer arithmetic.

    Centroids start as the vectors with the smallest SHA-256 of ``1:<vec_id>`` (of rows with one id, the smallest planes first). A round
    assigns all vectors and moves each centroid that has some to the floor of their mean. Only centroids pass the driver: ``clusters`` times
    64 numbers a round. Vectors that ``quantised`` leaves out have no row; repeated rows are vectors of their own; a null id can't start a
    centroid but is assigned like others. Fewer ids than ``clusters`` give fewer centroids, a table without any id no rows.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    rows = scratch.table(quantised(vectors, id_col, vector_col), "planes")
    ranked = rows.filter("vec_id is not null").select("planes", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("key"))
    first = ranked.orderBy("key", "planes").limit(clusters).select("planes").collect()
    centroids = [np.frombuffer(r["planes"], "<u8") for r in first]
    for _ in range(rounds if centroids else 0):
        for r in _sums(rows, centroids).collect():
            centroids[r["cluster"]] = planes_of(np.array([[r[f"s{i}"] // r["n"] for i in range(DIMENSIONS)]], dtype=np.int64))[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, planes in _read(batch.column(1)):
                best, distance = nearest(planes, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(best), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = rows if centroids else rows.limit(0)
    assigned = scratch.table(assigned.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    digests = [hashlib.sha256(",".join(map(str, components_of(c[None])[0].tolist())).encode()).hexdigest() for c in centroids]
    named = vectors.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # one row a cluster, as is ``named``
    inertia = inertia.join(F.broadcast(inertia.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(named), "cluster")
    return assigned.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
