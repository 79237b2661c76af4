"""Filtered search over neighbour graphs against comparing everything."""

import numpy as np
import pyarrow as pa
import pytest

from asofia.operators import neighbours as nb
from asofia.operators import windows


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clustered(rng, n, centres):
    return unit(centres[rng.integers(0, len(centres), n)] + 0.4 * rng.normal(size=(n, centres.shape[1])))


def truth(q, x, allowed, n):
    score = np.where(allowed, np.round(q.astype(float) @ x.T.astype(float), 6), -np.inf)
    return [set(np.argsort(-s, kind="stable")[: min(n, int(a.sum()))].tolist()) for s, a in zip(score, allowed, strict=True)]


@pytest.mark.parametrize("share", [0.01, 0.1, 0.2, 0.5, 1])
def test_recall_and_share_compared_on_clusters(share):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    x, q = clustered(rng, nb.BLOCK, centres), clustered(rng, 200, centres)
    allowed = rng.random((len(q), len(x))) < share
    row, column, compared = nb.search_block(q, x, nb.linked(x), allowed, 10, np.arange(len(x)))
    found = [set(column[row == i].tolist()) for i in range(len(q))]
    true = truth(q, x, allowed, 10)
    assert allowed[row, column].all() and len(set(zip(row, column, strict=True))) == len(row) and all(len(f) == len(t) for f, t in zip(found, true, strict=True))
    assert sum(len(f & t) for f, t in zip(found, true, strict=True)) >= 0.9 * sum(map(len, true))
    assert compared.mean() < 0.2 * len(x)


def test_beam_widens_until_the_filter_leaves_enough():
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(2000, 32)))
    q = x[:40]
    allowed = np.zeros((40, 2000), dtype=bool)
    far = np.argsort(q @ x.T, axis=1)[:, :500]  # only what lies opposite may be found
    np.put_along_axis(allowed, far, True, axis=1)
    row, column, _ = nb.search_block(q, x, nb.linked(x), allowed, 10, np.arange(2000))
    assert (np.bincount(row, minlength=40) == 10).all() and allowed[row, column].all()


def test_small_blocks(spark):
    for m in (1, 2, 5):
        x = unit(np.random.default_rng(m).normal(size=(m, 8)))
        row, column, compared = nb.search_block(x, x, nb.linked(x), ~np.eye(m, dtype=bool), 3, np.arange(m))
        assert len(row) == m * min(3, m - 1) and (column != row).all()


def test_a_table_in_many_blocks_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    x = clustered(rng, 900, centres)
    rows = [(i, [float(v) for v in x[i]], i % 7, None if i % 5 == 0 else 100, i % 2 == 0) for i in range(900)]
    table = spark.createDataFrame([*rows, (None, rows[0][1], 0, 100, False), (900, None, 0, 100, False)], "vec_id long, embedding array<float>, a long, b long, c boolean")
    index = nb.neighbour_index(table.selectExpr("vec_id", "embedding", "a as valid_from", "b as valid_to", "c as is_withdrawn").repartition(3), attributes=windows.WINDOW, size=200)
    assert index.count() >= 5
    asked = table.filter("vec_id % 30 = 0").selectExpr("vec_id as qid", "embedding", "vec_id % 60 as as_of")
    got = nb.graph_nearest(asked, index, 5, windows.in_force(30), ("as_of",), exact=True).collect()
    for qid in range(0, 900, 30):
        day = qid % 60
        allowed = np.array([r[0] != qid and r[2] <= day and (r[3] is None or r[3] > day) and (day < 30 or not r[4]) for r in rows])
        score = np.where(allowed, np.round(x.astype(float) @ x[qid].astype(float), 6), -np.inf)
        want = sorted(range(900), key=lambda i: (-score[i], i))[: min(5, int(allowed.sum()))]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.qid == qid] == want
    near = nb.graph_nearest(asked, index, 5, windows.in_force(30), ("as_of",)).select("qid", "vec_id").collect()
    assert len(set(near) & {(r.qid, r.vec_id) for r in got}) >= 0.9 * len(got)
    assert nb.graph_nearest(asked, index.limit(0), 5).count() == 0 and nb.graph_nearest(asked.limit(0), index, 5).count() == 0


def test_scores_are_held_for_some_queries_at_once(monkeypatch):
    from asofia.operators import vectors

    sizes, leading = [], vectors._leading
    monkeypatch.setattr(vectors, "_leading", lambda score, names, n: sizes.append(score.shape) or leading(score, names, n))
    x = np.random.default_rng(1).normal(size=(700, 8))
    block = {"ids": np.arange(700).tobytes(), "matrix": x.tobytes(), "qids": np.arange(700).tobytes(), "q": x.tobytes()}
    out = list(vectors._nearest(3)(iter([pa.RecordBatch.from_pydict({k: [v] for k, v in block.items()})])))
    score = np.round(x @ x.T, 6)
    np.fill_diagonal(score, -np.inf)
    assert max(s[0] for s in sizes) <= 256 and sum(s[0] for s in sizes) == 700
    found = [i for b in out for i in b.column(1).to_pylist()]
    assert found == np.argsort(-score, axis=1, kind="stable")[:, :3].ravel().tolist()
