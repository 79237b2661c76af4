"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofia.llm import textkernel as tk
from asofia.llm.rules import covered_words

#: Labelled rows to learn from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAF_ROWS = 80, 4, 64, 0.15, 10
ACCEPT = 0.7

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".!?",
    "bang": b"!",
    "comma": b",;:",
    "mark": b"#*$%&|<>@^~_=+\\/",
    "bar": b"|",
    "wide": range(128, 256),
}
FEATURES = [
    *(f"{c}_share" for c in _CLASSES),
    "log_words", "mean_word", "spread_word", "longest_word", "one_letter_share", "bare_mark_share",
    "distinct_share", "same_as_before", "repeat3", "repeat5", "log_lines", "words_a_line", "line_copy_share",
]


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics per text, over its whole length; zeros for a null or empty one."""
    data, offs = tk.byte_column(column)
    rows = len(offs) - 1
    sums = lambda mask: (lambda t: (t[offs[1:]] - t[offs[:-1]]).astype(float))(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)]))
    inside = ~tk.SEPARATOR[data]
    size = np.maximum(sums(inside), 1)
    columns = []
    for members in _CLASSES.values():
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        columns.append(sums(table[data]) / size)
    h, row, start, end = tk.words(data, offs)
    length = (end - start).astype(float)
    count = np.bincount(row, minlength=rows)
    n = np.maximum(count, 1)
    mean = np.bincount(row, length, rows) / n
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    letters = np.zeros(256, dtype=bool)
    letters[[*_CLASSES["upper"], *_CLASSES["lower"], *_CLASSES["digit"], *_CLASSES["wide"]]] = True
    seen = np.concatenate([[0], np.cumsum(letters[data], dtype=np.int64)])
    bare = seen[end] == seen[start]
    distinct = np.bincount(row[np.unique(h ^ tk.mix(row.astype(np.uint64)), return_index=True)[1]], minlength=rows)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    share = lambda mask: np.bincount(row[mask], minlength=rows) / n
    line_start, line_end = tk.spans(data != 0x0A, offs)
    line_row = tk.row_of(line_start, offs)
    lines = np.bincount(line_row, minlength=rows)
    line_key = tk.hash_spans(data, line_start, line_end) ^ tk.mix(line_row.astype(np.uint64))
    copy = np.ones(len(line_key), dtype=bool)
    copy[np.unique(line_key, return_index=True)[1]] = False
    columns += [
        np.log1p(count), mean, np.sqrt(np.maximum(np.bincount(row, length**2, rows) / n - mean**2, 0)), np.log1p(longest),
        share(length == 1), share(bare), distinct / n, share(same), share(covered_words(h, row, 3)), share(covered_words(h, row, 5)),
        np.log1p(lines), count / np.maximum(lines, 1), np.bincount(line_row[copy], minlength=rows) / np.maximum(lines, 1),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth, laid out level by level: the children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes: values above go right
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            margin += leaf[node - inner] if node.size else 0
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost on the logistic loss. Each level's split gains come from histograms of gradients over quantile bins."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    out = Trees(base, np.zeros((TREES, inner), int), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            choice = np.zeros((width, 2), dtype=np.int64) - 1
            for f in range(x.shape[1]):
                cell = (node - first) * BINS + binned[:, f]
                g, s, c = (np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess, np.ones(len(y))))
                rest = lambda a: a[:, -1:] - a
                gain = g**2 / (s + 1) + rest(g) ** 2 / (rest(s) + 1) - g[:, -1:] ** 2 / (s[:, -1:] + 1)
                gain[(c < LEAF_ROWS) | (rest(c) < LEAF_ROWS)] = 0
                gain[:, len(cuts[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                choice[better] = np.stack([np.full(width, f), at], axis=1)[better]
            for k in range(width):
                if choice[k, 0] >= 0:
                    out.feature[t, first + k] = choice[k, 0]
                    out.limit[t, first + k] = cuts[choice[k, 0]][choice[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.limit[t, node])
        g, s = (np.bincount(node - inner, w, leaves) for w in (grad, hess))
        out.leaf[t] = RATE * g / (s + 1)
        margin += out.leaf[t, node - inner]
    return out


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's text leaves 2 on division by 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def _table(batches):
    for batch in batches:
        for piece in tk.pieces(batch, 1):
            x = features(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on the labelled rows that aren't held out, ``sample_rows`` of them at most.

    The bound makes both the broadcast of ids and the table of statistics that reaches the driver (22 doubles a row)
    small at any size of input. Rows with a null id or label don't take part; an id that is labelled twice counts
    with the larger label.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    chosen = chosen.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in chosen["id"]], "id long")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).join(F.broadcast(ids), "id", "left_semi")
    found = texts.mapInArrow(_table, "id long, x array<double>").toPandas()
    found = found.merge(chosen, on="id").sort_values("id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    order = np.lexsort(x.T[::-1])  # rows arrive in any order
    return fit(x[order], found["y"].to_numpy()[order])


def quality_scores(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Score each text with a fitted model, in one scan with no shuffle; one row per input row.

    ``score`` is the modelled probability of label 1; a null or empty text is scored from its zero statistics, like any other.
    ``predicted`` is 1 from ``accept`` on. A null id stays null, and is not held out. A model fitted without labels scores
    0.5. Other columns are ignored; an empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.scores(features(piece.column(1))), pa.float64())], names=["id", "score"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    out = docs.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, model: Trees, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows, with all their columns, that a fitted model accepts."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, at):
                yield piece.filter(pa.array(model.scores(features(piece.column(at))) >= accept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
