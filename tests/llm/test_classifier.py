import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from asofia.llm import classifier
from helpers import odd_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = classifier.quality_scores(docs, classifier.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert len(bad) > 5 and np.mean([(g > bad).mean() for g in good]) > 0.97
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all() and (rows.predicted == rows.quality).mean() > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = classifier.train(docs, labels), classifier.train(docs.repartition(3), flipped)
    assert np.array_equal(a.limit, b.limit) and np.allclose(a.leaf, b.leaf)


def test_flat_trees_equal_walked_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(classifier.FEATURES)))
    model = classifier.fit(x, (x[:, 0] + x[:, 3] ** 2 > 0.5).astype(float))

    def walk(row):
        margin = model.base
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            for _ in range(classifier.DEPTH):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(model.scores(x[:50]), [walk(r) for r in x[:50]])


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (11, 0), (99, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        model = classifier.train(docs, given)
        got = classifier.quality_scores(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert classifier.keep_accepted(docs, model).count() == sum(r.predicted for r in got)
    assert classifier.quality_scores(docs.limit(0), model).count() == 0


def plain_features(text):
    """The statistics, one text at a time."""
    data = (text or "").encode()
    parts = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    size = max(sum(map(len, parts)), 1)
    out = [sum(b in set(members) for b in data) / size for members in classifier._CLASSES.values()]
    n = max(len(parts), 1)
    length = [len(w) for w in parts] or [0]
    lines = [x for x in data.split(b"\n") if x]

    def repeated(k):
        windows = [tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)]
        twice = Counter(windows)
        return len({i + j for i, w in enumerate(windows) if twice[w] > 1 for j in range(k)}) / n

    mean = sum(length) / n
    out += [math.log1p(len(parts)), mean, math.sqrt(max(sum(x * x for x in length) / n - mean**2, 0)), math.log1p(max(length)), sum(len(w) == 1 for w in parts) / n]
    out += [sum(not re.search(rb"[A-Za-z0-9\x80-\xff]", w) for w in parts) / n, len(set(parts)) / n, sum(a == b for a, b in pairwise(parts)) / n, repeated(3), repeated(5)]
    return [*out, math.log1p(len(lines)), len(parts) / max(len(lines), 1), (len(lines) - len(set(lines))) / max(len(lines), 1)]


def test_features_match_plain_counting():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += [None, "", " \n\t ", "a", "a a a a\n\na a a a\n", "é ü || ##\nx\x0by", "one two three one two three", "#" * 5000]
    assert np.allclose(classifier.features(pa.array(texts)), [plain_features(t) for t in texts], atol=1e-6)
