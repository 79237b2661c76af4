import numpy as np
import pytest

from asofia.llm import decontam
from helpers import DATA, odd_documents


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def plain(text):
    return text.translate({i: i + 32 for i in range(65, 91)} | {ord(c): " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}).split() if text else []


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        items, passages = rng.integers(2, 6, (5, 9)).astype(np.uint64), rng.integers(2, 6, (5, 17)).astype(np.uint64)
        assert decontam.align(items, passages)[0].tolist() == [smith_waterman(a, b) for a, b in zip(items.tolist(), passages.tolist(), strict=True)]


def test_whole_table_against_all_pairs(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontam.contaminated(docs, items).collect()}
    tests = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {}
    for d in docs.select("doc_id", "text").collect():
        w = plain(d.text)
        vocabulary = set(w)
        for i, t in tests:
            if sum(x in vocabulary for x in t) * 2 >= len(t):  # a score of a half needs half of the words
                score = smith_waterman(t, w) / (2 * len(t))
                if score >= decontam.ACCEPT:
                    want[d.doc_id, i] = round(score, 9)
    assert got == want


def test_edited_copies(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    docs = [(1, f"x {item} y"), (2, " ".join(w[:7] + ["new"] + w[8:14] + w[15:])), (3, item.upper().replace(" ", ", ")), (4, " ".join(w[:6])), (5, " ".join(reversed(w))), (6, None), (None, item)] + [(i, f"{item} {i}") for i in range(10, 60)]
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b"), (None, item)], "item_id long, text string")).collect()
    found = {r.doc_id: r.score for r in rows}
    assert set(found) == {1, 2, 3, *range(10, 60)} and found[1] == found[3] == 1 and 0.7 < found[2] < 1


def test_one_frequent_seed_is_enough(spark):
    """Edited copies with a single common trigram left, and items of three and four words, in half of all documents."""
    long, edited = "m1 m2 m3 m4 m5 m6 m7 m8 m9 m10 m11 m12 m13 m14 m15", "m1 m2 m3 x m5 m6 x m8 m9 x m11 m12 x m14 m15"
    docs = [(i, f"p{i} {edited} q{i}") for i in range(20)] + [(20 + i, f"p{i} one two three q{i}") for i in range(20)] + [(40 + i, f"p{i} four five six q{i}") for i in range(20)] + [(60 + i, f"m1 m2 m3 u{i}") for i in range(20)]
    items = spark.createDataFrame([(1, long), (2, "one two three"), (3, "four five six seven")], "item_id long, text string")
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == {(i, 1 + i // 20): (0.6, 1.0, 0.75)[i // 20] for i in range(60)}


@pytest.mark.parametrize("others", [0, 30_000])
@pytest.mark.parametrize("bound", [decontam.BROADCAST_GRAMS, 0])
def test_a_pair_does_not_depend_on_other_documents(spark, monkeypatch, others, bound):
    """The same copies among few and many documents, with the grams broadcast and shuffled."""
    monkeypatch.setattr(decontam, "BROADCAST_GRAMS", bound)
    monkeypatch.setattr(decontam, "BROADCAST_IDS", bound)
    long = "m1 m2 m3 m4 m5 m6 m7 m8 m9 m10 m11 m12 m13 m14 m15"
    docs = [(1, "a one two three b"), (2, "p m1 m2 m3 x m5 m6 x m8 m9 x m11 m12 x m14 m15 q"), (3, "p m1 m2 m3 q"), (4, "one two four")]
    df = spark.createDataFrame(docs, "doc_id long, text string").union(spark.range(100, 100 + others).selectExpr("id", "concat('one two ', id, ' m1 m2 other ', id)"))
    rows = decontam.contaminated(df, spark.createDataFrame([(1, "one two three"), (2, long)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == {(1, 1): 1.0, (2, 2): 0.6}


def test_long_items(spark):
    """An item of thousands of words beside short ones; its copy, with every tenth word changed, is found."""
    body = [f"w{i * i % 7919}" for i in range(6000)]
    edited = " ".join("new" if i % 10 == 4 else w for i, w in enumerate(body))
    docs = spark.createDataFrame([(1, f"before {edited} after"), (2, " ".join(body[:2000])), (3, "w0 w1 w4 and more")], "doc_id long, text string")
    rows = decontam.contaminated(docs, spark.createDataFrame([(1, " ".join(body)), (2, "w0 w1 w4 and")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 2) for r in rows} == {(1, 1): 0.85, (3, 2): 1.0, (1, 2): 0.75, (2, 2): 0.75}


def test_odd_rows(spark):
    df, _ = odd_documents(spark)
    items = df.selectExpr("doc_id as item_id", "text")
    rows = decontam.contaminated(df, items.filter("item_id in (1, 4, 5, 7)")).collect()
    assert {r.doc_id for r in rows if r.item_id == 1} >= {1, 2, 3, 10}
    assert decontam.contaminated(df.limit(0), items).count() == 0 == decontam.contaminated(df, items.limit(0)).count()


def test_recall_on_edited_copies(spark):
    """Of copies with a share of their words changed, dropped or added that still score enough, nine in ten or more are found."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 12 + i % 30))) for i in range(60)]
    docs, want = [], set()
    for rate in (0.05, 0.1, 0.2, 0.3):
        for i, text in items:
            words = []
            for w in text.split():
                kind = rng.integers(3) if rng.random() < rate else -1
                words += {-1: [w], 0: [f"x{rng.integers(1000)}"], 1: [], 2: [w, f"x{rng.integers(1000)}"]}[int(kind)]
            docs.append((len(docs), " ".join([f"u{x}" for x in rng.integers(0, 9999, 20)] + words + ["v", "v"])))
            if smith_waterman(text.split(), docs[-1][1].split()) >= decontam.ACCEPT * 2 * len(text.split()):
                want.add((len(docs) - 1, i))
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 150 and len(found & want) >= 0.9 * len(want)
