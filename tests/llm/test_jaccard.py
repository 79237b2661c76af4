import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from asofia.llm import jaccard
from asofia.llm import textkernel as tk
from helpers import DATA, LOWER, WORDS, odd_documents, words


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Id to (set size, component) by comparing every pair of texts that share a shingle."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for n, (i, s) in enumerate(rows):
        for j, both in Counter(j for g in s for j in seen[g]).items():
            other_id, other = rows[j]
            if 100 * both >= 75 * (len(s) + len(other) - both):
                a, b = sorted((root(i), root(other_id)))
                parent[b] = a
        for g in s:
            seen[g].append(n)
    return {(i, len(s), root(i)) for i, s in rows}


def found(df, **more):
    return [tuple(r) for r in jaccard.jaccard_components(df, **more).select("doc_id", "n_shingles", "component_id").collect()]


@pytest.mark.parametrize("hot", [1, 48])
def test_brute_force_on_the_table(spark, hot):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert set(found(df, hot=hot)) == brute(df.select("doc_id", "text").collect())


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("hot", [2, 8])
def test_groups_of_near_copies_and_a_common_passage(spark, hot):
    """Copies with more and more edits, chains of copies, and a passage that many unlike texts share: the exact path for frequent signatures."""
    rng = random.Random(3)
    base, passage = [f"{w}{i}" for i, w in enumerate(WORDS * 5)], " ".join(f"p{i}" for i in range(50))
    texts = [edited(rng, base, k % 12) for k in range(60)]
    texts += [passage + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 40))) for _ in range(60)]
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + [f"more{i}{k}" for k in range(3)]
    rows = list(enumerate(texts))
    assert set(found(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)) == brute(rows)


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    got = found(df)
    assert len(got) == sum(i is not None for i, _ in rows) and set(got) == brute(rows)
    assert found(df.limit(0)) == []


def test_schemes_cover_every_linkable_pair():
    """Two sets that may be linked have a scheme in common, and the difference can't touch two second-level partitions in each of its first-level ones."""
    sizes = np.arange(1, 700)
    parts = jaccard.schemes(sizes, 75, 100)
    table = {(slot, i): (s[i], p[i], k[i]) for slot, (s, p, k) in enumerate(parts) for i in range(len(sizes)) if p[i]}
    for i, a in enumerate(sizes):
        for j in range(i, len(sizes)):
            b = sizes[j]
            if a * 100 < 75 * b:
                break
            largest = (a + b) * 25 // 175
            shared = [(table[x, i], table[y, j]) for x in (0, 1) for y in (0, 1) if (x, i) in table and (y, j) in table and table[x, i][0] == table[y, j][0]]
            assert any(u[1] == v[1] and 2 * u[1] > largest and u[2] >= largest and v[2] >= largest for u, v in shared), (a, b)


def test_shared_signatures_are_as_many_as_stated():
    """Random sets and edits of them: never fewer signatures in common than ``shared_at_least`` says."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, k, parts = int(rng.integers(1, 60)), int(rng.integers(0, 12)), int(rng.integers(2, 9))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = min(int(rng.integers(0, k + 1)), len(a))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, k - gone).astype(np.uint64)]))
        side = lambda x: jaccard.signatures(x, np.array([0, len(x)]), np.array([4]), np.array([parts]))  # noqa: E731, B023
        (u, _, *fill), (v, _, *other) = side(a), side(b)
        both = len(np.intersect1d(u, v))
        for single, several in (fill, other):
            assert both >= jaccard.shared_at_least(single, several, np.array([k]))[0]


def test_sketches_never_overstate():
    rng = np.random.default_rng(5)
    for n in (10, 1500, 12_000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 20).astype(np.uint64)])
        level = int(jaccard.sketch_level(np.array([n]))[0])
        bits = np.bitwise_count((jaccard.sketch(a, level) ^ jaccard.sketch(b, level)).view(np.uint64)).sum()
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_kernel_words():
    import pyarrow as pa

    texts = ["Ab  cd\tef", None, "", "é\x0bü", "ab CD"]
    h, row, start, end = tk.words(*tk.byte_column(pa.array(texts)), tk.LOWER)
    assert row.tolist() == [0, 0, 0, 3, 3, 4, 4] and h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
