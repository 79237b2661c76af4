from collections import defaultdict

import numpy as np
import xxhash

from asofia.llm import simhash
from asofia.llm import textkernel as tk
from asofia.llm.queries import QUERIES
from asofia.llm.scratch import Scratch
from helpers import DATA, LOWER, odd_documents, words


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """Value to the smallest one reachable, by comparing all pairs."""
    values, low = sorted(set(values)), {}
    for v in values:
        seen, todo = {v}, [v]
        if v in low:
            continue
        while todo:
            x = todo.pop()
            near = [y for y in values if y not in seen and (x ^ y).bit_count() <= 2]
            seen.update(near)
            todo += near
        low |= dict.fromkeys(seen, v)
    return low


def brute(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    low, ids = classes(f for _, f in prints), defaultdict(list)
    for i, f in prints:
        if i is not None:
            ids[low[f]].append(i)
    return sorted((str(i), f"{f:016x}", min(ids[low[f]], default=None)) for i, f in prints)


def got(frame):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in frame.select("doc_id", "fingerprint", "component_id").collect())


def test_whole_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_simhash_near_dedup"](spark, DATA)) == brute(rows)


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    assert got(simhash.simhash_components(docs)) == brute(rows)
    assert got(simhash.simhash_components(docs.limit(0))) == []
    zero = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert zero[4].fingerprint == zero[5].fingerprint == "0" * 16 and zero[6].component_id == 4


def test_links_of_any_two_bits_and_no_others(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    close = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (120, 2))]
    far = [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    chain = [0]
    for i in range(0, 40, 2):
        chain.append(chain[-1] ^ (3 << i))
    every = sorted({*close, *far, *chain, *map(int, base), (1 << 64) - 1, (1 << 64) - 2, 1 << 63})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in every]
    want = classes(every)
    for full in (1, 4, simhash.FULL):
        monkeypatch.setattr(simhash, "FULL", full)
        scratch = Scratch(spark, "test")
        edges = simhash.near_fingerprints(spark.createDataFrame(signed, "fp long"), scratch).collect()
        near = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges]
        assert all((a ^ b).bit_count() <= 2 for a, b in near)
        parent = {v: v for v in every}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in near:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        assert {v: root(v) for v in every} == want


def test_hash_is_xxh64(spark):
    data = bytes(range(256)) * 20
    starts = np.arange(0, 3000, 7)
    ends = starts + np.arange(len(starts)) * 5 % 1500
    want = [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends, strict=True)]
    assert tk.xxh64(np.frombuffer(data, np.uint8), starts, ends, 42).tolist() == want


def test_long_words_and_texts():
    texts = ["w" * 3000 + " x " + "y" * 50_000 + " z z z", " ".join(f"w{i % 5000}" for i in range(70_000)), "a\tb\n\nc  D", "é ü ñ"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert simhash.fingerprints_of(data, offs).tolist() == [fingerprint(t) for t in texts]
