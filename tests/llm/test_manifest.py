import hashlib
from collections import defaultdict

from asofia.llm import manifest as m
from asofia.llm.queries import ORACLE_SQL, QUERIES
from duck import same
from helpers import odd_documents
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of digests, and for each of them what stands left and right of it on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            low = p - p % 3
            paths[i].append(("".join(nodes[low:p]), "".join(nodes[p + 1 : low + 3])))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text, altered text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0], leaf(*r[:5]), leaf(*r[:4], r[5])))
    order, out = sorted(trees, key=lambda s: (s is not None, (s or "").encode())), []
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {s: climb([x[1] for x in t]) for s, t in trees.items()}
    root, high = climb([low[s][0] for s in order])
    for s, above in zip(order, high, strict=True):
        for (i, h, other), path in zip(trees[s], low[s][1], strict=True):
            folded = other
            for a, b in path + above:
                folded = sha(a + folded + b)
            out.append((str(i), h, low[s][0], root, sha("".join(a + b for a, b in path + above)), folded, folded == root))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect())


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def test_matches_sql(spark):
    same(spark, QUERIES["op13_merkle_manifest"], ORACLE_SQL["op13_merkle_manifest"])


def test_trees_of_many_sizes(spark, monkeypatch):
    rows = [(100 * s + i, f"é{s}" if s else None, None if i % 5 == 0 else "en", i, f"a\nb{i}") for s in range(0, 13) for i in range(s * s or 4)]
    table = spark.createDataFrame(rows, KIND)
    want = brute([(*r, r[4].replace("\n", "") if r[0] % 2 else r[4]) for r in rows])
    altered = {"text": F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    assert got(m.manifest(table, altered)) == want
    monkeypatch.setattr(m, "LEVELS", 2)
    monkeypatch.setattr(m, "SPAN", 9)  # several layers of blocks
    monkeypatch.setattr(m, "BROADCAST_PLACES", 0)
    assert got(m.manifest(table.repartition(7), altered)) == want


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 1, "s")).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("h", F.lit(1)).withColumn("rank", F.lit("x"))
    table = [(r.doc_id, r.source, r.lang, r.n_chars, r.text, r.text) for r in docs.collect()]
    assert got(m.manifest(docs)) == brute(table)
    assert got(m.manifest(docs.limit(0))) == []
    one = spark.createDataFrame([(1, None, None, None, None)], KIND)
    only = m.manifest(one).collect()[0]
    assert only.leaf == only.subroot == only.root == only.folded_root == leaf(1, None, None, None, None) and only.proof_sha256 == sha("") and only.verified


def test_a_single_hot_source_is_cut_in_blocks(spark):
    rows = [(i, "hot", "en", 1, "x") for i in range(2500)] + [(7, "hot", "en", 1, "x")] * 900
    assert got(m.manifest(spark.createDataFrame(rows, KIND).repartition(6))) == brute([(*r, r[4]) for r in rows])
