"""Snippets against every stretch of words, on made-up texts."""

import random

from asofia.operators import keyword

WIDTH = 30


def fragment(hits, low, high):
    """Best stretch with hits at both ends between two words, filled up; hits are (word, stem)."""
    best = None
    for a in sorted({i for i, _ in hits if low <= i < high}):
        for b in sorted({i for i, _ in hits if a <= i < min(a + WIDTH, high)}):
            held = [(i, s) for i, s in hits if a <= i <= b]
            key = (-len({s for _, s in held}), -len({i for i, _ in held}), b - a, a)
            best = min(best or (key, b), (key, b))
    if best:
        (_, _, words, a), _ = best
        start = max(low, min(a - (WIDTH - 1 - words) // 2, high - WIDTH))
        return best[0], start, min(start + WIDTH, high)


def brute(words, stems):
    hits = [(i, stems[w]) for i, w in enumerate(words) if w in stems]
    first = fragment(hits, 0, len(words))
    if not first:
        return ""
    second = [f for f in (fragment(hits, 0, first[1]), fragment(hits, first[2], len(words))) if f]
    shown = sorted([first[1:], *(f[1:] for f in sorted(second)[:1])])
    return " … ".join(" ".join(f"«{w}»" if w in stems else w for w in words[a:b]) for a, b in shown)


def test_fragments_are_the_best_of_all(spark):
    rng = random.Random(3)
    stems = {"bank": "bank", "banks": "bank", "limit": "limit", "loan": "loan"}
    texts = []
    for k in range(120):
        share = rng.choice([0, 0.01, 0.05, 0.3, 1])
        texts.append([rng.choice(list(stems)) if rng.random() < share else rng.choice("xyz") for _ in range(rng.choice([1, 5, 29, 30, 31, 45, 60, 61, 90, 200]))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None)], "doc_id long, text string")
    top = docs.selectExpr("1L as qid", "doc_id", "1 as rank")
    terms = spark.createDataFrame([(1, s, t) for t, s in stems.items()], "qid long, stem string, term string")
    got = {r.doc_id: r.snippet for r in keyword.snippets(top, docs, terms).collect()}
    assert got == {i: brute(t, stems) for i, t in enumerate(texts)} | {900: "", 901: ""}


def test_two_fragments_in_the_order_of_the_text(spark):
    words = ["w"] * 100
    words[10], words[80], words[84] = "Loan,", "limits", "loan"
    docs = spark.createDataFrame([(1, " \n".join(words))], "doc_id long, text string")
    terms = spark.createDataFrame([(7, "loan", "loan"), (7, "limit", "limits")], "qid long, stem string, term string")
    (row,) = keyword.snippets(docs.selectExpr("7L as qid", "doc_id", "1 as rank"), docs, terms).collect()
    first, second = row.snippet.split(" … ")
    assert "«Loan,»" in first and second.split().index("«loan»") - second.split().index("«limits»") == 4
    assert len(first.split()) == len(second.split()) == 30
