from collections import Counter

from asofia.llm import rules
from asofia.llm.jaccard import jaccard_components
from helpers import DATA, odd_documents, words


def brute(text):
    text = text or ""
    w = words(text)

    def covered(n):
        times = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if times[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        return hit

    lines, seen, dup, chars = [x for x in text.split("\n") if words(x)], set(), 0, 0
    for line in lines:
        if line in seen:
            dup, chars = dup + 1, chars + sum(map(len, words(line)))
        seen.add(line)
    total, repeat = sum(map(len, w)), sum(covered(3))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    grams = {n: sum(len(x) for x, hit in zip(w, covered(n), strict=True) if hit) for n in rules.NGRAM_LIMITS}
    kept = not failed and chars <= rules.LINE_LIMIT * total and all(c <= rules.NGRAM_LIMITS[n] * total for n, c in grams.items())
    return len(w), total, sum(c in "#*$%&|<>" for c in text), dup, repeat, failed, kept, chars, *grams.values()


def check(df):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", *(f"chars_{n}gram" for n in rules.NGRAM_LIMITS)]
    got = sorted(tuple(r) for r in rules.quality_rules(df).select("doc_id", *columns).fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())
    assert got == want
    kept = rules.keep_passing(df)
    assert kept.columns == df.columns and kept.count() == sum(x[7] for x in want)


def test_brute_force(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_odd_rows(spark):
    df, _ = odd_documents(spark)
    check(df)
    check(df.limit(0))


def thue_morse(n):
    """A word over a and b of 2**n letters, and the one with both letters swapped: any polynomial hash modulo a power of two gives them one value."""
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_lines_and_words_that_polynomials_confuse(spark):
    for n in (10, 11, 12):
        x, y = thue_morse(n)
        docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, x), (3, y), (4, f"{x}\n{x}")], "doc_id long, text string")
        assert {r.doc_id: r.n_dup_lines for r in rules.quality_rules(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
        assert {r.doc_id: r.component_id for r in jaccard_components(docs.filter("doc_id < 4")).collect()} == {1: 1, 2: 2, 3: 3}
