"""Fuzzy quotes against every stretch compared letter by letter."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from asofia.operators import alignment, answers


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        row = out
    return row[-1]


def brute(quote, passage):
    """Every stretch of the passage; a longer quote's stretches with the whole passage."""
    if not quote or not passage:
        return 0.0, 0, 0
    best = []
    for a, b, turned in ((quote, passage, False), (passage, quote, True)):
        if len(a) <= len(b):
            for i in range(1 - len(a), len(b)):
                low, high = max(i, 0), min(i + len(a), len(b))
                score = 200 * _subsequence(a, b[low:high]) / (len(a) + high - low)
                best.append((-score, turned, *((0, len(passage)) if turned else (low, high))))
    score, _, start, stop = min(best)
    return (-score, start, stop) if score else (0.0, 0, 0)


def same(pairs):
    got = alignment.best_stretches([q for q, _ in pairs], [p for _, p in pairs])
    for (q, p), (score, start, stop) in zip(pairs, got, strict=True):
        expected = brute(q, p)
        assert score == pytest.approx(expected[0]), (q, p)
        assert not score or (start, stop) == expected[1:], (q, p)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=9), st.text("abc ", max_size=20)), min_size=1, max_size=8))
def test_short_texts(pairs):
    same(pairs)


@pytest.mark.parametrize("size", [63, 64, 65, 127, 128, 130, 200])
def test_quotes_around_whole_words_of_bits(size):
    rng = random.Random(size)
    text = "".join(rng.choice("abcdefgh \U0001f600é") for _ in range(size + 60))
    edited = lambda q, n: "".join(rng.choice("xyz") if rng.random() < n else c for c in q)
    same([(edited(text[k : k + size], n), text) for k, n in ((0, 0.1), (20, 0.5), (60, 0.05), (50, 0.9))] + [("a" * size, "a" * 90), ("ab" * 40, "ba" * size)])


def test_pairs_in_several_groups(monkeypatch):
    monkeypatch.setattr(alignment, "LETTERS", 100)
    monkeypatch.setattr(alignment, "CHUNK", 7)
    monkeypatch.setattr(alignment, "FIRST", 3)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    same([(word(rng.randrange(30)), word(rng.randrange(60))) for _ in range(120)] + [(None, "a"), ("a", None), ("", ""), ("b", "a")])


def test_quotes_below_the_threshold_have_a_span(spark):
    passage = "Banks shall report all frauds above one lakh rupees to the central office within three weeks of detection."
    quotes = ["report every fraud over one lakh rupees", "zzzzzzzzzzzzzzzz", "loans", "detection. And more words that follow", None, passage + " And a sentence that is not in it, longer than the passage was."]
    rows = spark.createDataFrame([(q, passage, "kept") for q in quotes] + [("some words of a quote", None, "kept"), ("some words of a quote", "", "kept")], "quote string, text string, low string")
    got = answers.locate(rows).collect()
    assert len(got) == len(quotes) + 2
    for r in got:
        q = (r.quote or "").replace("  ", " ")
        expected = brute(q, r.text) if len(q) >= answers.MIN_QUOTE else (0.0, 0, 0)
        assert r.score == pytest.approx(expected[0]) and (r.start, r.stop) == (expected[1:] if expected[0] else (None, None)), r
    assert 0 < min(r.score for r in got if r.quote == quotes[0]) < answers.VERIFIED
