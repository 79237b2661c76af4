import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from asofia.llm import packing
from helpers import DATA, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.packed_sequences(df, PATH).toPandas()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want += [(-1 if r.doc_id is None else r.doc_id, a, len(p := ids[a : a + 4096]), zlib.crc32(np.array(p, dtype="<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got[columns].fillna(-1).astype(int).values.tolist())) == sorted(want)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 4096
    return got


def test_round_trip_and_fill(spark):
    got = check(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.95


def test_odd_rows(spark):
    df, _ = odd_documents(spark)
    check(df)
    assert packing.packed_sequences(df.limit(0), PATH).count() == 0


def test_ids_of_odd_strings():
    """Capitals of special tokens, endings behind apostrophes, accents composed or not, signs, control characters and other white space."""
    rng, tokenizer, encoder = random.Random(11), Tokenizer.from_file(PATH), packing.Encoder(PATH)
    parts = [*"abcdefgXYZstmdrevl01239\"!.,<<||>_- \t\n\r\x0b\x0c\x00\x01\x1c\x1f\x7f'''éÉ×÷ÿÀñüßİΣσ中文😀ﬁⅧ٣", "é", "ñ", " ", " ", "\u0085", "　", "'s", "'re", "'LL", "'M", "</w>"]
    parts += ["<|startoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|endoftext|>"]
    texts = ["<|STARTOFTEXT|> hi", "<|EndOfText|>x", "", None, "'", "''s", "it's", "a'll'd'", *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000))]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
    for _ in range(2):  # the second time from memory
        ids, offs = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_memory_of_words_may_overflow(monkeypatch):
    monkeypatch.setattr(packing, "POOL_IDS", 5000)
    monkeypatch.setattr(packing, "TABLE_BITS", 8)
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for low in range(0, 3000, 300):
        texts = [f"w{i} odd{i * i}é {i % 7}" for i in range(low, low + 400)]
        ids, offs = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_plan_places_every_piece():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 257, rng.integers(1, 60)))
        counts = rng.integers(1, 500, len(sizes))
        plan = packing.plan(sizes, counts, 256)
        assert (sum(p * n for p, n in plan) == counts).all() and all((p * sizes).sum() <= 256 for p, _ in plan)
        assert sum(n for _, n in plan) <= 1.02 * (sizes * counts).sum() / 256 + 0.34 * counts[sizes > 128].sum() + len(sizes) + 2


def test_knapsack_matches_brute_force():
    sizes, values = np.array([3, 4, 5]), np.array([0.31, 0.42, 0.5])
    best = max((a * values).sum() for a in np.ndindex(6, 5, 4) if (np.array(a) * sizes).sum() <= 17)
    value, pattern = packing._best_pattern(sizes, values, 17)
    assert abs(value - best) < 1e-9 and abs((pattern * values).sum() - best) < 1e-9 and (pattern * sizes).sum() <= 17


def test_words_that_polynomials_confuse():
    """A memory of words must not take one for another: these two share any polynomial hash modulo a power of two."""
    encoder, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    x, y = "a", "b"
    for n in range(12):
        x, y = x + y, y + x
        if n >= 8:
            for word in (x, y):
                ids, _ = encoder.encode(pa.array([word]))
                assert ids.tolist() == [*plain.encode(word, add_special_tokens=False).ids, packing.END_ID], n
