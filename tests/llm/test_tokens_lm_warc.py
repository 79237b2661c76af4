import hashlib
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest

from asofia.llm import lm, queries, tokens, warc
from duck import same
from helpers import DATA, odd_documents, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- token counts ---


def brute_tokens(unigram, text):
    found = [unigram.walk("▁" + w) for w in words(text)]
    return len(found), sum(len(ids) for ids, _ in found), sum(s for _, s in found)


def check_tokens(df, rows, unigram):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_tokens, round(r.score, 6)) for r in tokens.token_counts(df, unigram).collect())
    want = sorted((-1 if i is None else i, n, t, round(s, 6)) for i, (n, t, s) in ((i, brute_tokens(unigram, x)) for i, x in rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9)


def brute_counts(unigram, texts):
    """One round of counting, word by word."""
    count = np.ones(len(unigram.pieces))
    for text in texts:
        for w in words(text):
            for i in unigram.walk("▁" + w)[0]:
                if i < len(count):
                    count[i] += 1
    return np.log(count / count.sum())


def test_tokens_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    unigram = tokens.train(df, MODEL, rounds=1)
    start = tokens.Unigram(unigram.pieces, tokens.rank_scores(len(unigram.pieces)))
    assert np.allclose(unigram.scores, brute_counts(start, [t for _, t in rows]))
    check_tokens(df, rows, unigram)


def test_counting_raises_the_likelihood(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    total = [tokens.token_counts(df, tokens.train(df, MODEL, rounds=n)).agg({"score": "sum"}).first()[0] for n in (0, 1, 2)]
    assert total[0] < total[1] < total[2]


def test_tokens_odd_rows(spark):
    df, rows = odd_documents(spark)
    unigram = tokens.train(df, MODEL)
    check_tokens(df, rows, unigram)
    assert tokens.token_counts(df.limit(0), unigram).count() == 0
    assert np.ptp(tokens.train(df.limit(0), MODEL).scores) == 0  # no text, no preference


def test_texts_without_spaces():
    """A megabyte of Chinese, Base64 and repeated letters as single words, counted as if walked one character at a time."""
    rng = random.Random(5)
    pieces = tokens.vocabulary(MODEL)
    unigram = tokens.Unigram(pieces, tokens.rank_scores(len(pieces)))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(350_000))
    coded = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000))
    texts = [chinese[:20_000], coded, "x" * 3000, "ab" * 2000 + chinese[:300] + "the" * 900, "🙂é" * 500]
    _, pool, found = unigram.encode(pa.array(texts))
    for i, text in enumerate(texts):
        ids, score = unigram.walk("▁" + text)
        assert found["size"][i] == len(ids) and np.isclose(found["score"][i], score)
    start = time.process_time()
    _, _, found = unigram.encode(pa.array([chinese]))
    assert found["size"][0] >= 350_000 and time.process_time() - start < 20


def test_trie_equals_every_segmentation(monkeypatch):
    rng = random.Random(1)
    pieces = list({"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(30)})
    unigram = tokens.Unigram(pieces, [-rng.random() * 5 for _ in pieces])

    def best(w):
        if not w:
            return 0.0
        options = [unigram.scores[unigram.number[w[:k]]] + best(w[k:]) for k in range(1, min(5, len(w) + 1)) if w[:k] in unigram.number]
        return max([*options, unigram.byte_score * len(w[0].encode()) + best(w[1:])])

    some = list({"".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(80)})
    for long_word in (64, 3):  # the second time nearly all words are cut
        monkeypatch.setattr(tokens, "LONG_WORD", long_word)
        row, pool, found = tokens.Unigram(pieces, unigram.scores).encode(pa.array(some))
        assert row.tolist() == list(range(len(some))) and np.allclose(found["score"], [best("▁" + w) for w in some])
        for i, w in enumerate(some):
            ids = pool[found["start"][i] : found["start"][i] + found["size"][i]].tolist()
            assert len(pieces) in ids or "".join(pieces[x] for x in ids) == "▁" + w


# --- LM scoring ---


def test_log_probs_match_a_plain_network():
    net = lm.Network.start()
    ids = np.random.default_rng(3).integers(0, lm.VOCABULARY, 12).astype(np.int32)
    around = np.full((4, 12), lm.PAD, dtype=np.int32)
    for k, d in enumerate(lm.OFFSETS):
        for i in range(12):
            if 0 <= i + d < 12:
                around[k, i] = ids[i + d]

    def softmax(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    for i in range(12):
        h = np.tanh(net.bias + sum(net.context[k][around[k, i]] for k in range(4)))
        kind, place = divmod(int(ids[i]), lm.PLACES)
        p = softmax(h @ net.class_out + net.class_bias)[kind] * softmax(h @ net.place_out[kind] + net.place_bias[kind])[place]
        assert np.isclose(lm.log_probs(net, ids, around)[i], np.log(p), atol=1e-4)


def test_gradient_matches_differences():
    rng = np.random.default_rng(5)
    net = lm.Network.start(rng.integers(0, 50, lm.VOCABULARY))
    ids, around = rng.integers(0, 400, 300).astype(np.int32), rng.integers(0, 40, (4, 300)).astype(np.int32)
    grad = lm.Trainer(net).gradient(ids, around)
    for name, at in (("context", (1, 7, 3)), ("context", (3, 39, 0)), ("bias", (2,)), ("class_out", (4, 1)), ("class_bias", (2,)), ("place_out", (1, 5, 20)), ("place_bias", (3, 9))):
        value, sums = getattr(net, name), []
        for d in (0.02, -0.02):
            value[at] += d
            sums.append(lm.log_probs(net, ids, around).sum())
            value[at] -= d
        assert np.isclose((sums[0] - sums[1]) / 0.04, grad[name][at], rtol=0.02, atol=0.02), name


def test_steps_raise_the_log_probability():
    rng = np.random.default_rng(5)
    ids, around = rng.integers(0, 40, 4000).astype(np.int32), rng.integers(0, 40, (4, 4000)).astype(np.int32)
    trainer = lm.Trainer(lm.Network.start())
    before = lm.log_probs(trainer.net, ids, around).mean()
    for _ in range(30):
        trainer.step(ids, around, lm.RATE)
    assert lm.log_probs(trainer.net, ids, around).mean() > before + 0.5


def test_beats_word_counts_on_held_out_texts_whatever_the_split(spark, monkeypatch):
    """Texts of four languages: the network must do better than the slots' frequencies, in order better than in disorder, and alike for any layout."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text <> ''")
    held, rest = df.filter("doc_id % 8 = 0"), df.filter("doc_id % 8 <> 0").cache()
    rows = held.toPandas()
    rows["text"] = [" ".join(random.Random(i).sample(w, len(w))) for i, w in enumerate(rows.text.str.split())]
    mixed, scored = spark.createDataFrame(rows), []
    for copy_words, layouts in ((lm.COPY_WORDS, (1, 16, 64)), (100_000, (16,))):
        monkeypatch.setattr(lm, "COPY_WORDS", copy_words)
        for n in layouts:
            net = lm.train(rest.repartition(n))
            score = lambda x, net=net: lm.pseudo_likelihood(x, net).filter("n_words > 0").toPandas().set_index("doc_id").sort_index()
            got, other = score(held), score(mixed)
            plain = lm.Network.start(net.words.slot_n)
            plain.context[:] = 0  # all that is left is the slots' frequencies
            plain.words = net.words
            base = score(held, plain)
            total = lambda x: x.log_likelihood.sum() / x.n_words.sum()
            assert total(got) > total(base) + 0.3 and total(got) > total(other) + 0.01, (copy_words, n)
            scored.append(got.mean_word_log_likelihood)
    ranks = [scored[0].rank().corr(x.rank()) for x in scored]
    assert min(ranks[1:3]) > 0.99 and ranks[3] > 0.9  # the last ones have copies of a tenth of the words


def test_counts_beyond_the_broadcast_give_equal_scores(spark, monkeypatch):
    df, _ = odd_documents(spark)
    df = df.select("doc_id", "text").union(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    nets = [lm.train(df)]
    monkeypatch.setattr(lm, "BROADCAST_WORDS", 10)
    nets.append(lm.train(df))
    assert nets[0].words.table is None and len(nets[0].words.word) > 10 and nets[1].words.table is not None
    clean = lambda rows: sorted(tuple(-1 if x is None else round(x, 6) for x in r) for r in rows)
    assert clean(lm.pseudo_likelihood(df, nets[0]).collect()) == clean(lm.pseudo_likelihood(df, nets[1]).collect())
    assert lm.pseudo_likelihood(df.limit(0), nets[1]).count() == 0


def test_words_of_one_slot_are_told_apart(spark):
    """More words than slots: the counted words of a slot share it by their counts, and an unknown word has a part of its own."""
    text = [" ".join(f"w{i}" for i in range(6000) for _ in range(1 + (i % 3 == 0))) for _ in range(2)] + ["often " * 50]
    net = lm.train(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"))
    assert len(net.words.own) == lm.OWN and len(net.words.word) == 6001 - lm.OWN
    ids, _, _, h = lm.word_ids(pa.array([" ".join(f"w{i}" for i in range(6000))]), net.words.own)
    assert (np.bincount(ids)[: lm.OWN] <= 1).all()
    ids, h = ids[ids >= lm.OWN], h[ids >= lm.OWN]
    total, n = np.bincount(ids, np.exp(net.words.log_share(h, ids)), lm.VOCABULARY), np.exp(net.words.log_total)
    assert np.allclose(total[ids], 1 - 1 / n[ids], atol=1e-5)
    assert np.allclose(np.exp(net.words.log_share(np.arange(5, dtype=np.uint64), ids[:5])), 1 / n[ids[:5]])


def test_one_slot_two_scores(spark):
    slot = {}
    for i in range(9000):
        slot.setdefault(int(lm.tk.words(*lm.tk.byte_column(pa.array([f"w{i}"])), lm.tk.LOWER)[0][0]) % (lm.VOCABULARY - lm.OWN), []).append(f"w{i}")
    often, rare, unknown = next(x for x in slot.values() if len(x) > 2)[:3]
    top = " ".join(f"top{i} " * 9 for i in range(lm.OWN))
    net = lm.train(spark.createDataFrame([(1, top), (2, f"{often} " * 7 + f"{rare} " * 2)], "doc_id long, text string"))
    scored = lm.pseudo_likelihood(spark.createDataFrame([(1, often), (2, rare), (3, unknown)], "doc_id long, text string"), net)
    found = {r.doc_id: r.word_log_likelihood for r in scored.collect()}
    assert np.isclose(found[1] - found[2], np.log(7 / 2)) and np.isclose(found[2] - found[3], np.log(2))


def test_real_order_beats_disorder_whatever_the_layout(spark):
    """Texts in which every word leaves four choices for the next of 300."""
    rng, rows = random.Random(3), []
    for i in range(8000):
        w = [rng.randrange(300)]
        while len(w) < 40:
            w.append((3 * w[-1] + rng.randrange(4)) % 300)
        rows.append((i, " ".join(f"w{x}" for x in w)))
    real = spark.createDataFrame(rows, "doc_id long, text string")
    mixed = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), 40))) for i, t in rows], "doc_id long, text string")
    mean = lambda x, net: lm.pseudo_likelihood(x, net).agg({"mean_log_likelihood": "avg"}).first()[0]
    nets = [lm.train(real.repartition(n)) for n in (1, 40)]
    found = [mean(real, net) for net in nets]
    assert all(x > mean(mixed, net) + 0.5 for x, net in zip(found, nets, strict=True))
    assert abs(found[0] - found[1]) < 0.2


def test_lm_odd_rows(spark):
    df, rows = odd_documents(spark)
    net = lm.train(df)
    got = {(r.doc_id, r.n_words) for r in lm.pseudo_likelihood(df, net).collect()}
    assert got == {(i, len(words(t))) for i, t in rows}
    assert lm.pseudo_likelihood(df.limit(0), lm.train(df.limit(0))).count() == 0


# --- WARC ---


def test_warc_matches_sql(spark):
    same(spark, queries.QUERIES["op1_warc"], queries.ORACLE_SQL["op1_warc"])


@pytest.fixture
def hostile():
    """Payloads that hold the magic line, record headers, or a whole record with payload."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "é" * 700
    rows = [(1, "http://a", "WARC/1.1\r\n"), (2, None, f"x{inner}y"), (3, "u\r\nX: y", inner), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", big), (8, "u", big), (8, "u", big), (None, "u", big), (9, "u", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n" * 50), (10, "ü", "end WARC/1.1\r\n"), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", inner * 200)]
    return rows + [(100 + i, "u", f"page {i} " * 300 + "WARC/1.1\r\n" * (i % 3)) for i in range(60)]


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_warc_boundaries(spark, hostile, tmp_path, split):
    """The records read are those written, with splits that cut records anywhere."""
    df = spark.createDataFrame([(*r, 1, b"x") for r in hostile], "page_id long, url string, html string, digest int, payload binary").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write_warc(df, str(tmp_path / "w"))
        files = list((tmp_path / "w").glob("part-*"))
        got = warc.read_warc(spark, str(tmp_path / "w")).toPandas()
        out = warc.round_trip(df).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(hostile)
    whole = {f.as_uri().replace("file:///", "file:/"): f.read_bytes() for f in files}
    for r in got.itertuples():
        data = next(b for k, b in whole.items() if r.file.replace("file:///", "file:/") == k)
        assert data[r.offset :].startswith(b"WARC/1.1\r\nWARC-Type: ")
    kept = got[got["head"].str.startswith("WARC-Type: response")]
    assert sorted(map(bytes, kept.payload)) == sorted((t or "").encode() for i, _, t in hostile if t != "é" * 700 or i == 8)
    want = []
    for i, _, t in hostile:
        t = (t or "").encode()
        again = t == ("é" * 700).encode() and i != 8
        want.append((i, len(t), hashlib.sha1(t).hexdigest(), "revisit" if again else "response", 8 if again else None))
    clean = lambda x: -1 if x is None or pd.isna(x) else int(x)
    key = lambda r: (clean(r[0]), r[1], r[2], r[3], clean(r[4]))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(key, out[columns].itertuples(index=False, name=None))) == sorted(map(key, want))


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
