"""Small cases with results known by hand."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asofia.functions import temporal, text
from asofia.functions.stemmer import stem
from asofia.operators import alerts, answers, cache, chunking, evaluation, extract, graph, ingest, keyword, questions, relations, vectors
from asofia.sources.folders import golden_questions

DAY = dt.date


def test_window_is_half_open(spark):
    rows = spark.createDataFrame([("old", DAY(2015, 1, 1), DAY(2021, 6, 1)), ("new", DAY(2021, 6, 1), None), ("none", None, None)], "id string, a date, b date")
    at = lambda d: {r.id for r in rows.filter(temporal.in_force(F.col("a"), F.col("b"), F.lit(d))).collect()}
    assert at(DAY(2018, 3, 1)) == {"old"} and at(DAY(2021, 6, 1)) == {"new"}
    flag = {r.id: r.f for r in rows.select("id", temporal.in_force_flag(F.col("a"), F.col("b"), F.lit(DAY(2018, 3, 1))).alias("f")).collect()}
    assert flag == {"old": True, "new": False, "none": True}


def test_withdrawn_without_a_date_counts_from_today(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "id int, w boolean").withColumn("a", F.lit(DAY(2020, 1, 1))).withColumn("b", F.lit(None).cast("date"))
    today = F.lit(DAY(2026, 10, 4))
    at = lambda d: {r.id for r in rows.filter(temporal.searchable(F.col("a"), F.col("b"), F.col("w"), F.lit(d), today)).collect()}
    assert at(DAY(2026, 10, 4)) == {2} and at(DAY(2026, 9, 4)) == {1, 2}


@pytest.fixture
def postings(spark):
    docs = spark.createDataFrame([(1, "zorblax rules", "some text about loans"), (2, "loans", "zorblax again and zorblax loans"), (3, "other", "nothing"), (4, None, None)], "doc_id long, title string, text string")
    return keyword.postings(docs)


def test_title_outranks_body_and_all_terms_narrow(spark, postings):
    terms = spark.createDataFrame([(1, "zorblax")], "qid long, term string")
    found = {r.id: r.score for r in keyword.scores(terms, postings).collect()}
    assert set(found) == {1, 2}
    queries = spark.createDataFrame([(1, 'zorblax loans'), (2, '"zorblax loans"'), (3, "zorblax -rules"), (4, "? !"), (5, "nothing or rule"), (6, "the")], "qid long, query string")
    hits = {(r.qid, r.id) for r in keyword.match_all(keyword.parse_web_query(queries), postings).collect()}
    assert hits == {(1, 1), (1, 2), (2, 2), (3, 2), (5, 1), (5, 3)}


def test_stems(spark):
    words = spark.createDataFrame([("loans",), ("loan",), ("lending",), ("policies",), ("class",)], "term string")
    assert [r.s for r in words.select(stem("term").alias("s")).collect()] == ["loan", "loan", "lend", "polici", "class"]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, i, "keyword", r) for r, i in enumerate([1, 2, 3], 1)] + [(1, i, "vector", r) for r, i in enumerate([3, 4], 1)], "qid long, id long, list string, rank long")
    fused = vectors.fuse(lists, weights={"keyword": 1.0, "vector": 1.0}).orderBy("rank").collect()
    assert fused[0].id == 3 and abs(next(r.score for r in fused if r.id == 1) - 1 / 61) < 1e-9


def test_amendments_by_date(spark):
    docs = spark.createDataFrame([(1, DAY(2023, 1, 1)), (2, DAY(2024, 6, 1)), (3, DAY(2026, 3, 1))], "doc_id long, issued_date date").select("*", F.col("issued_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(False).alias("is_withdrawn"))
    edges = spark.createDataFrame([(2, 1, "amends", "link"), (3, 1, "amends", "link"), (2, 1, "amends", "regex")], "src long, dst long, type string, method string")
    for day, want in ((DAY(2023, 6, 1), []), (DAY(2025, 1, 1), [2]), (DAY(2026, 6, 1), [3, 2])):
        given_ = spark.createDataFrame([(1, 1, day)], "qid long, doc_id long, as_of date")
        got = graph.amendments_in_force(given_, edges, docs, "2026-10-04").orderBy(F.desc("issued_date")).collect()
        assert [r.doc_id for r in got] == want


# Question phrases and the day they mean on 2026-10-04.
PHRASES = [
    ("What was the limit on 1 June 2024?", DAY(2024, 6, 1)), ("as of 1st June, 2024", DAY(2024, 6, 1)), ("as on June 1, 2024", DAY(2024, 6, 1)), ("as at 2024-06-01", DAY(2024, 6, 1)), ("on 01.06.2024", DAY(2024, 6, 1)),
    ("in March 2024", DAY(2024, 3, 31)), ("during 2023", DAY(2023, 12, 31)), ("before April 2024", DAY(2024, 3, 31)), ("in 2026", DAY(2026, 10, 4)), ("in Sept. 2025", DAY(2025, 9, 30)), ("in 2031", None), ("in 2023-24", None), ("June 2024", None), ("on 30 February 2024", None), (None, None),
]


def test_days_in_questions(spark):
    rows = spark.createDataFrame([(q, d) for q, d in PHRASES], "question string, day date")
    got = rows.select("question", "day", questions.parse_as_of(F.col("question"), F.lit(DAY(2026, 10, 4)))["day"].alias("got")).collect()
    assert [(r.question, r.got) for r in got] == [(q, d) for q, d in PHRASES]


def test_relation_wording(spark):
    ref = "DOR.SRC.REC.12/14.01.001/2023-24"
    docs = spark.createDataFrame(
        [
            ("a", ref, "Old circular (Commercial Banks – Credit Risk)", "x"), ("b", "n/a", "New", f"In supersession of circular No. {ref}, banks shall\n\nplain"), ("c", None, "Repeal", f"The circular {ref} stands withdrawn"),
            ("d", "", "Means", f"as communicated vide {ref} it is amended"), ("e", "", "Note", f"3 Amended vide circular {ref} dated"), ("f", "", "Mention", f"See {ref.replace('.', '. ')} too"), ("g", "", "Other (Something else here) Amendment", f"see {ref}"),
        ],
        "source_id string, circular_no string, title string, raw_text string",
    )
    got = {(r.src, r.dst): (r.type, r.confidence) for r in relations.text_relations(docs).collect()}
    assert got == {("b", "a"): ("supersedes", 0.9), ("c", "a"): ("repeals", 0.9), ("d", "a"): ("refers", 0.5), ("a", "e"): ("amends", 0.9), ("f", "a"): ("refers", 0.5), ("g", "a"): ("refers", 0.5)}


def test_edge_merge_is_idempotent(spark):
    edges = spark.createDataFrame([("1", "2", "amends", "regex", 0.7, ""), ("1", "2", "amends", "link", 0.9, ""), ("1", "2", "refers", "link", 0.5, ""), ("1", "3", "refers", "link", 0.5, "")], "src string, dst string, type string, method string, confidence double, evidence string")
    once = relations.merge(edges)
    want = {("2", "amends", 0.9), ("3", "refers", 0.5)}
    assert {(r.dst, r.type, r.confidence) for r in once.collect()} == want == {(r.dst, r.type, r.confidence) for r in relations.merge(once).collect()}


BODY = st.lists(st.sampled_from(["Chapter I", "1. Scope", "word " * 30, "word " * 120, "A sentence. " * 150, "", "x", "Annex II – y"]), max_size=12)


@settings(max_examples=60, deadline=None)
@given(BODY)
def test_passages_slice_back(parts):
    body = "\n\n".join(p.strip() for p in parts)
    rows, at, chapter, section = [], 0, None, None
    for b in body.split("\n\n"):
        kind = "chapter" if b.startswith(("Chapter", "Annex")) else "section" if b.startswith("1.") else None
        chapter, section = (b, None) if kind == "chapter" else (chapter, b if kind == "section" else section)
        rows.append((b, at, at + len(b), kind, len(b.split()), " > ".join(x for x in (chapter, section) if x) or None))
        at += len(b) + 2
    spans = list(chunking.pack(rows))
    assert " ".join(body[a:b] for a, b, _ in spans).split() == body.split()
    assert all(len(body[a:b].split()) <= 275 for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_passages(spark):
    long = "A sentence of six words here. " * 80
    docs = spark.createDataFrame([(1, f"Chapter I\n\n1. Scope\n\n{'w ' * 50}\n\n{long}\n\ntiny"), (2, ""), (3, None)], "doc_id long, raw_text string")
    rows = chunking.passages(docs).orderBy("doc_id", "ord").collect()
    body = docs.first().raw_text
    assert {r.doc_id for r in rows} == {1} and all(body[r.char_start : r.char_end] == r.text for r in rows)
    assert rows[0].heading == "Chapter I > 1. Scope" and rows[-1].text.endswith("tiny")


def test_passages_row_by_row(spark):
    """Room, a section with too few words, a long block, its short rest, and a last passage that is too short."""
    body = "Chapter I\n\na b c d e\n\nf g h i j k\n\n1. Scope\n\nl m n o p q r s t u v w. x y z.\n\ntail"
    docs = spark.createDataFrame([(1, body), (2, "a b c d e f\n\n \n\nAnnex\n\ng h"), (3, "a b c d e f g h i\n\nAnnex\n\ng h"), (4, "one\n\nPart 2"), (5, "\n\n \n\n")], "doc_id long, raw_text string")
    got = [(r.doc_id, r.ord, r.text, r.heading) for r in chunking.passages(docs, most=10, least=4).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 0, "Chapter I\n\na b c d e", "Chapter I"), (1, 1, "f g h i j k", "Chapter I"), (1, 2, "1. Scope\n\nl m n o p q r s t u v w.", "Chapter I > 1. Scope"),
        (1, 3, "x y z.\n\ntail", "Chapter I > 1. Scope"), (2, 0, "a b c d e f\n\n \n\nAnnex\n\ng h", None), (3, 0, "a b c d e f g h i\n\nAnnex\n\ng h", None), (4, 0, "one\n\nPart 2", "Part 2"),
    ]


def test_ingest_outcomes(spark):
    fields = "source_id string, raw_text string, title string, status string, seq long, issued_date date"
    more = lambda df: ingest.validity(df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("listed_date", "date"), ("effective_from", "date"), ("withdrawn_on", "date"), ("version_of", "date"), ("updated_on", "date")))))
    d = DAY(2024, 1, 1)
    stored = more(spark.createDataFrame([("1", "a", "t", "ok", 0, d), ("2", "b", "t", "ok", 0, d), ("3", "c", "t", "ok", 0, d)], fields))
    incoming = more(spark.createDataFrame([("1", "a", "t", "ok", 1, d), ("2", "b2", "t", "ok", 2, d), ("3", "c", "new title", "ok", 3, d), ("4", "a", "t", "ok", 4, d), ("5", "e", "t", "ok", 5, None), ("6", None, None, "missing", 6, d), ("7", "g", "t", "ok", 7, d), ("8", "g", "t", "ok", 8, d)], fields))
    judged = ingest.outcomes(incoming, stored)
    want = {"1": "unchanged", "2": "updated", "3": "updated", "4": "duplicate", "5": "failed", "6": "missing", "7": "new", "8": "duplicate"}
    assert {r.source_id: r.outcome for r in judged.collect()} == want
    after = ingest.merged(stored.drop("seq"), judged)
    again = ingest.outcomes(incoming.filter("status = 'ok'"), after.withColumn("seq", F.lit(0)))
    assert {r.source_id: r.outcome for r in again.filter("source_id in ('1', '2', '3', '7')").collect()} == dict.fromkeys(("1", "2", "3", "7"), "unchanged")


def test_months_and_ids(spark):
    assert [(r.year, r.month) for r in ingest.month_range(spark, "2023-11-20", "2024-02-01").collect()] == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    assert [r.id for r in ingest.id_range(spark, 3, 5).collect()] == [5, 4, 3]
    assert {(r.year, r.month) for r in ingest.recent_months(spark, "2024-01-15").collect()} == {(2024, 1), (2023, 12)}


def test_html_blocks():
    html = "<div><h1>Title</h1><p>One<br>two <b>three</b><sup><a href='#f1'>1</a></sup><sup>2</sup></p><script>no</script><!-- no --><table><tr><td>a</td><td>b&nbsp;c</td></tr></table>tail</div>"
    assert extract.html_blocks(html) == ["Title", "One\ntwo three2", "a | b c", "tail"]
    assert extract.html_blocks(None) == []


def test_quotes(spark):
    passage = "The limit for small loans is five lakh rupees under the scheme."
    rows = spark.createDataFrame([("for small loans is five", passage), ("for small loans  is “five", passage), ("an invented quote of some length", passage), ("loans", passage), ("x" * 20, None)], "quote string, text string")
    got = {r.quote: r for r in answers.locate(rows).collect()}
    assert got["for small loans is five"].score == 100 and passage[got["for small loans is five"].start :].startswith("for small")
    assert got["for small loans  is “five"].score >= 90 and got["an invented quote of some length"].score < 90 and got["loans"].score == 0 and got["x" * 20].score == 0


def test_cache(spark):
    q = spark.createDataFrame([(1, "What is  the LIMIT ?"), (2, "what is the limit")], "qid long, question string")
    keys = {r.k for r in q.select(cache.key(F.col("question"), F.lit(DAY(2024, 1, 1)), F.lit("5:x")).alias("k")).collect()}
    assert len(keys) == 1
    docs = spark.createDataFrame([], "doc_id long, created_at timestamp")
    assert cache.corpus_version(docs).first().version == "-"


def test_follows(spark):
    docs = spark.createDataFrame([("13156",)], "source_id string")
    requests = spark.createDataFrame([(1, " 13156 "), (1, "99999"), (1, "Digital  Lending"), (1, "digital lending"), (2, "ab"), (2, None)], "chat_id long, arg string")
    stored = spark.createDataFrame([], "chat_id long, kind string, target string")
    fresh, rejected = alerts.follow(requests, stored, docs)
    assert {(r.kind, r.target) for r in fresh.collect()} == {("doc", "13156"), ("topic", "digital lending")}
    assert sorted(r.reason for r in rejected.collect()) == ["too short", "too short", "unknown document"]


def test_answer_scores(spark):
    rows = spark.createDataFrame([(1, True, 2, 1, [7, 8], [7], [7]), (2, False, 0, 0, [], [7], [])], "qid long, answered boolean, kept long, dropped long, cited array<long>, relevant array<long>, in_force array<long>")
    scores = evaluation.answer_scores(rows)
    one = scores.filter("qid = 1").first()
    assert (one.answered, round(one.grounded, 6), one.cites_relevant, one.cites_in_force) == (1, 0.666667, 1, 0.5)
    assert evaluation.answer_summary(scores).first().answered == 0.5


def test_golden_questions(spark, tmp_path):
    file = tmp_path / "golden.jsonl"
    file.write_text('{"id": 1, "question": "q", "relevant": ["5"], "as_of": "2024-01-01", "tags": ["a"]}\n\n{"id": "2", "question": "q", "relevant": []}\n{"id": "3", "question": "q", "relevant": ["1"], "as_of": "2024-02-30"}\n{"id": "4", "relevant": ["1"]}\n')
    good, bad = evaluation.checked_golden(golden_questions(spark, str(file)))
    assert [r.id for r in good.collect()] == ["1"] and {r.id: r.reason for r in bad.collect()} == {"2": "no relevant ids", "3": "bad date", "4": "missing field"}


def test_clustered_search_finds_most_neighbours(spark):
    """Vectors without clusters take many lists; with clusters a tenth of the vectors is enough."""
    from asofia.plans.search import ann_figures

    assert ann_figures(spark, "/root/testdata/sf0.001").agg(F.avg("recall")).first()[0] >= 0.9
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 2000)] + 0.2 * rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    true = vectors.exact_nearest(asked, table, 10).select("qid", "vec_id")
    near = vectors.clustered_nearest(asked, table, 10, lists=80, probes=8)
    assert true.join(near, ["qid", "vec_id"], "left_semi").count() >= 0.9 * true.count() and near.agg(F.avg("compared")).first()[0] < 0.2 * 2000


def test_nearest_with_ties_and_gaps(spark):
    """Equal vectors are told apart by id; null ids and vectors are left out; blocks may be smaller than the result."""
    rows = [(i, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(10)] + [(None, [1.0, 0.0]), (11, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.filter("vec_id in (0, 9)").withColumnRenamed("vec_id", "qid")
    got = {(r.qid, r.vec_id): (r.cosine, r.rank) for r in vectors.exact_nearest(asked, table, 3).collect()}
    assert got == {(0, 1): (1.0, 1), (0, 2): (1.0, 2), (0, 3): (1.0, 3), (9, 6): (1.0, 1), (9, 7): (1.0, 2), (9, 8): (1.0, 3)}


def test_quotes_contained(spark):
    docs = spark.createDataFrame([(1, "xalpha beta gammay and more"), (2, "alpha beta"), (3, "no ab-cd here"), (4, None), (5, "one two, three four")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma"), (2, "ha bet"), (3, "ab-cd"), (4, ""), (5, None), (6, "two, three four"), (7, "alpha gamma beta")], "item_id long, quote string")
    got = {(r.doc_id, r.item_id, r.start) for r in answers.containing(docs, quotes, "doc_id").collect()}
    assert got == {(1, 1, 1), (1, 2, 4), (2, 2, 3), (5, 6, 4)}  # no three letters in a row in the third


def test_details_keep_every_row(spark):
    rows = extract.details(spark.createDataFrame([(1, "<p>" + "word " * 60 + "</p>", "t"), (1, "<p>short</p>", "u"), (2, None, None), (None, "<p>x</p>", "v")], "page_id long, html string, title string"))
    assert sorted((r.id or 0, r.status, r.error) for r in rows.collect()) == [(0, "missing", None), (1, "missing", None), (1, "ok", None), (2, "missing", None)]


def test_long_blocks_are_cut_at_sentences():
    """Against a count of words, sentence by sentence."""
    block = "".join(f"{'w ' * (i * 7 % 30)}end{i}{'.;'[i % 2]} " for i in range(60)) + "tail without a stop"
    parts = chunking._cut(block, 100, 50)
    assert " ".join(block[a - 100 : b - 100] for a, b in parts).split() == block.split()
    for a, b in parts[:-1]:
        words = block[a - 100 : b - 100].split()
        assert len(words) >= 50 and words[-1][-1] in ".;"
        last = max(i for i, w in enumerate(words[:-1]) if w[-1] in ".;") if any(w[-1] in ".;" for w in words[:-1]) else -1
        assert last + 1 < 50
    assert chunking._cut("...", 0, 5) == [(0, 3)] and chunking._cut("one. two", 5, 1) == [(5, 9), (10, 13)]


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from asofia.sources.folders import work_folder

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert "work" in work_folder(fake("local[4]"), "work") and work_folder(fake("local"), "x")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError):
            work_folder(fake(master), "x")


def test_date_parse_and_dept_from_ref_read_whole_texts(spark, tmp_path):
    from asofia.plans import extraction

    rows = [(3, "word " * 500 + "issued on May 7, 2022"), (4, "word " * 500 + "Department of Regulation")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    days = {r.doc_id: str(r.day) for r in extraction.date_parse(spark, str(tmp_path)).collect()}
    assert days[3] == "2022-05-07"
    assert extraction.dept_from_ref(spark, str(tmp_path)).filter("doc_id = 4").first().department == "Department of Regulation"


def test_blocks_without_a_shuffle(spark):
    from asofia.operators import chunking

    texts = ["a\n\nbü\n\n", None, "", "x"] * 400
    docs = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "doc_id long, raw_text string, more int").repartition(2)
    rows = chunking.blocks(docs, carried=("more",))
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, t in enumerate(texts):
        at = 0
        for n, block in enumerate((t.split("\n\n")) if t is not None else []):
            want.append((i, n, block, at, at + len(block), i % 7))
            at += len(block) + 2
    assert sorted(map(tuple, rows.collect())) == want


def test_embedded_passages_are_counted_without_a_shuffle_of_words(spark):
    from asofia.plans.structure import _embedded

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "", None, "Ü!", "x1"] * 300)], "chunk_id long, block string")
    found = _embedded(rows, "block")
    assert found.first()[0] == 600 and "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
