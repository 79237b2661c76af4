"""URL rules and chats: against their SQL, and odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from asofia.llm import chat, oracle, queries, urls
from duck import rows, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op6_url_filters", "op8_chat_formatting"])
def test_no_python_in_the_plan(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://COM/", "https://a.b.EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "https://x.www.example.com/en/a", "ftp://example.com/EN/", "http://notexample.com/en/", "x://net/es/1",
    "x://a.net/fr/", "x://a.net/de/", "http://example.com:80/en/", "http://u@example.com/en/", "http://example.com./en/", "http://com?x", "http://a://b.com/en/", "http://example.com/en", "http://a\u0001com/", "http://..com/",
]


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2 + [(None, "http://a.com/", "y")], "page_id long, url string, host string").withColumn("path", F.lit(1)).withColumn("rule", F.lit(2))
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.judge_urls(pages, rules).toPandas()
    c = duckdb.connect()
    frame = pages.select("page_id", "url").toPandas()  # noqa: F841
    c.execute("create view pages as select cast(page_id as bigint) as page_id, url from frame")
    assert rows(got) == rows(c.execute(oracle.URLS).df())
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_nested_rules_are_put_back(spark):
    """After an inner rule's interval the outer rule holds again; of equal rules the block wins; longer paths win over shorter."""
    rules = spark.createDataFrame([("com", "", "block"), ("b.com", "", "allow"), ("a.b.com", "", "block"), ("a.b.com", "", "allow"), ("com", "/long/path", "allow"), (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
    hosts = ["com", "a.com", "b.com", "a.a.b.com", "a.b.com", "ab.com", "b.b.com", "c.com", "bb.com"]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/long/path/1"))], "page_id long, url string")

    def want(h, p):
        fits = [(len(r.host + r.path), len(r.host), r.host + r.path, r.verdict) for r in rules.collect() if r.host and r.path is not None and (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return max(fits)[2:]

    assert all((r.rule, r.verdict) == want(r.host, r.path) for r in urls.judge_urls(pages, rules).collect())


def test_snapshots(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "B"), (5, 0, "user", "a"), (5, 1, "assistant", "B"), (6, 0, None, None), (7, 0, "", ""), (None, 0, "user", "z"), (8, None, "user", "n"), (8, 5, "user", "m"), (9, 0, "user", "a"), (9, 0, "user", "a")]
    turns += [(20, i, "user", str(i)) for i in range(150)] + [(21, i, "user", str(i)) for i in range(100)]
    df = spark.createDataFrame([(*t, 1, "b") for t in turns], "conv_id long, turn long, role string, text string, block int, h1 string")
    got = {r.conv_id: r for r in chat.collapse_and_render(df).collect()}
    assert set(got) == {3, 4, 6, 7, None, 8, 9, 20} and got[20].n_turns == 150
    assert {i: got[i].n_snapshots for i in got} == {3: 3, 4: 3, 6: 1, 7: 1, None: 1, 8: 1, 9: 2, 20: 2}  # 2 is a prefix of 3, 4 and 9
    assert got[3].rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in turns[3:6])
    assert got[20].rendered.count("<|im_start|>") == 150 and got[8].rendered.index("n<") < got[8].rendered.index("m<")
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark):
    """One conversation with most of all rows, turn numbers that are null or all alike, and a snapshot that ends inside a part."""
    turns = [(1, i, "user", f"t{i}") for i in range(2500)] + [(2, i, "user", f"t{i}") for i in range(1500)] + [(3, None, "user", "n")] * 1100 + [(4, 7, "user", "same")] * 1025
    got = sorted((r.conv_id, r.part, r.n_turns, r.n_snapshots, r.rendered) for r in chat.collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect())
    assert [(r[:4], r[4].count("<|im_start|>")) for r in got] == [((1, 0, 2500, 2), 1024), ((1, 1, 2500, 2), 1024), ((1, 2, 2500, 2), 452), ((3, 0, 1100, 1), 1024), ((3, 1, 1100, 1), 76), ((4, 0, 1025, 1), 1024), ((4, 1, 1025, 1), 1)]
    assert "".join(r[4] for r in got if r[0] == 1) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(2500))


def test_many_rules_and_hot_labels(spark):
    """Random rules and URLs against every rule in turn: a label with more boundaries than a sweep has URLs, one with few, one without rules."""
    rng = random.Random(6)
    host = lambda top: ".".join([*(rng.choice("abc") for _ in range(rng.randrange(4))), top])
    rules = [(host(rng.choice(["com", "com", "net"])), rng.choice(["/", "", "/x/", "/x/y"]), rng.choice(["allow", "block"])) for _ in range(120)]
    pages = [(i, f"http://{host(rng.choice(['com', 'com', 'com', 'net', 'org']))}{rng.choice(['', '/', '/x/', '/x/y/z?q', '/w'])}") for i in range(1500)]
    found = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(found) == 1500
    for r in found:
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))
