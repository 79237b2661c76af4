"""Keyword search: postings, any- and all-term queries, cover-density ranking, top documents and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.functions import text
from asofia.functions.stemmer import stem as stemmed
from asofia.operators import windows, wordblocks
from asofia.sources import folders

WEIGHTS = {"title": 1.0, "body": 0.4}
#: Rows of questions' terms that are broadcast at most, some 40 bytes each.
BROADCAST_TERMS = 1_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", title: str = "title", body: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per token: ``id, term, weight, pos, length`` and what is ``carried``. Title positions come first; ``length`` is the document's number of tokens."""
    both = docs.select(F.col(id_col).alias("id"), text.tokens(F.coalesce(F.col(title), F.lit(""))).alias("a"), text.tokens(F.coalesce(F.col(body), F.lit(""))).alias("b"), *carried)
    tagged = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    both = both.select("id", F.concat(tagged("a", WEIGHTS["title"]), tagged("b", WEIGHTS["body"])).alias("all"), *carried)
    rows = both.select("id", F.size("all").alias("length"), F.posexplode("all").alias("at", "token"), *carried)
    return rows.select("id", "token.term", "token.weight", (F.col("at") + 1).alias("pos"), "length", *carried)


def question_words(questions: DataFrame) -> DataFrame:
    """``qid, term``: the distinct words of each question but function words."""
    words = questions.select("qid", F.explode(F.array_distinct(text.tokens(F.col("question")))).alias("term"))
    return words.filter(~F.col("term").isin(text.STOPWORDS))


def matching_terms(words: DataFrame, rows: DataFrame) -> DataFrame:
    """``qid, stem, term``: every term of the index that has the stem of one of a question's words.

    Stems are taken of the distinct vocabulary only (``rows`` are postings or an index's ``vocabulary``), so documents are searched as they are. Function words have no stem here.
    """
    stems = term_stems(rows.filter(~F.col("term").isin(text.STOPWORDS)))
    return words.select("qid", stemmed("term").alias("stem")).distinct().join(stems, "stem").select("qid", "stem", "term")


def term_stems(rows: DataFrame) -> DataFrame:
    """``stem, term`` of the distinct ``term``s, as a table.

    Stems cost more than their few bytes say, so they are dealt to all tasks, and written lest a join asks for them twice, or for each row.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folders.written(rows.select("term").distinct().repartition(parts).select(stemmed("term").alias("stem"), "term"), "stems")


def rarest(terms: DataFrame, rows: DataFrame, n: int = 1) -> DataFrame:
    """Of ``qid, term`` the n terms of each question that the fewest documents hold."""
    # only the questions' own terms are counted, and each document once per term
    df = rows.join(terms.select("term").distinct(), "term", "left_semi").select("term", "id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rarest_by(terms, df, n)


def rarest_by(terms: DataFrame, df: DataFrame, n: int = 1) -> DataFrame:
    """``rarest`` by known counts (``term, df``)."""
    order = Window.partitionBy("qid").orderBy("df", "term")
    return terms.select("qid", "term").distinct().join(df, "term").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).select("qid", "term")


def scores(terms: DataFrame, rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Cover-density score of every document with any of a question's terms, or of ``pairs`` (``qid, id``) only; rows with a ``qid`` of their own are scored for that. For the best ones alone see ``wordblocks.top_matches``.

    A query for any term is covered by each single match, so every match is an extent of its own: the sum of weights, over the log of the length
    plus one, over the harmonic mean of the distances between consecutive extents.
    """
    terms = terms.select("qid", "term")
    if "qid" in rows.columns:  # matches are few among the tokens, which stay where they are
        hits = rows.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, ["qid", "term"])
    elif pairs is not None:
        hits = rows.join(pairs, "id").join(terms, ["qid", "term"])
    elif terms.count() <= BROADCAST_TERMS:
        # postings are dealt by document once; their matches, which are many more, then stay where they are
        hits = rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").repartition("id").join(F.broadcast(terms), "term")
    else:
        hits = terms.join(rows, "term")
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("qid", "id").orderBy("pos"))
    hits = hits.withColumn("gap", gap)
    close = F.when(F.count(F.lit(1)) > 1, F.sum(1 / F.col("gap")) / F.count(F.lit(1))).otherwise(1.0)
    return hits.groupBy("qid", "id").agg(F.round(F.sum("weight") / F.log(1 + F.first("length")) * close, 9).alias("score"), F.count(F.lit(1)).alias("matches"))


def all_scores(stems: DataFrame, terms: DataFrame, rows: DataFrame) -> DataFrame:
    """Cover-density score of every document that holds all of a question's ``stems`` (``qid, stem``); ``terms`` (``qid, stem, term``) are theirs in the index.

    An extent is a shortest stretch with every stem. It adds the harmonic mean of its matches' weights, over one plus the words in it that don't match;
    the sum is divided as in ``scores``, by distances between the extents' middles. The matches of a document are folded in order, in the JVM.
    """
    numbered = stems.select("qid", "stem").distinct().withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("stem")))
    numbered = numbered.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    hits = terms.join(numbered, ["qid", "stem"]).select("qid", "term", "k", "of").join(rows, "term")
    lists = hits.groupBy("qid", "id").agg(F.count_distinct("k").alias("found"), F.first("of").alias("of"), F.first("length").alias("length"), F.array_sort(F.collect_list(F.struct("pos", "k", (1 / F.col("weight")).alias("cost")))).alias("m"))
    lists = lists.filter("found = of")
    none = "cast(0 as double)"
    # last place of each stem as index in m; begin of the last extent; sum of extents, of closeness, their number and the last middle
    start = F.expr(f"struct(array_repeat(-1, int(of)) as last, -1 as begin, {none} as total, {none} as near, 0 as n, {none} as middle, 0 as i)")

    def step(state: Column, match: Column) -> Column:
        last = F.transform(state["last"], lambda x, j: F.when(j == match["k"] - 1, state["i"]).otherwise(x))
        moved = F.struct(last.alias("last"), F.array_min(last).alias("first"))
        return F.element_at(F.transform(F.array(moved), lambda s: _extent(state, s["last"], s["first"], match)), 1)

    def _extent(state: Column, last: Column, first: Column, match: Column) -> Column:
        new = (first > state["begin"]) & (first >= 0)
        inside = F.slice(F.col("m"), first + 1, state["i"] - first + 1)
        entries, words = state["i"] - first + 1, match["pos"] - F.element_at(F.col("m"), F.greatest(first, F.lit(0)) + 1)["pos"]
        worth = entries / F.aggregate(inside, F.lit(0.0), lambda t, x: t + x["cost"]) / (1 + words - (entries - 1))
        middle = (match["pos"] + F.element_at(F.col("m"), F.greatest(first, F.lit(0)) + 1)["pos"]) / 2.0
        near = F.when((state["n"] > 0) & (middle > state["middle"]), 1 / (middle - state["middle"])).otherwise(0.0)
        pick = lambda yes, no: F.when(new, yes).otherwise(no)
        return F.struct(
            last.alias("last"), pick(first, state["begin"]).alias("begin"), pick(state["total"] + worth, state["total"]).alias("total"), pick(state["near"] + near, state["near"]).alias("near"),
            pick(state["n"] + 1, state["n"]).alias("n"), pick(middle, state["middle"]).alias("middle"), (state["i"] + 1).alias("i"),
        )

    folded = lists.withColumn("s", F.aggregate("m", start, step))
    close = F.when(F.col("s.near") > 0, F.col("s.near") / F.col("s.n")).otherwise(1.0)
    return folded.select("qid", "id", F.round(F.col("s.total") / F.log(1 + F.col("length")) * close, 9).alias("score"), F.col("s.n").cast("long").alias("extents"))


def top(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each question, with their rank."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def search_index(docs: DataFrame, **columns: str) -> DataFrame:
    """``wordblocks.word_index`` of documents with their windows, the last issued first among equals."""
    dated = docs.withColumn("newest", F.unix_date("issued_date"))
    for name in windows.WINDOW[:2]:
        dated = dated.withColumn(name, F.unix_date(name))
    return wordblocks.word_index(dated.withColumn("is_withdrawn", F.col("is_withdrawn").cast("int")), newest="newest", attributes=windows.WINDOW, **columns)


def search(questions: DataFrame, terms: DataFrame, index: DataFrame, today: str, k: int = 10, newest_first: bool = True) -> DataFrame:
    """Top documents in force on each question's day: by score, then newest, then id. ``index`` comes from ``search_index``."""
    days = questions.select("qid", F.unix_date("as_of").alias("as_of"))
    found = wordblocks.top_matches(terms, days, index, k, windows.in_force(windows.day(today)), ("as_of",), newest_first)
    return found.select("qid", F.col("id").alias("doc_id"), "score", "rank")


def parse_web_query(queries: DataFrame) -> DataFrame:
    """``qid, kind, part, term, at``: words and "phrases" that must occur, and -words that must not.

    Function words don't count. ``part`` numbers the parts of a query; parts joined by ``or`` have one number and differ in ``choice``. A phrase's
    terms are numbered by ``at``. A query without terms gives no rows, so it finds nothing.
    """
    parts = queries.select("qid", F.posexplode(F.regexp_extract_all("query", F.lit(r'-?"[^"]*"|\S+'), F.lit(0))).alias("choice", "raw"))
    is_or = F.lower("raw") == "or"
    order = Window.partitionBy("qid").orderBy("choice")
    joined = F.coalesce(F.lag(is_or).over(order), F.lit(False))
    parts = parts.withColumn("is_or", is_or).withColumn("new", F.when(is_or | joined, 0).otherwise(1)).withColumn("part", F.sum("new").over(order).cast("int")).filter("not is_or")
    kind = F.when(F.col("raw").startswith("-"), "not").otherwise("must")
    terms = parts.select("qid", kind.alias("kind"), "part", "choice", F.posexplode(text.tokens(F.col("raw"))).alias("at", "term"))
    return terms.filter(~F.col("term").isin(text.STOPWORDS))


def web_terms(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a parsed query with every term of the index (postings, or a ``vocabulary``) that has their stem."""
    return parsed.withColumn("stem", stemmed("term")).drop("term").join(term_stems(rows), "stem")


def match_all(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """``qid, id`` of the documents that hold every required word and phrase (of parts joined by ``or`` one), by stems, and none of the excluded ones."""
    asked = web_terms(parsed, rows)
    hits = asked.join(rows.select("id", "term", "pos"), "term").withColumn("start", F.col("pos") - F.col("at"))
    size = parsed.groupBy("qid", "choice").agg(F.count(F.lit(1)).alias("terms"))
    whole = hits.groupBy("qid", "kind", "part", "choice", "id", "start").agg(F.count_distinct("at").alias("n")).join(size, ["qid", "choice"]).filter("n = terms")
    whole = whole.select("qid", "kind", "part", "id").distinct()
    wanted = parsed.filter("kind = 'must'").groupBy("qid").agg(F.count_distinct("part").alias("parts"))
    found = whole.filter("kind = 'must'").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n")).join(wanted, "qid").filter("n = parts")
    return found.select("qid", "id").join(whole.filter("kind = 'not'").select("qid", "id"), ["qid", "id"], "left_anti")


def _best_cover(hits: Column, width: int) -> Column:
    """The best stretch of ``hits`` (``side, i, stems``) of at most ``width`` words that begins and ends with a hit and lies on one side: ``a, b``, its first and last word. Null without hits.

    Most different stems first, then most hits, then the fewest words, then the first. As one word is at most one hit, a stretch is among ``width`` hits in a row.
    """
    near = lambda x, j: F.filter(F.slice(hits, j + 1, width), lambda y: (y["i"] < x["i"] + width) & (y["side"] == x["side"]))
    last = lambda w: F.element_at(w, -1)["i"]
    cover = lambda w: F.struct((-F.size(F.array_distinct(F.flatten(F.transform(w, lambda x: x["stems"]))))).alias("stems"), (-F.size(w)).alias("n"), (last(w) - w[0]["i"]).alias("words"), w[0]["i"].alias("a"), last(w).alias("b"))
    return F.array_min(F.transform(F.transform(hits, near), cover))


def snippets(top_rows: DataFrame, docs: DataFrame, terms: DataFrame, width: int = 30) -> DataFrame:
    """``qid, doc_id, rank, snippet``: up to two fragments of a found document around its best covers, the hits in « », in the text's order, joined by " … ".

    ``terms`` has ``qid, stem, term``. The first fragment is the best cover of the whole text, the second the best one of what is left on either side; each is filled
    up with words on both sides to ``width``, or fewer where the text or the other fragment ends. Without a hit the snippet is empty. Only found rows are read.
    """
    stems = F.map_from_entries(F.collect_list(F.struct("term", "stem")))
    wanted = terms.select("qid", "term", "stem").distinct().groupBy("qid").agg(stems.alias("stems"))
    rows = top_rows.select("qid", "doc_id", "rank").join(wanted, "qid").join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("w", F.split(text.squeeze(F.col("text")), " ")).drop("text")
    known = lambda w: F.array_compact(F.transform(text.tokens(w), lambda t: F.try_element_at("stems", t)))
    found = F.transform("w", lambda w, i: F.struct(F.lit(0).alias("side"), i.alias("i"), known(w).alias("stems")))
    rows = rows.withColumn("hits", F.filter(found, lambda x: F.size(x["stems"]) > 0)).withColumn("n", F.size("w"))

    def filled(cover: str, low: Column, high: Column) -> Column:
        """A cover's fragment between two words: from ``a`` on, before ``b``."""
        before = F.floor((F.lit(width) - 1 - F.col(f"{cover}.words")) / 2).cast("int")
        start = F.greatest(low, F.least(F.col(f"{cover}.a") - before, high - width))
        return F.when(F.col(cover).isNotNull(), F.struct(start.alias("a"), F.least(start + width, high).alias("b")))

    rows = rows.withColumn("cover", _best_cover(F.col("hits"), width))
    rows = rows.withColumn("first", filled("cover", F.lit(0), F.col("n")))
    side = lambda x: F.when(x["i"] < F.col("first.a"), -1).when(x["i"] >= F.col("first.b"), 1).otherwise(0)
    sided = F.transform("hits", lambda x: F.struct(side(x).alias("side"), x["i"].alias("i"), x["stems"].alias("stems")))
    rows = rows.withColumn("rest", F.filter(sided, lambda x: x["side"] != 0))
    rows = rows.withColumn("cover", _best_cover(F.col("rest"), width))
    behind = F.col("cover.a") >= F.col("first.b")
    rows = rows.withColumn("second", filled("cover", F.when(behind, F.col("first.b")).otherwise(0), F.when(behind, F.col("n")).otherwise(F.col("first.a"))))
    marked = lambda w: F.when(F.size(known(w)) > 0, F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w)
    shown = F.transform(F.array_sort(F.array_compact(F.array("first", "second"))), lambda f: F.array_join(F.transform(F.slice("w", f["a"] + 1, f["b"] - f["a"]), marked), " "))
    return rows.select("qid", "doc_id", "rank", F.array_join(shown, " … ").alias("snippet"))
