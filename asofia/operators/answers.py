"""Answers from model replies: prompts, decoding, routing, and quotes checked against their passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from asofia.functions import temporal, text
from asofia.operators import alignment

MIN_QUOTE, VERIFIED = 12, 90.0
MAX_REWRITES, GRADE_TEXT = 2, 1500
QUOTE_SHOWN, EXCERPT_CONTEXT = 160, 700
#: What a reply must hold, and what the grader's reply must.
REPLY = "abstained boolean, sentences array<struct<text: string, citations: array<struct<passage: string, quote: string>>>>"
GRADE = "relevant array<string>, answerable boolean, better_query string"


def label_passages(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (``qid, rank, doc_id, as_of, text``) named P1, P2 … in their order, with document fields and the in-force flag."""
    rows = hits.join(docs.select("doc_id", "source_id", "title", "issued_date", "valid_from", "valid_to"), "doc_id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    flag = temporal.in_force_flag(F.col("valid_from"), F.col("valid_to"), F.col("as_of"))
    return rows.withColumn("place", place.cast("long")).withColumn("label", F.concat(F.lit("P"), "place")).withColumn("in_force", flag).drop("valid_from", "valid_to")


def prompts(passages: DataFrame, questions: DataFrame, cut: int | None = None) -> DataFrame:
    """``qid, prompt``: labelled passages with title, heading (if they have that column), issue date and in-force note, the question and the day. ``cut`` shortens the passages, as for the grader."""
    heading = [F.col("heading")] if "heading" in passages.columns else []
    meta = F.concat_ws(" | ", "title", *heading, F.concat(F.lit("issued "), F.col("issued_date").cast("string")), F.when(F.col("in_force"), "in force").when(~F.col("in_force"), "not in force on the date asked"))
    body = F.substring("text", 1, cut) if cut else F.col("text")
    block = F.concat(F.lit("["), "label", F.lit("] "), meta, F.lit("\n"), body)
    lists = passages.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("blocks"))
    when = F.concat(F.lit("The question is about the rules in force on "), F.col("as_of").cast("string"), F.lit("."))
    return questions.join(lists, "qid").select("qid", F.concat(F.lit("Passages:\n\n"), "blocks", F.lit("\n\nQuestion: "), "question", F.lit("\n"), F.coalesce(when, F.lit(""))).alias("prompt"))


def json_part(reply: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    start = F.instr(reply, "{")
    end = F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    return F.when((start > 0) & F.contains(reply, F.lit("}")) & (end > start), F.substring(reply, start, end - start + 1))


def decode(replies: DataFrame) -> DataFrame:
    """``qid, valid, abstained, sentences``; what a reply leaves out is false or empty."""
    found = F.from_json(json_part(F.col("reply")), REPLY)
    rows = replies.select("qid", F.get_json_object(json_part(F.col("reply")), "$").isNotNull().alias("valid"), found.alias("r"))
    none = F.array().cast("array<struct<text: string, citations: array<struct<passage: string, quote: string>>>>")
    return rows.select("qid", "valid", F.coalesce("r.abstained", F.lit(False)).alias("abstained"), F.coalesce("r.sentences", none).alias("sentences"))


def grade(replies: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept passages, and per question ``answerable`` and ``better_query``. If no label fits, or the reply can't be read, all are kept."""
    g = replies.select("qid", F.from_json(json_part(F.col("reply")), GRADE).alias("g"))
    rows = passages.join(g, "qid", "left").withColumn("named", F.coalesce(F.array_contains("g.relevant", F.col("label")), F.lit(False)))
    any_named = F.max("named").over(Window.partitionBy("qid"))
    rows = rows.withColumn("any", any_named)
    kept = rows.filter("named or not any").drop("g", "named", "any")
    state = rows.groupBy("qid").agg((F.coalesce(F.first("g.answerable"), F.lit(False)) & F.max("named")).alias("answerable"), F.first("g.better_query").alias("better_query"))
    return kept, state


def route(state: DataFrame) -> DataFrame:
    """``generate`` what is answerable, ``rewrite`` while there is a better query and fewer than two rewrites, else ``abstain``."""
    better = F.coalesce(F.trim("better_query") != "", F.lit(False)) & (F.col("rewrites") < MAX_REWRITES)
    return state.withColumn("step", F.when(F.col("answerable"), "generate").when(better, "rewrite").otherwise("abstain"))


def rewrite(state: DataFrame) -> DataFrame:
    """The next round's questions: the better query, one more rewrite, and a line in the trace."""
    rows = state.filter("step = 'rewrite'")
    return rows.withColumn("question", F.col("better_query")).withColumn("rewrites", F.col("rewrites") + 1).withColumn("trace", F.array_append("trace", F.concat(F.lit("rewrite: "), "better_query")))


def relabelled(kept: DataFrame) -> DataFrame:
    """Labels without gaps."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long")
    return kept.withColumn("place", place).withColumn("label", F.concat(F.lit("P"), "place"))


def _normalised(quote: Column) -> Column:
    q = F.replace(F.replace(F.replace(quote, F.lit("“"), F.lit('"')), F.lit("”"), F.lit('"')), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(q, r"(?U)\s+", " "))


@F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("start", LongType()), StructField("stop", LongType())]))
def _fuzzy(quote: pd.Series, passage: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(alignment.best_stretches(list(quote), list(passage)), columns=["score", "start", "stop"])


def locate(rows: DataFrame, quote: str = "quote", passage: str = "text") -> DataFrame:
    """Adds ``score, start, stop`` (0-based, end open) of a quote in its passage, however low the score. Only quotes that aren't found literally, as they are or
    normalised, are aligned in Python. A quote of under 12 characters or without a passage has score 0, and at score 0 there is no span."""
    q = _normalised(F.col(quote))
    exact = F.coalesce(F.nullif(F.instr(passage, F.col(quote)), F.lit(0)), F.nullif(F.instr(F.col(passage), q), F.lit(0)))
    rows = rows.withColumn("_q", q).withColumn("_at", F.when(F.length("_q") >= MIN_QUOTE, exact - 1))
    literal = rows.filter("_at is not null").withColumn("score", F.lit(100.0)).withColumn("start", F.col("_at").cast("long")).withColumn("stop", F.col("start") + F.when(F.contains(passage, F.col(quote)), F.length(quote)).otherwise(F.length("_q")))
    short = (F.coalesce(F.length("_q"), F.lit(0)) < MIN_QUOTE) | F.col(passage).isNull()
    rest = rows.filter("_at is null").withColumn("_f", F.when(~short, _fuzzy("_q", passage)))
    rest = rest.withColumn("score", F.coalesce("_f.score", F.lit(0.0)))
    for end in ("start", "stop"):
        rest = rest.withColumn(end, F.when(F.col("score") > 0, F.col(f"_f.{end}")))
    return literal.drop("_q", "_at").unionByName(rest.drop("_q", "_at", "_f"))


def verify(decoded: DataFrame, passages: DataFrame) -> DataFrame:
    """One row per citation of each sentence with words: ``qid, sentence, words, place, label, quote, verified, score, span_start, span_stop``.

    A sentence without citations has one row without a label. An unknown label is not verified. Spans count in the document.
    """
    s = decoded.select("qid", F.posexplode("sentences").alias("sentence", "s")).withColumn("words", F.trim("s.text")).filter("words <> ''")
    c = s.select("qid", "sentence", "words", F.posexplode_outer("s.citations").alias("place", "c"))
    c = c.select("qid", "sentence", "words", "place", F.regexp_replace(F.trim("c.passage"), r"^\[+|\]+$", "").alias("label"), F.trim("c.quote").alias("quote"))
    known = passages.select("qid", "label", "text", "char_start", "doc_id")
    rows = locate(c.join(known, ["qid", "label"], "left"))
    ok = F.coalesce((F.col("score") >= VERIFIED) & F.col("start").isNotNull(), F.lit(False))
    span = lambda x: F.when(ok, F.col("char_start") + F.col(x))
    return rows.select("qid", "sentence", "words", "place", "label", "quote", "doc_id", ok.alias("verified"), "score", span("start").alias("span_start"), span("stop").alias("span_stop"))


def outcomes(decoded: DataFrame, verified: DataFrame, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``qid, answered, note, answer, kept, dropped``: sentences with a verified quote make the answer, without any the question is abstained from."""
    sentences = verified.groupBy("qid", "sentence", "words").agg(F.max("verified").alias("ok"))
    joined = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.struct("sentence", "words")))), lambda x: x["words"])
    per = sentences.groupBy("qid").agg(joined(True).alias("kept"), joined(False).alias("dropped"))
    rows = questions.select("qid").join(passages.select("qid").distinct().withColumn("has", F.lit(True)), "qid", "left").join(decoded.select("qid", "valid", "abstained"), "qid", "left").join(per, "qid", "left")
    note = (
        F.when(F.col("has").isNull(), "no passages").when(~F.coalesce("valid", F.lit(False)), "invalid reply").when(F.col("abstained"), "abstained")
        .when(F.coalesce(F.size("kept"), F.lit(0)) <= 0, "nothing verified").otherwise("answered")
    )
    empty = F.array().cast("array<string>")
    return rows.select("qid", (note == "answered").alias("answered"), note.alias("note"), F.when(note == "answered", F.array_join("kept", " ")).otherwise("").alias("answer"), F.coalesce("kept", empty).alias("kept"), F.coalesce("dropped", empty).alias("dropped"))


def excerpt(body: Column, start: Column, stop: Column, context: int = EXCERPT_CONTEXT) -> Column:
    """A span with its surroundings, and an ellipsis where text is left out."""
    low, high = F.greatest(start - context, F.lit(0)), F.least(stop + context, F.length(body))
    cut = F.substring(body, (low + 1).cast("int"), (high - low).cast("int"))
    return F.concat(F.when(low > 0, "…").otherwise(""), cut, F.when(high < F.length(body), "…").otherwise(""))


def number_sources(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources numbered by first verified use, with a shortened quote; and each supported sentence with its sorted marks."""
    ok = verified.filter("verified")
    first = ok.groupBy("qid", "label").agg(F.min(F.struct("sentence", "place", "quote")).alias("f"))
    sources = first.select("qid", "label", F.row_number().over(Window.partitionBy("qid").orderBy("f.sentence", "f.place")).cast("long").alias("number"), "f.quote")
    sources = sources.withColumn("quote", F.when(F.length("quote") < QUOTE_SHOWN, F.col("quote")).otherwise(F.concat(F.substring("quote", 1, QUOTE_SHOWN - 3), F.lit("..."))))
    marks = ok.join(sources.select("qid", "label", "number"), ["qid", "label"]).groupBy("qid", "sentence", "words").agg(F.array_sort(F.collect_set("number")).alias("n"))
    line = F.concat(text.escape_html(F.col("words")), F.lit(" "), F.array_join(F.transform("n", lambda n: F.concat(F.lit("["), n, F.lit("]"))), ""))
    return sources, marks.select("qid", "sentence", line.alias("line"))


def verified_view(verified: DataFrame, docs: DataFrame) -> DataFrame:
    """Per sentence its verified citations as (source_id, title, quote)."""
    rows = verified.filter("verified").join(docs.select("doc_id", "source_id", "title"), "doc_id")
    cited = F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id", "title", "quote"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["title"].alias("title"), x["quote"].alias("quote")))
    return rows.groupBy("qid", "sentence", "words").agg(cited.alias("citations"))


def source_cards(verified: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Cited documents of each question with their fields and what amended them (from a timeline)."""
    cited = verified.filter("verified").select("qid", "doc_id").distinct()
    amended = lines.filter("section = 'amended_by'").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("amended_by"))
    return cited.join(docs.select("doc_id", "title", "issued_date"), "doc_id").join(amended, "doc_id", "left")


def containing(texts: DataFrame, quotes: DataFrame, id_col: str, text_col: str = "text", quote_id: str = "item_id", quote: str = "quote") -> DataFrame:
    """Pairs ``id, quote_id, start`` of texts that hold a quote literally. Null and empty quotes are in no text.

    A quote meets the texts by the rarest word that it surely holds whole, a quote without one by the rarest three letters within its words; then the
    text is checked. A quote without three letters or digits in a row can't be searched and is in no text.
    """
    q = quotes.select(F.col(quote_id).alias("q"), F.col(quote).alias("body")).filter("q is not null and body <> ''")
    t = texts.select(F.col(id_col).alias("t"), F.col(text_col).alias("text")).filter("t is not null and text is not null")
    words = text.tokens(F.col("body"))
    q = q.withColumn("inner", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    parts = lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))))
    by_word = q.filter(F.size("inner") > 0).select("q", "body", F.explode(F.array_distinct("inner")).alias("key"))
    by_part = q.filter(F.size("inner") == 0).select("q", "body", F.explode(parts(words)).alias("key")).filter(F.length("key") == 3)
    found = None
    for asked, keys in ((by_word, F.array_distinct(text.tokens(F.col("text")))), (by_part, parts(F.array_distinct(text.tokens(F.col("text")))))):
        if asked is by_part and asked.isEmpty():
            continue
        held = t.select("t", F.explode(keys).alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
        df = held.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
        rarest = asked.join(df, "key", "left").groupBy("q").agg(F.min_by("key", F.struct(F.coalesce("df", F.lit(0)), "key")).alias("key"), F.first("body").alias("body"))
        pairs = held.join(rarest, "key").select("t", "q", "body")
        found = pairs if found is None else found.union(pairs)
    rows = found.join(t, "t").withColumn("start", F.instr("text", F.col("body")) - 1).filter("start >= 0")
    return rows.select(F.col("t").alias(id_col), F.col("q").alias(quote_id), F.col("start").cast("long").alias("start")).distinct()
