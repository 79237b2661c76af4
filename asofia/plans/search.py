"""Queries on time-filtered search: keyword, vector, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.functions import temporal, text
from asofia.functions.stemmer import stem_expr
from asofia.operators import embedding, intervals, keyword, neighbours, vectors, windows, wordblocks
from asofia.plans.registry import registry
from asofia.plans.views import STOP, sql, stem
from asofia.sources import corpus, folders
from asofia.sources.corpus import TODAY

QUERIES, ORACLE, query = registry()


def _parts(spark, d):
    """Documents, their word index, questions, and the index's terms that these ask for."""
    docs, questions = corpus.documents(spark, d), corpus.questions(spark, d)
    index = folders.written(keyword.search_index(docs), "words")
    return docs, index, questions, folders.written(keyword.matching_terms(keyword.question_words(questions), wordblocks.vocabulary(index)), "terms")


_IN_FORCE = "valid_from <= as_of and (valid_to is null or valid_to > as_of) and (as_of < date '2026-10-04' or not is_withdrawn)"


@query(sql("select doc_id, valid_from, valid_to from docs, (select date '2022-01-01' as as_of) where " + _IN_FORCE, "docs"))
def asof_documents(spark: SparkSession, d: str) -> DataFrame:
    day, today = F.lit("2022-01-01").cast("date"), F.lit(TODAY).cast("date")
    ok = temporal.searchable(F.col("valid_from"), F.col("valid_to"), F.col("is_withdrawn"), day, today)
    return corpus.documents(spark, d).filter(ok).select("doc_id", "valid_from", "valid_to")


_TOP_DOCS = f"""
  select qid, doc_id, score, rank from (
    select qid, doc_id, score, row_number() over (partition by qid order by score desc, issued_date desc, doc_id) as rank
    from scored join docs using (doc_id) join questions using (qid) where {_IN_FORCE}
  ) where rank <= 10"""


@query(sql(_TOP_DOCS, "scored"))
def keyword_search_docs(spark: SparkSession, d: str) -> DataFrame:
    _, index, questions, terms = _parts(spark, d)
    return keyword.search(questions, terms, index, TODAY)


_ALL = {
    "a0": "select qid, unnest(t) as term, unnest(range(1, len(t) + 1)) as spot from (select qid, regexp_extract_all(lower(question), '[a-z0-9]+') as t from questions)",
    "a1": f"select qid, {stem('term')} as stem, min(spot) as spot from a0 where term not in {STOP} group by all",
    "a2": "select qid, stem, row_number() over (partition by qid order by stem) as k, count(*) over (partition by qid) as parts from (select * from a1 qualify row_number() over (partition by qid order by spot) <= 3)",
    "ah": "select qid, doc_id, k, parts, pos, 1 / weight as cost from a2 join vocab using (stem) join postings using (term)",
    "aw": "select *, row_number() over w as i, sum(cost) over w as costs, " + ", ".join(f"max(case when k = {k} then pos end) over w as l{k}" for k in (1, 2, 3)) + " from ah window w as (partition by qid, doc_id order by pos)",
    "ab": "select *, case when l1 is not null and (parts < 2 or l2 is not null) and (parts < 3 or l3 is not null) then least(l1, coalesce(l2, l1), coalesce(l3, l1)) end as b from aw",
    "ae": "select * from ab qualify b > coalesce(max(b) over (partition by qid, doc_id order by pos rows between unbounded preceding and 1 preceding), 0)",
    "ax": "select e.qid, e.doc_id, e.pos, e.b, e.i - s.i + 1 as entries, e.costs - s.costs + s.cost as c, (e.pos + e.b) / 2.0::double as middle from ae e join aw s on s.qid = e.qid and s.doc_id = e.doc_id and s.pos = e.b",
    "ay": "select *, middle - lag(middle) over (partition by qid, doc_id order by pos) as gap from ax",
}


@query(
    sql(
        """select qid, doc_id, count(*) as extents,
        round(sum(entries / c / (1 + pos - ay.b - (entries - 1))) / ln(1 + any_value(len(tokens.a) + len(tokens.b))) * (case when sum(1 / gap) > 0 then sum(1 / gap) / count(*) else 1 end), 9) as score
        from ay join tokens using (doc_id) group by qid, doc_id""",
        "terms", **_ALL,
    )
)
def keyword_all_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the first three stems of a question, by cover density."""
    index = folders.written(wordblocks.word_index(corpus.documents(spark, d)), "words")
    words = F.filter(text.tokens(F.col("question")), lambda t: ~t.isin(text.STOPWORDS))
    first = F.slice(F.array_distinct(F.expr(f"transform(words, t -> {stem_expr('t')})")), 1, 3)
    asked = corpus.questions(spark, d).withColumn("words", words).select("qid", F.explode(first).alias("stem"))
    stems = keyword.term_stems(wordblocks.vocabulary(index).filter(~F.col("term").isin(text.STOPWORDS)))
    terms = folders.written(asked.join(stems, "stem"), "terms")
    return wordblocks.all_matches(asked, terms, index).select("qid", F.col("id").alias("doc_id"), "extents", "score")


@query(sql("select * from terms", "terms"))
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[3]


@query(sql("select count(*) as postings, count(distinct term) as terms, round(sum(weight), 6) as weight, max(pos) as last from postings", "postings"))
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return keyword.postings(corpus.documents(spark, d)).agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("term").alias("terms"), F.round(F.sum("weight"), 6).alias("weight"), F.max("pos").cast("long").alias("last"))


@query(
    sql(
        """select doc_id from docs, (select date '2022-01-01' as as_of) where doc_type = 'circular' and department ilike '%SRC1%'
        and issued_date between date '2016-01-01' and date '2023-12-31' and """ + _IN_FORCE, "docs",
    )
)
def filters_combined(spark: SparkSession, d: str) -> DataFrame:
    day, today = F.lit("2022-01-01").cast("date"), F.lit(TODAY).cast("date")
    docs = corpus.documents(spark, d).filter("doc_type = 'circular' and issued_date between date'2016-01-01' and date'2023-12-31'").filter(F.col("department").ilike("%SRC1%"))
    return docs.filter(temporal.searchable(F.col("valid_from"), F.col("valid_to"), F.col("is_withdrawn"), day, today)).select("doc_id")


@query(sql(f"select qid, count(*) as n, min(doc_id) as first, sum(doc_id)::bigint as ids from docs, questions where {_IN_FORCE} group by qid", "docs", "questions"))
def asof_join_questions(spark: SparkSession, d: str) -> DataFrame:
    """The interval join of questions and documents, aggregated: windows add up by nodes of the calendar, and each day reads its nodes."""
    days, windowed = _windows(spark, d)
    found = intervals.on_day(days, windowed, "as_of", "valid_from", "until", {"n": ("count", F.col("doc_id")), "first": ("min", F.col("doc_id")), "ids": ("sum", F.col("doc_id"))})
    return found.filter("n > 0").select("qid", "n", "first", "ids")


@query(sql(f"select qid, doc_id from docs, questions where {_IN_FORCE}", "docs", "questions"))
def asof_join_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The interval join itself: each question with each document in force on its day."""
    return intervals.day_pairs(*_windows(spark, d), "as_of", "valid_from", "until", "qid", "doc_id")


def _windows(spark, d):
    """Questions' days, and documents' windows that end where a withdrawal ends them."""
    until = intervals.effective_end(F.col("valid_to"), F.col("is_withdrawn"), F.lit(TODAY).cast("date"))
    return corpus.questions(spark, d).select("qid", "as_of"), corpus.documents(spark, d).select("doc_id", "valid_from", until.alias("until"))


_LINE_DAY = "date '1995-01-01' + cast(p_partkey % 1500 as integer)"


@query(f"select p_partkey as part, count(*) as n, min(l_orderkey) as first, max(l_quantity) as most from part join lineitem on l_shipdate::date <= {_LINE_DAY} and l_shipdate::date + 10 * l_linenumber::integer > {_LINE_DAY} group by p_partkey")
def asof_join_lines(spark: SparkSession, d: str) -> DataFrame:
    """The interval join of two tables that grow: order lines on their way (ten days for each line number) on a day of each part."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 1500).cast("int"))
    days = corpus.table(spark, d, "part").select(F.col("p_partkey").alias("part"), day.alias("day"))
    shipped = F.col("l_shipdate").cast("date")
    lines = corpus.table(spark, d, "lineitem").select(shipped.alias("start"), F.date_add(shipped, (F.col("l_linenumber") * 10).cast("int")).alias("end"), "l_orderkey", "l_quantity")
    found = intervals.on_day(days, lines, "day", "start", "end", {"n": ("count", F.lit(1)), "first": ("min", F.col("l_orderkey")), "most": ("max", F.col("l_quantity"))})
    return found.filter("n > 0").select("part", "n", "first", "most")


@query(
    sql(
        """select doc_id, coalesce(valid_from <= date '2022-01-01', true) and coalesce(valid_to > date '2022-01-01', true) as in_force,
        coalesce(valid_from <= date '2026-10-04', true) and coalesce(valid_to > date '2026-10-04', true) and not (is_withdrawn and valid_to is null) as counted from docs""",
        "docs",
    )
)
def in_force_flag(spark: SparkSession, d: str) -> DataFrame:
    day, today = F.lit("2022-01-01").cast("date"), F.lit(TODAY).cast("date")
    flag = temporal.in_force_flag(F.col("valid_from"), F.col("valid_to"), day)
    counted = temporal.counted_in_force(F.col("valid_from"), F.col("valid_to"), F.col("is_withdrawn"), today, today)
    return corpus.documents(spark, d).select("doc_id", flag.alias("in_force"), counted.alias("counted"))


_TOP_VECTORS = "select qid, vec_id, cosine, rank from (select *, row_number() over (partition by qid order by cosine desc, vec_id) as rank from near) where rank <= 50"


def _vectors(spark, d):
    table = corpus.table(spark, d, "embeddings")
    return table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), table


@query(sql(_TOP_VECTORS, "vectors"))
def vector_topn(spark: SparkSession, d: str) -> DataFrame:
    return vectors.exact_nearest(*_vectors(spark, d))


@query("select vec_id as qid, true as good, true as pruned from embeddings where vec_id % 20 = 0 and embedding is not null")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per query, whether the index as a whole finds nine in ten of the true ten nearest, and compares no more than 65 % of all vectors on average (the test vectors are noise without clusters)."""
    return _recall(spark, d).select("qid", (F.avg("recall").over(Window.partitionBy()) >= 0.9).alias("good"), (F.avg("share").over(Window.partitionBy()) <= 0.65).alias("pruned"))


def _recall(spark, d):
    """Share of the true ten nearest that the clustered index finds, and share of all vectors that it compares, per query."""
    queries, table = _vectors(spark, d)
    true = vectors.exact_nearest(queries, table, 10).select("qid", "vec_id")
    near = vectors.clustered_nearest(queries, table, 10).select("qid", "vec_id", "compared")
    every = F.broadcast(table.filter("embedding is not null").agg(F.count(F.lit(1)).alias("every")))  # one row
    rows = true.join(near, ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("compared") / F.count(F.lit(1))).alias("recall"), F.max("compared").alias("compared"))
    return rows.join(every).select("qid", "recall", (F.col("compared") / F.col("every")).alias("share"))


@query()
def ann_figures(spark: SparkSession, d: str) -> DataFrame:
    """Recall and share of vectors compared, query by query."""
    return _recall(spark, d)


def _dated_vectors(spark, d):
    """Vectors with the windows of the documents of their ids, and a twentieth of them as queries of three days."""
    queries, table = _vectors(spark, d)
    days = F.element_at(F.array(*(F.unix_date(F.lit(x).cast("date")) for x in ("2019-01-01", "2022-01-01", TODAY))), (F.col("qid") % 3).cast("int") + 1)
    return queries.withColumn("as_of", days), windows.with_window(table, corpus.documents(spark, d), "vec_id")


_DATED = {"asked": "select vec_id as qid, [date '2019-01-01', date '2022-01-01', date '2026-10-04'][vec_id % 3 + 1] as as_of from embeddings where vec_id % 20 = 0"}


@query(sql(f"select qid, vec_id, cosine, row_number() over (partition by qid order by cosine desc, vec_id) as rank from near join asked using (qid) join docs on doc_id = vec_id where cosine is not null and {_IN_FORCE} qualify rank <= 50", "docs", "vectors", **_DATED))
def vector_in_force(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors in force on each query's day."""
    queries, table = _dated_vectors(spark, d)
    index = folders.written(neighbours.neighbour_index(table, attributes=windows.WINDOW), "vectors")
    return neighbours.graph_nearest(queries, index, vectors.CANDIDATES, windows.in_force(windows.day(TODAY)), ("as_of",), exact=True).select("qid", "vec_id", "cosine", "rank")


#: Of a hundred vectors, how many a filter lets pass.
_KEPT = (1, 10, 100)


@query("select vec_id as qid, keeps, true as good from embeddings, (select unnest([1, 10, 100]) as keeps) where vec_id % 20 = 0 and embedding is not null")
def ann_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Per query and filter, whether the graphs as a whole find nine in ten of the true ten nearest that the filter lets pass."""
    return _filtered_recall(spark, d).select("qid", "keeps", (F.avg("recall").over(Window.partitionBy("keeps")) >= 0.9).alias("good"))


@query()
def ann_filtered_figures(spark: SparkSession, d: str) -> DataFrame:
    """Recall and share of vectors compared, by query and filter."""
    return _filtered_recall(spark, d)


def _filtered_recall(spark, d):
    queries, table = _vectors(spark, d)
    slots = F.pmod(F.xxhash64("vec_id"), F.lit(100))
    index = folders.written(neighbours.neighbour_index(table.withColumn("slot", slots), attributes=("slot",)), "vectors")
    asked = queries.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in _KEPT], "keeps long")))  # three rows
    # a query's filters are told apart by its number
    asked = asked.withColumn("of", F.col("qid")).withColumn("qid", F.col("qid") * 1000 + F.col("keeps"))
    allow = lambda q, block: (block["slot"] < q["keeps"]) & (block["id"] != q["of"])
    near = neighbours.graph_nearest(asked, index, 10, allow, ("keeps", "of"))
    true = neighbours.graph_nearest(asked, index, 10, allow, ("keeps", "of"), exact=True).select("qid", "vec_id")
    every = F.broadcast(table.filter("embedding is not null").agg(F.count(F.lit(1)).alias("every")))  # one row
    found = true.join(near.select("qid", "vec_id", "compared"), ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("compared") / F.count(F.lit(1))).alias("recall"), F.max("compared").alias("compared"))
    rows = asked.select("qid", "of", "keeps").join(found, "qid", "left").join(every)
    return rows.select(F.col("of").alias("qid"), "keeps", F.coalesce("recall", F.lit(1.0)).alias("recall"), (F.coalesce("compared", F.lit(0)) / F.col("every")).alias("share"))


_EMBED = """
  select id, bucket, n / sqrt(sum(n * n) over (partition by id)) as value from (
    select {id} as id, ('0x' || substr(md5(term), 1, 8))::bigint % 384 as bucket, count(*)::double as n from {table} group by all
  )"""


@query(sql("select id as doc_id, count(*) as buckets, round(sum(value * value), 6) as norm, round(max(value), 6) as top from e group by id", "postings", e=_EMBED.format(id="doc_id", table="postings")))
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    sparse = vectors.hashed_embedding(keyword.postings(corpus.documents(spark, d)))
    return sparse.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("buckets"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"), F.round(F.max("value"), 6).alias("top"))


@query(sql("select id as doc_id, 384 as dims, count(*) as buckets, round(max(value::float)::double, 6) as top from e group by id", "postings", e=_EMBED.format(id="doc_id", table="postings")))
def model_embed(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents through a model's interface; the model is the test double."""
    rows = corpus.documents(spark, d).select("doc_id", F.concat_ws(" ", "title", "text").alias("embed_text"))
    made = embedding.embedded(rows, embedding.HashedWords, "hashed-words-384", "doc_id")
    top = F.round(F.array_max("embedding").cast("double"), 6)
    return made.select("doc_id", F.size("embedding").alias("dims"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("buckets"), top.alias("top")).filter("buckets > 0")


def _lists(spark, d, parts=None):
    """The candidates of both searches, of documents in force on each question's day."""
    docs, index, questions, terms = parts or _parts(spark, d)
    words = keyword.search(questions, terms, index, TODAY, 50, newest_first=False)
    days = questions.select("qid", "question", F.unix_date("as_of").alias("as_of"))
    near = folders.written(wordblocks.nearest_documents(days, index, 50, windows.in_force(windows.day(TODAY)), ("as_of",)), "near")
    return docs, words.select("qid", F.col("doc_id").alias("id"), F.lit("keyword").alias("list"), "rank").union(near.select("qid", "id", F.lit("vector").alias("list"), "rank"))


_LISTS = {
    "dv": _EMBED.format(id="doc_id", table="postings"),
    "asked": "select qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from questions",
    "qv": _EMBED.format(id="qid", table="asked"),
    "cos": "select qv.id as qid, dv.id, round(sum(qv.value * dv.value), 6) as cosine from qv join dv using (bucket) group by all",
    "lists": f"""
      select qid, doc_id as id, 'keyword' as list, row_number() over (partition by qid order by score desc, doc_id) as rank
      from scored join docs using (doc_id) join questions using (qid) where {_IN_FORCE} qualify rank <= 50
      union all select qid, id, 'vector', row_number() over (partition by qid order by cosine desc, id) as rank
      from cos join docs on doc_id = id join questions using (qid) where {_IN_FORCE} qualify rank <= 50""",
    "fused": """
      select qid, id, round(sum((case list when 'keyword' then 0.3::double else 1.0::double end) / (60 + rank)), 12) as score,
        max(case when list = 'keyword' then rank end) as keyword_rank, max(case when list = 'vector' then rank end) as vector_rank
      from lists group by qid, id""",
    "top10": """
      select *, row_number() over (partition by qid order by score desc, keyword_rank nulls last, vector_rank nulls last, id) as rank from fused qualify rank <= 10""",
}


@query(sql("select qid, id as doc_id, score, coalesce(keyword_rank, 0) as keyword_rank, coalesce(vector_rank, 0) as vector_rank, rank, title, issued_date from top10 join docs on id = doc_id", "scored", **_LISTS))
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fused search; document fields are joined to the winners only."""
    docs, lists = _lists(spark, d)
    fused = vectors.fuse(lists).withColumnRenamed("id", "doc_id").fillna(0, ["keyword_rank", "vector_rank"])
    return fused.join(docs.select("doc_id", "title", "issued_date"), "doc_id")


@query(sql("select qid, source_id, row_number() over (partition by qid order by best, source_id) as rank from (select qid, doc_type as source_id, min(rank) as best from top10 join docs on id = doc_id group by all)", "scored", **_LISTS))
def rank_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, lists = _lists(spark, d)
    hits = vectors.fuse(lists).join(docs.select(F.col("doc_id").alias("id"), F.col("doc_type").alias("source_id")), "id")
    return vectors.rank_documents(hits)


_WEB = {
    "w": "select qid, regexp_extract_all(lower(question), '[a-z0-9]+') as t from questions",
    "wt": f"""select qid, kind, part, choice, spot, term, {stem("term")} as stem from (
        select qid, 'must' as kind, 0 as part, 0 as choice, 0 as spot, t[1] as term from w union all select qid, 'must', 1, 1, 0, t[2] from w union all select qid, 'must', 1, 2, 0, t[5] from w
        union all select qid, 'must', 2, 3, 0, t[3] from w union all select qid, 'must', 2, 3, 1, t[4] from w union all select qid, 'not', 3, 4, 0, t[6] from w
      ) where term not in {STOP}""",
    "wv": f"select term as found, {stem('term')} as stem from (select distinct term from postings)",
    "wh": "select distinct qid, kind, part, choice, spot, doc_id, pos - spot as start from wt join wv using (stem) join postings p on p.term = found",
    "ws": "select qid, choice, count(*) as n from wt group by all",
    "ww": "select distinct qid, kind, part, doc_id from (select qid, kind, part, choice, doc_id, start, count(distinct spot) as m from wh group by all) join ws using (qid, choice) where m = n",
    "wn": "select qid, count(distinct part) as parts from wt where kind = 'must' group by qid",
}


@query(
    sql(
        """select f.qid, f.doc_id from (select qid, doc_id, count(*) as m from ww where kind = 'must' group by all) f join wn using (qid)
        where m = parts and not exists (select 1 from ww x where x.kind = 'not' and x.qid = f.qid and x.doc_id = f.doc_id)""",
        "questions", "postings", **_WEB,
    )
)
def websearch_all(spark: SparkSession, d: str) -> DataFrame:
    """A required word, one of two words, a phrase and an excluded word of each question."""
    index = folders.written(wordblocks.word_index(corpus.documents(spark, d)), "words")
    t = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0))
    queries = corpus.questions(spark, d).select("qid", F.concat(t[0], F.lit(" "), t[1], F.lit(" or "), t[4], F.lit(' "'), t[2], F.lit(" "), t[3], F.lit('" -'), t[5]).alias("query"))
    parsed = folders.written(keyword.parse_web_query(queries), "parsed")
    terms = folders.written(keyword.web_terms(parsed, wordblocks.vocabulary(index)), "terms")
    return wordblocks.web_matches(terms, parsed, index).select("qid", F.col("id").alias("doc_id"))


_SNIPPETS = {
    "top": _TOP_DOCS,
    "sw": r"select qid, doc_id, rank, unnest(w) as word, unnest(range(len(w))) as i from (select *, string_split(trim(regexp_replace(text, '[\s\x{00a0}\x0b]+', ' ', 'g')), ' ') as w from top join documents using (doc_id))",
    "sk": "select distinct qid, term, stem from terms",
    "sh": "select qid, doc_id, i, stem from (select qid, doc_id, i, unnest(regexp_extract_all(lower(word), '[a-z0-9]+')) as term from sw) join sk using (qid, term)",
    "sn": "select qid, doc_id, rank, count(*) as n from sw group by all",
    "sc": "select x.qid, x.doc_id, x.i as a, max(y.i) as b, count(distinct y.stem) as stems, count(distinct y.i) as hits from (select distinct qid, doc_id, i from sh) x join sh y on y.qid = x.qid and y.doc_id = x.doc_id and y.i between x.i and x.i + 29 group by all",
    "sf": "select *, greatest(0, least(a - (29 - (b - a)) // 2, n - 30)) as low from (select *, row_number() over (partition by qid, doc_id order by stems desc, hits desc, b - a, a) as k from sc) join sn using (qid, doc_id) where k = 1",
    "sr": "select sh.*, sh.i >= low + 30 as behind, low, n from sh join sf using (qid, doc_id) where sh.i < low or sh.i >= low + 30",
    "sd": "select x.qid, x.doc_id, x.i as a, x.behind, x.low as f, x.n, max(y.i) as b, count(distinct y.stem) as stems, count(distinct y.i) as hits from (select distinct qid, doc_id, i, behind, low, n from sr) x join sr y on y.qid = x.qid and y.doc_id = x.doc_id and y.behind = x.behind and y.i between x.i and x.i + 29 group by all",
    "sg": "select *, case when behind then greatest(f + 30, least(a - (29 - (b - a)) // 2, n - 30)) else greatest(0, least(a - (29 - (b - a)) // 2, f - 30)) end as low, case when behind then n else f end as high from (select *, row_number() over (partition by qid, doc_id order by stems desc, hits desc, b - a, a) as k from sd) where k = 1",
    "sp": "select qid, doc_id, low, least(low + 30, n) as high from sf union all select qid, doc_id, low, least(low + 30, high) from sg",
    "sm": "select sw.qid, sw.doc_id, i, case when exists (select 1 from sh where sh.qid = sw.qid and sh.doc_id = sw.doc_id and sh.i = sw.i) then '«' || word || '»' else word end as word from sw",
    "ss": "select sm.qid, sm.doc_id, low, string_agg(word, ' ' order by i) as shown from sm join sp on sp.qid = sm.qid and sp.doc_id = sm.doc_id and i >= low and i < high group by all",
    "so": "select qid, doc_id, string_agg(shown, ' … ' order by low) as snippet from ss group by all",
}


@query(sql("select qid, doc_id, rank, coalesce(snippet, '') as snippet from top left join so using (qid, doc_id)", "scored", **_SNIPPETS))
def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs, index, questions, terms = _parts(spark, d)
    return keyword.snippets(keyword.search(questions, terms, index, TODAY), docs, terms)


@query(sql("select qid, id as doc_id, title, issued_date, 'https://www.rbi.org.in/Scripts/NotificationUser.aspx?Id=' || source_id || '&Mode=0' as url, rank from top20 join docs on id = doc_id where rank <= 20", "scored", **_LISTS,
    top20="select *, row_number() over (partition by qid order by score desc, keyword_rank nulls last, vector_rank nulls last, id) as rank from fused"))
def passage_results(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits with their document's fields; 50 were asked for, 20 is the most that is shown."""
    docs, lists = _lists(spark, d)
    return vectors.passage_results(lists, docs, 50)


_PLURAL = {
    "pw": f"select distinct qid, {stem('term')} as stem from (select qid, unnest(regexp_extract_all(regexp_replace(lower(question), '([a-z]{{4,}})', '\\1s', 'g'), '[a-z0-9]+')) as term from questions) where term not in {STOP}",
    "pt": "select qid, term from pw join vocab using (stem)",
    "ph": "select t.qid, p.doc_id, p.pos, p.weight, p.pos - lag(p.pos) over (partition by t.qid, p.doc_id order by p.pos) as gap from pt t join postings p using (term)",
    "pscored": "select h.qid, h.doc_id, round(sum(weight) / ln(1 + any_value(len(a) + len(b))) * (case when count(*) > 1 then sum(1.0 / gap) / count(*) else 1 end), 9) as score from ph h join tokens using (doc_id) group by h.qid, h.doc_id",
}


@query(sql(_TOP_DOCS.replace("from scored", "from pscored"), "terms", **_PLURAL))
def keyword_search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The keyword search with every longer word of the questions in the plural."""
    index = folders.written(keyword.search_index(corpus.documents(spark, d)), "words")
    questions = corpus.questions(spark, d).withColumn("question", F.regexp_replace(F.lower("question"), "([a-z]{4,})", "$1s"))
    terms = folders.written(keyword.matching_terms(keyword.question_words(questions), wordblocks.vocabulary(index)), "terms")
    return keyword.search(questions, terms, index, TODAY)
