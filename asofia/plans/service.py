"""Queries on answers, their cache, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofia.operators import alerts, answers, cache, embedding, graph
from asofia.plans.registry import registry
from asofia.plans.views import sql
from asofia.sources import corpus
from asofia.sources.folders import written

QUERIES, ORACLE, query = registry()


# --- answers: three documents per question stand for its passages, and a reply quotes them ---


def _passages(spark, d):
    docs = corpus.documents(spark, d)
    questions = corpus.questions(spark, d)
    hits = questions.join(F.broadcast(docs.agg((F.max("doc_id") + 1).alias("n")))).withColumn("rank", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    hits = hits.select("qid", "as_of", F.col("rank").cast("long").alias("rank"), ((F.col("qid") * 31 + F.col("rank") * 17) % F.col("n")).alias("doc_id"))
    hits = hits.join(docs.select("doc_id", "text"), "doc_id").withColumn("char_start", F.col("doc_id") * 10)
    return questions, answers.label_passages(hits, docs)


_LABELLED = {
    "hits": "select qid, as_of, r as place, (qid * 31 + r * 17) % (select max(doc_id) + 1 from documents) as doc_id from questions, range(1, 4) t(r)",
    "labelled": """select h.qid, h.as_of, place, 'P' || place as label, d.doc_id, source_id, title, issued_date, text, d.doc_id * 10 as char_start,
      coalesce(valid_from <= as_of, true) and coalesce(valid_to > as_of, true) as in_force from hits h join docs d using (doc_id)""",
}


@query(sql("select qid, place, label, doc_id, title, issued_date, in_force from labelled", "docs", "questions", **_LABELLED))
def passage_labels(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)[1].select("qid", "place", "label", "doc_id", "title", "issued_date", "in_force")


@query(
    sql(
        """select qid, 'Passages:' || chr(10) || chr(10) || string_agg('[' || label || '] ' || title || ' | issued ' || issued_date || ' | ' || case when in_force then 'in force' else 'not in force on the date asked' end || chr(10) || substr(text, 1, 1500), chr(10) || chr(10) order by place)
        || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || 'The question is about the rules in force on ' || any_value(q.as_of) || '.' as prompt
        from labelled l join questions q using (qid) group by qid""",
        "docs", "questions", **_LABELLED,
    )
)
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    questions, passages = _passages(spark, d)
    return answers.prompts(passages, questions, answers.GRADE_TEXT)


@query(
    sql(
        """select qid, 'Passages:' || chr(10) || chr(10) || string_agg('[' || label || '] ' || title || ' | Part ' || place || ' | issued ' || issued_date || ' | ' || case when in_force then 'in force' else 'not in force on the date asked' end || chr(10) || text, chr(10) || chr(10) order by place)
        || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || 'The question is about the rules in force on ' || any_value(q.as_of) || '.' as prompt
        from labelled l join questions q using (qid) group by qid""",
        "docs", "questions", **_LABELLED,
    )
)
def prompt_full(spark: SparkSession, d: str) -> DataFrame:
    """The answering prompt: whole passages with their headings."""
    questions, passages = _passages(spark, d)
    return answers.prompts(passages.withColumn("heading", F.concat(F.lit("Part "), "place")), questions)


def _replies(spark, d):
    """Replies of four kinds: quoting (in prose around the JSON), abstaining, unreadable, citing what wasn't shown."""
    questions, passages = _passages(spark, d)
    first = passages.groupBy("qid").agg(F.min_by("text", "place").alias("text"))
    cite = lambda p, q: F.array(F.struct(F.lit(p).alias("passage"), q.alias("quote")))
    s = lambda words, c: F.struct(F.lit(words).alias("text"), c.alias("citations"))
    quote, invented = F.substring("text", 3, 60), F.lit("This quote was invented by the model")
    good = F.array(s("The first <claim>.", cite("[P1]", quote)), s("The second.", cite("P2", invented)), s("  ", cite("P1", quote)), s("Again the first.", F.concat(cite("P9", quote), cite("P1", quote))))
    body = lambda abstained, sentences: F.to_json(F.struct(F.lit(abstained).alias("abstained"), sentences.alias("sentences")))
    kind = F.col("qid") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("Here it is: "), body(False, good), F.lit(" - done"))).when(kind == 1, F.lit('```{"abstained": true}```'))
        .when(kind == 2, F.lit("No answer")).otherwise(body(False, F.array(s("Unseen.", cite("P7", quote)))))
    )
    return questions, passages, first.select("qid", reply.alias("reply"))


@query("select item_id as qid, item_id % 4 <> 2 as valid, item_id % 4 = 1 as abstained, (case item_id % 4 when 0 then 4 when 3 then 1 else 0 end)::bigint as sentences from benchmark")
def reply_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.decode(_replies(spark, d)[2])
    return rows.select("qid", "valid", "abstained", F.size("sentences").cast("long").alias("sentences"))


_CITED = {
    "cited": """select l.qid, s as sentence, w as words, p as place, lab as label, case when lab = 'P2' then 'This quote was invented by the model' else trim(substr(f.text, 3, 60), ' ') end as quote
      from (select * from labelled where place = 1) l join (values (0, 0, 'The first <claim>.', 0, 'P1'), (0, 1, 'The second.', 0, 'P2'), (0, 3, 'Again the first.', 0, 'P9'), (0, 3, 'Again the first.', 1, 'P1'), (3, 0, 'Unseen.', 0, 'P7')) v(k, s, w, p, lab)
      on qid % 4 = k join labelled f on f.qid = l.qid and f.place = 1""",
    "checked": """select c.*, l.text is not null and length(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) >= 12 and contains(l.text, quote) as verified, l.char_start + instr(l.text, quote) - 1 as a
      from cited c left join labelled l on l.qid = c.qid and l.label = c.label""",
}


@query(sql("select qid, sentence, place, label, quote, verified, coalesce(case when verified then a end, -1) as span_start, coalesce(case when verified then a + length(quote) end, -1) as span_stop from checked", "docs", "questions", **_LABELLED, **_CITED))
def verify_sentences(spark: SparkSession, d: str) -> DataFrame:
    _, passages, replies = _replies(spark, d)
    rows = answers.verify(answers.decode(replies), passages)
    return rows.select("qid", F.col("sentence").cast("long").alias("sentence"), F.col("place").cast("long").alias("place"), "label", "quote", "verified", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("span_start", "span_stop")))


def _answered(spark, d):
    questions, passages, replies = _replies(spark, d)
    decoded = answers.decode(replies)
    return questions, passages, decoded, answers.verify(decoded, passages)


@query(
    sql(
        """select qid, note = 'answered' as answered, note, case when note = 'answered' then 'The first <claim>. Again the first.' else '' end as answer from (
        select q.qid, case when q.qid % 4 = 2 then 'invalid reply' when q.qid % 4 = 1 then 'abstained' when not coalesce(any_v, false) then 'nothing verified' else 'answered' end as note
        from questions q left join (select qid, bool_or(verified) as any_v from checked group by qid) using (qid))""",
        "docs", "questions", **_LABELLED, **_CITED,
    )
)
def answer_outcome(spark: SparkSession, d: str) -> DataFrame:
    questions, passages, decoded, verified = _answered(spark, d)
    return answers.outcomes(decoded, verified, questions, passages).select("qid", "answered", "note", "answer")


@query(sql("select qid, label, 1 as number, any_value(quote) as quote from checked where verified group by qid, label", "docs", "questions", **_LABELLED, **_CITED))
def source_numbers(spark: SparkSession, d: str) -> DataFrame:
    return answers.number_sources(_answered(spark, d)[3])[0].select("qid", "label", "number", "quote")


@query(sql("select distinct qid, sentence, replace(replace(words, '<', '&lt;'), '>', '&gt;') || ' [1]' as line from checked where verified", "docs", "questions", **_LABELLED, **_CITED))
def answer_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.number_sources(_answered(spark, d)[3])[1]
    return rows.select("qid", F.col("sentence").cast("long").alias("sentence"), "line")


@query(
    sql(
        """select doc_id, case when a > 0 then '…' else '' end || substr(text, a + 1, b - a) || case when b < length(text) then '…' else '' end as excerpt
        from (select doc_id, text, greatest(s - 700, 0)::bigint as a, least(s + 60 + 700, length(text))::bigint as b from (select *, (doc_id * 37) % greatest(length(text), 1) as s from documents))"""
    )
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("doc_id") * 37) % F.greatest(F.length("text"), F.lit(1))
    return corpus.table(spark, d, "documents").withColumn("s", start).select("doc_id", answers.excerpt(F.col("text"), F.col("s"), F.col("s") + 60).alias("excerpt"))


_GRADES = {"graded": "select *, place = 1 + qid % 3 and qid % 5 > 0 as named from labelled", "anyn": "select qid, bool_or(named) as found from graded group by qid"}


def _grades(spark, d):
    questions, passages = _passages(spark, d)
    label = F.concat(F.lit("[\"P"), 1 + F.col("qid") % 3, F.lit("\"]"))
    reply = F.when(F.col("qid") % 5 == 0, F.lit("?")).otherwise(F.concat(F.lit('{"relevant": '), label, F.lit(', "answerable": '), (F.col("qid") % 2 == 0).cast("string"), F.when(F.col("qid") % 3 == 0, ', "better_query": "other words"').otherwise(""), F.lit("}")))
    return questions, *answers.grade(questions.select("qid", reply.alias("reply")), passages)


@query(sql("select qid, doc_id, 'P' || row_number() over (partition by qid order by place) as label from graded join anyn using (qid) where named or not found", "docs", "questions", **_LABELLED, **_GRADES))
def grade_passages(spark: SparkSession, d: str) -> DataFrame:
    return answers.relabelled(_grades(spark, d)[1]).select("qid", "doc_id", "label")


@query("select item_id as qid, case when item_id % 5 > 0 and item_id % 2 = 0 then 'generate' when item_id % 5 > 0 and item_id % 3 = 0 and item_id % 4 < 2 then 'rewrite' else 'abstain' end as step from benchmark")
def grade_route(spark: SparkSession, d: str) -> DataFrame:
    state = _grades(spark, d)[2].withColumn("rewrites", (F.col("qid") % 4).cast("int"))
    return answers.route(state).select("qid", "step")


@query("select item_id as qid, 'other words' as question, (item_id % 4 + 1)::bigint as rewrites, 'rewrite: other words' as trace from benchmark where item_id % 5 > 0 and item_id % 2 = 1 and item_id % 3 = 0 and item_id % 4 < 2")
def rewrite_round(spark: SparkSession, d: str) -> DataFrame:
    state = _grades(spark, d)[2].withColumn("rewrites", F.col("qid") % 4).withColumn("trace", F.array().cast("array<string>")).withColumn("question", F.lit("first words"))
    return answers.rewrite(answers.route(state)).select("qid", "question", "rewrites", F.array_join("trace", ";").alias("trace"))


@query("select doc_id, item_id, instr(d.text, b.text) - 1 as start from documents d join benchmark b on b.text <> '' and contains(d.text, b.text)")
def quote_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a whole benchmark item, and where."""
    items = corpus.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return answers.containing(corpus.table(spark, d, "documents"), items, "doc_id")


def _quotes(spark, d):
    """Every text with a quote of its own in which a letter is changed; texts too short for one have a short quote."""
    quote = F.concat(F.substring("text", 21, 30), F.lit("x"), F.substring("text", 52, 40))
    return corpus.table(spark, d, "documents").select("doc_id", quote.alias("quote"), "text")


@query()
def quote_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with letters changed, found again in their documents."""
    return answers.locate(_quotes(spark, d)).select("doc_id", "score", "start")


_FULL = "((1::hugeint << q_length) - 1)"
_LCS = f"q_length - bit_count(list_reduce(list_prepend({_FULL}, masks[low + 1 : high]), lambda v, m: (v + (v & m)) | (v & ({_FULL} - m))) & {_FULL})"
_ALIGNED = {
    "quotes": r"""select doc_id, text, quote, trim(regexp_replace(replace(replace(replace(quote, '“', '"'), '”', '"'), '’', chr(39)), '[\s\x{0b}\x{85}\p{Z}]+', ' ', 'g'), ' ') as q
      from (select doc_id, text, substr(text, 21, 30) || 'x' || substr(text, 52, 40) as quote from documents where length(text) >= 92)""",
    "easy": "select *, length(q) as q_length, contains(text, quote) or contains(text, q) as literal from quotes where length(q) >= 12",
    # a letter's mask has a bit for each of its places in the quote; a bit of the row that turns to zero is a letter more in common
    "letters": "select doc_id, letter, sum(1::hugeint << i)::hugeint as mask from (select doc_id, unnest(string_split(q, '')) as letter, unnest(range(q_length)) as i from easy where not literal) group by all",
    "own": f"""select *, {_LCS} as common from (select doc_id, q_length, list(coalesce(mask, 0::hugeint) order by i) as masks, 0 as low, q_length as high from (
      select doc_id, q_length, unnest(string_split(substr(text, 21, q_length), '')) as letter, unnest(range(q_length)) as i from easy where not literal) left join letters using (doc_id, letter) group by all)""",
    "hard": "select * from easy where doc_id in (select doc_id from own where 100 * common < 90 * q_length)",
    "placed": """select doc_id, q_length, list(coalesce(mask, 0::hugeint) order by i) as masks from (
      select doc_id, q_length, unnest(string_split(text, '')) as letter, unnest(range(length(text))) as i from hard) left join letters using (doc_id, letter) group by all""",
    "stretches": "select doc_id, q_length, masks, greatest(b, 0) as low, least(b + q_length, len(masks)) as high from (select *, unnest(range(1 - q_length, len(masks))) as b from placed)",
    "aligned": f"select doc_id, max(200.0 * ({_LCS}) / (q_length + high - low)) as score from stretches group by doc_id",
}


@query(
    sql(
        """select d.doc_id, case when length(d.text) >= 92 then q is not null and (literal or coalesce(score >= 90, true)) end as found
        from documents d left join easy using (doc_id) left join aligned using (doc_id)""",
        **_ALIGNED,
    )
)
def quote_fuzzy_found(spark: SparkSession, d: str) -> DataFrame:
    """Whether each such quote is found well enough; null for texts too short to have all of it."""
    rows = answers.locate(_quotes(spark, d))
    return rows.select("doc_id", F.when(F.length("text") >= 92, F.col("score") >= answers.VERIFIED).alias("found"))


@query(sql("select qid, sentence, count(*) as n, min(source_id) as source_id from checked join labelled using (qid, label) where verified group by qid, sentence", "docs", "questions", **_LABELLED, **_CITED))
def verified_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.verified_view(_answered(spark, d)[3], corpus.documents(spark, d))
    return rows.select("qid", F.col("sentence").cast("long").alias("sentence"), F.size("citations").cast("long").alias("n"), F.col("citations")[0]["source_id"].alias("source_id"))


@query(sql("select distinct qid, l.doc_id, title, issued_date, coalesce((select count(*) from edges e join docs x on x.doc_id = e.src where e.dst = l.doc_id and e.type = 'amends'), 0) as amended_by from checked join labelled l using (qid, label) where verified", "docs", "questions", "edges", **_LABELLED, **_CITED))
def source_cards(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.documents(spark, d)
    rows = answers.source_cards(_answered(spark, d)[3], docs, graph.timeline(corpus.relations(spark, d), docs, corpus.relation_tasks(spark, d, 2)))
    return rows.select("qid", "doc_id", "title", "issued_date", F.coalesce(F.size("amended_by"), F.lit(0)).cast("long").alias("amended_by"))


# --- cache: the user's turns are questions, those of every other conversation are kept ---


def _asked(spark, d):
    version = cache.corpus_version(corpus.documents(spark, d))
    rows = corpus.table(spark, d, "conversations").filter("role = 'user'").join(F.broadcast(version))
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 2).cast("int")).alias("as_of"), "version", "conv_id")
    return rows.withColumn("key_hash", cache.key(F.col("question"), F.col("as_of"), F.col("version")))


_ASKED = {
    "v": "select count(*) || ':' || strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as version from docs",
    "asked": """select conv_id, conv_id * 1000 + turn as qid, text as question, date '2026-01-01' + cast(conv_id % 2 as integer) as as_of, version,
      sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ?.!') || '|' || (date '2026-01-01' + cast(conv_id % 2 as integer)) || '|' || version) as key_hash from conversations, v where role = 'user'""",
    "kept": "select key_hash, min(qid) as first from asked where conv_id % 2 = 0 group by key_hash",
}


@query(sql("select * from v", "docs", v=_ASKED["v"]))
def corpus_version(spark: SparkSession, d: str) -> DataFrame:
    return cache.corpus_version(corpus.documents(spark, d))


def _kept(rows):
    return rows.filter("conv_id % 2 = 0").groupBy("key_hash").agg(F.min("qid").alias("first")).select("key_hash", F.concat(F.lit("answer "), "first").alias("answer_json"))


@query(sql("select qid, coalesce('answer ' || first, '-') as answer_json from asked left join kept using (key_hash)", "docs", **_ASKED))
def cache_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d)
    return cache.exact(rows.select("qid", "key_hash"), _kept(rows)).select("qid", F.coalesce("answer_json", F.lit("-")).alias("answer_json"))


@query(sql("select key_hash, 'answer ' || first as answer_json from kept union all select key_hash, 'new ' || min(qid) from asked where key_hash not in (select key_hash from kept) group by key_hash", "docs", **_ASKED))
def cache_insert(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d)
    return cache.insert(_kept(rows), rows.select("key_hash", F.concat(F.lit("new "), "qid").alias("answer_json"), F.col("qid").alias("seq")))


@query(
    """with q as (select vec_id as qid, embedding, vec_id % 3 as day from embeddings where vec_id % 10 = 0), k as (select * from embeddings where vec_id % 10 > 0)
    select qid, vec_id, distance from (
      select qid, vec_id, round(1 - list_sum(list_transform(list_zip(q.embedding, k.embedding), lambda z: z[1]::double * z[2]::double)), 6) as distance from q join k on k.vec_id % 3 = day
    ) where distance <= 0.6 qualify row_number() over (partition by qid order by distance, 'k' || lpad(vec_id::varchar, 9, '0')) = 1"""
)
def cache_semantic(spark: SparkSession, d: str) -> DataFrame:
    table = corpus.table(spark, d, "embeddings").withColumn("as_of", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("vec_id") % 3).cast("int"))).withColumn("version", F.lit("-"))
    asked = table.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "embedding", "as_of", "version", F.concat(F.lit("q"), "vec_id").alias("key_hash"))
    kept = table.filter("vec_id % 10 > 0").select(F.concat(F.lit("k"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("key_hash"), "embedding", "as_of", "version", F.col("vec_id").cast("string").alias("answer_json"))
    return cache.semantic(asked, kept, 0.6).select("qid", F.col("answer_json").cast("long").alias("vec_id"), "distance")


@query(
    sql(
        "select qid, key_hash, distance from near qualify row_number() over (partition by qid order by distance, key_hash) = 1",
        words="select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents",
        counted="select doc_id, ('0x' || substr(md5(term), 1, 8))::bigint % 384 as bucket, count(*)::double as n from words group by all",
        vecs="select doc_id, bucket, (n / sqrt(sum(n * n) over (partition by doc_id)))::float::double as value from counted",
        near="select q.doc_id as qid, lpad(k.doc_id::varchar, 12, '0') as key_hash, round(1 - sum(q.value * k.value), 6) as distance from vecs q join vecs k on q.doc_id % 2 = 1 and k.doc_id % 2 = 0 and q.bucket = k.bucket group by all having distance <= 0.05",
    )
)
def cache_near_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with odd ids as questions, the others as kept ones: the nearest in words, at the cache's own distance."""
    docs = corpus.table(spark, d, "documents").select("doc_id", "text", F.lit("2026-01-01").cast("date").alias("as_of"), F.lit("-").alias("version"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key_hash"))
    made = written(docs.join(embedding.embedded(docs, embedding.HashedWords, "hashed-words-384", "doc_id", "text"), "doc_id").drop("text"), "made")
    kept = made.filter("doc_id % 2 = 0").withColumn("answer_json", F.col("key_hash"))
    return cache.semantic(made.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "qid"), kept).select("qid", F.col("answer_json").alias("key_hash"), "distance")


# --- alerts: customers follow documents and topics ---


def _follows(spark, d):
    rows = corpus.table(spark, d, "customer").join(F.broadcast(corpus.table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("n"))))
    arg = F.when(F.col("c_custkey") % 2 == 0, ((F.col("c_custkey") * 7) % (F.col("n") * 2)).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("c_custkey") % len(_TOPICS)).cast("int") + 1))
    return rows.select(F.col("c_custkey").alias("chat_id"), arg.alias("arg"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, c_custkey % 400)").alias("created_at"))


_TOPICS = ["The  and", "Tion ", "en der", "ab", "Is THE in"]
FOLLOWS = {
    "requests": f"""select c_custkey as chat_id, case when c_custkey % 2 = 0 then ((c_custkey * 7) % (2 * (select max(doc_id) + 1 from documents)))::varchar else [{", ".join(f"'{t}'" for t in _TOPICS)}][c_custkey % {len(_TOPICS)} + 1] end as arg,
      timestamp '2024-01-01' + to_hours(c_custkey % 400) as created_at from customer""",
    "parsed": r"""select chat_id, created_at, case when regexp_full_match(t, '\d{3,6}') then 'doc' else 'topic' end as kind, case when regexp_full_match(t, '\d{3,6}') then t else lower(t) end as target
      from (select *, trim(regexp_replace(arg, '\s+', ' ', 'g')) as t from requests)""",
    "good": "select * from parsed where length(target) >= 3 and (kind = 'topic' or exists (select 1 from documents where doc_id::varchar = target))",
    "da": "select chat_id as follow_id, e.src as doc_id, e.type from good g join edges e on e.dst::varchar = g.target and e.type <> 'refers' join docs x on x.doc_id = e.src and x.created_at > g.created_at where kind = 'doc'",
    "ta": "select chat_id as follow_id, x.doc_id from good g join docs x on x.created_at > g.created_at and list_bool_and(list_transform(string_split(target, ' '), lambda w: contains(lower(x.title), w))) where kind = 'topic'",
}


def good_follows(spark, d):
    docs = corpus.documents(spark, d)
    rows = alerts.parse_targets(_follows(spark, d)).select(F.col("chat_id").alias("follow_id"), "chat_id", "kind", "target", "created_at")
    known = docs.select(F.col("source_id").alias("target"), F.lit("doc").alias("kind"))
    topics = rows.filter("kind = 'topic' and length(target) >= 3")
    return docs, topics.unionByName(rows.join(known, ["kind", "target"], "left_semi").select(topics.columns))


@query(sql("select distinct chat_id, kind, target from good where not (chat_id % 10 = 0)", "docs", "edges", **FOLLOWS))
def follow_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New follows: every tenth customer has followed before."""
    requests, docs = _follows(spark, d), corpus.documents(spark, d)
    stored = alerts.parse_targets(requests.filter("chat_id % 10 = 0"))
    return alerts.follow(requests, stored, docs)[0]


@query(sql("select chat_id, kind, target from parsed except select chat_id, kind, target from good", "docs", "edges", **FOLLOWS))
def follow_rejected(spark: SparkSession, d: str) -> DataFrame:
    stored = alerts.parse_targets(_follows(spark, d).limit(0))
    return alerts.follow(_follows(spark, d), stored, corpus.documents(spark, d))[1].select("chat_id", "kind", "target")


@query(sql("select chat_id, kind, target, row_number() over (partition by chat_id order by chat_id) as place from good where chat_id % 3 = 0 and not (kind = 'doc' and chat_id % 4 = 0)", "docs", "edges", **FOLLOWS))
def follow_list(spark: SparkSession, d: str) -> DataFrame:
    """What every third customer follows after those with a number divisible by four have left their documents."""
    stored = good_follows(spark, d)[1]
    stays, _ = alerts.unfollow(stored, stored.filter("kind = 'doc' and chat_id % 4 = 0"))
    return alerts.following(stays, stored.filter("chat_id % 3 = 0")).select("chat_id", "kind", "target", "place")


@query(sql("select kind, count(*) as removed from good where chat_id % 4 = 0 group by kind", "docs", "edges", **FOLLOWS))
def unfollow(spark: SparkSession, d: str) -> DataFrame:
    """Follows that were removed, counted by kind."""
    stored = good_follows(spark, d)[1]
    return alerts.unfollow(stored, stored.filter("chat_id % 4 = 0"))[1].groupBy("kind").agg(F.count(F.lit(1)).alias("removed"))


@query(sql("select * from da", "docs", "edges", **FOLLOWS))
def alerts_doc(spark: SparkSession, d: str) -> DataFrame:
    docs, follows = good_follows(spark, d)
    return alerts.document_alerts(follows, corpus.relations(spark, d), docs)


@query(sql("select * from ta", "docs", "edges", **FOLLOWS))
def alerts_topic(spark: SparkSession, d: str) -> DataFrame:
    docs, follows = good_follows(spark, d)
    return alerts.topic_alerts(follows, docs)


_ONCE = """select follow_id, doc_id, type, row_number() over (partition by follow_id order by issued_date, doc_id) as place from (select follow_id, doc_id, min(type) as type from da group by follow_id, doc_id) join docs using (doc_id) where (follow_id + doc_id) % 3 > 0"""


def _once(spark, d):
    docs, follows = good_follows(spark, d)
    rows = alerts.document_alerts(follows, corpus.relations(spark, d), docs)
    ledger = rows.filter("(follow_id + doc_id) % 3 = 0").select("follow_id", "doc_id").distinct()
    return docs, ledger, alerts.once(rows, ledger, docs)


@query(sql(_ONCE, "docs", "edges", **FOLLOWS))
def alerts_once(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d)[2].select("follow_id", "doc_id", "type", "place")


@query(sql("select follow_id, doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || ' (' || strftime(issued_date, '%d %b %Y') || ') ' || type as message from o join docs using (doc_id)", "docs", "edges", **FOLLOWS, o=_ONCE))
def alerts_render(spark: SparkSession, d: str) -> DataFrame:
    docs, _, rows = _once(spark, d)
    return alerts.render(rows, docs)


@query(sql("select distinct follow_id, doc_id from da where (follow_id + doc_id) % 3 = 0 or doc_id % 2 = 0", "docs", "edges", **FOLLOWS))
def alerts_delivered(spark: SparkSession, d: str) -> DataFrame:
    _, ledger, rows = _once(spark, d)
    status = rows.select("follow_id", "doc_id", (F.col("doc_id") % 2 == 0).alias("delivered"))
    return alerts.delivered(ledger, rows, status)
