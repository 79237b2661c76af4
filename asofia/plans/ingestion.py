"""Queries on relations, question days and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofia.operators import evaluation, ingest, questions, relations
from asofia.plans.registry import registry
from asofia.plans.views import sql
from asofia.sources import corpus, folders
from asofia.sources.corpus import TODAY

QUERIES, ORACLE, query = registry()


# --- relations: every fifth document's text ends with a paragraph that cites another one ---

_TEMPLATES = [
    "In supersession of circular No. {}, banks shall",
    "The circular, {} , stands withdrawn",
    "Circular {} is amended as below",
    "See {} for details",
    "as communicated vide {} the limits are amended",
    "12 Amended vide circular {} dated today",
    "No year is cited here",
]
_REF = "concat('DOR.SRC.REC.', {0}, '/14.01.', lpad(cast({0} % 1000 as string), 3, '0'), '/20', lpad(cast({0} % 20 as string), 2, '0'), '-', lpad(cast({0} % 20 + 1 as string), 2, '0'))"
_TITLE = "concat('Directions (Subject of group ', {0} % 4, ')', case when {0} % 3 = 0 then ' Amendment' else '' end)"


def _citing(spark, d):
    return _citing_rows(corpus.table(spark, d, "documents"))


def _citing_rows(docs: DataFrame) -> DataFrame:
    last = docs.agg(F.max("doc_id").alias("last"))
    rows = docs.select("doc_id", "text").join(F.broadcast(last)).withColumn("target", (F.col("doc_id") * 7 + 3) % (F.col("last") + 1))
    template = F.element_at(F.array(*map(F.lit, _TEMPLATES)), (F.floor(F.col("doc_id") / 5) % len(_TEMPLATES)).cast("int") + 1)
    cited = F.replace(template, F.lit("{}"), F.expr(_REF.format("target")))
    body = F.concat_ws("\n\n", F.replace("text", F.lit("\n"), F.lit("\n\n")), F.when(F.col("doc_id") % 5 == 0, cited))
    return rows.select(F.col("doc_id").cast("string").alias("source_id"), F.expr(_REF.format("doc_id")).alias("circular_no"), F.expr(_TITLE.format("doc_id")).alias("title"), body.alias("raw_text"))


_N = "(select max(doc_id) + 1 from documents)"


def _duck(expression: str) -> str:
    return expression.replace("as string", "as varchar")


_CITES = {
    "c0": f"""select doc_id, (doc_id * 7 + 3) % {_N} as target, [{", ".join(f"'{t}'" for t in _TEMPLATES)}][doc_id // 5 % {len(_TEMPLATES)} + 1] as template from documents""",
    "cd": f"""select doc_id, target, {_duck(_REF.format("doc_id"))} as circular_no, {_duck(_TITLE.format("doc_id"))} as title, {_duck(_TITLE.format("target"))} as its_title,
      replace(template, '{{}}', {_duck(_REF.format("target"))}) as paragraph, template from c0""",
    "known": "select lower(circular_no) as reference, doc_id from cd",
    "cited": """select * from cd where doc_id % 5 = 0 and template like '%{}%' and target <> doc_id""",
    "facts": r"""select *, regexp_matches(paragraph, '(?i)^\s*\d{0,3}\s*(?:amended|inserted|substituted|deleted|added) vide\b') as footnote,
      case when paragraph ilike '%in supersession of%' then 'supersedes' when paragraph ilike '%stands withdrawn%' then 'repeals'
        when regexp_matches(paragraph, '(?i)\bamend(s|ed|ment)\b') or title ilike '%amendment%' then 'amends' else 'refers' end as stated,
      template like '%communicated vide {}%' as instrument, doc_id % 4 <> target % 4 as apart from cited""",
    "found": """select case when footnote then target else doc_id end::varchar as src, case when footnote then doc_id else target end::varchar as dst,
      case when footnote then 'amends' when instrument or (stated = 'amends' and apart) then 'refers' else stated end as type, 'regex' as method,
      case when footnote then 0.9 when (instrument or (stated = 'amends' and apart)) and stated <> 'refers' then 0.5
        when stated in ('supersedes', 'repeals') then 0.9 when stated = 'amends' then 0.7 else 0.5 end::double as confidence, paragraph as evidence from facts""",
    "links": f"select doc_id::varchar as source_id, unnest([(doc_id * 7 + 3) % {_N}, (doc_id * 3 + 1) % ({_N} + 5), doc_id]) as target from documents",
    "linked": """select l.source_id as src, l.target::varchar as dst, case when a.title ilike '%amendment%' and a.doc_id % 4 = l.target % 4 then 'amends' else 'refers' end as type, 'link' as method,
      case when a.title ilike '%amendment%' and a.doc_id % 4 = l.target % 4 then 0.9 else 0.5 end::double as confidence, 'link in ' || a.title as evidence
      from (select distinct * from links where source_id <> target::varchar) l join cd a on a.doc_id::varchar = l.source_id join documents b on b.doc_id = l.target""",
    "all_edges": "select * from found union all select * from linked",
    "best": "select * from all_edges qualify row_number() over (partition by src, dst, type order by confidence desc, method, evidence) = 1",
    "merged": "select * from best b where type <> 'refers' or not exists (select 1 from best s where s.src = b.src and s.dst = b.dst and s.type <> 'refers')",
}


def _links(spark, d):
    docs = corpus.table(spark, d, "documents")
    rows = docs.select("doc_id").join(F.broadcast(docs.agg((F.max("doc_id") + 1).alias("n"))))
    targets = F.array((F.col("doc_id") * 7 + 3) % F.col("n"), (F.col("doc_id") * 3 + 1) % (F.col("n") + 5), "doc_id")
    return rows.select(F.col("doc_id").cast("string").alias("source_id"), F.explode(targets.cast("array<string>")).alias("target"))


@query(sql("select lower(circular_no) as reference, doc_id::varchar as target, regexp_extract(circular_no, '[0-9]{4}-[0-9]{2}') as year from cd", **{k: _CITES[k] for k in ("c0", "cd")}))
def ref_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return relations.dictionary(_citing(spark, d))


@query(sql("select * from found", **_CITES))
def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return relations.text_relations(_citing(spark, d))


@query(sql("select * from linked", **_CITES))
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return relations.link_relations(_links(spark, d), _citing(spark, d))


def _merged(spark, d):
    docs = _citing(spark, d)
    return relations.merge(relations.text_relations(docs).unionByName(relations.link_relations(_links(spark, d), docs)))


@query(sql("select * from merged", **_CITES))
def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


_STORED = "select doc_id::varchar as src, (doc_id + 1)::varchar as dst, 'amends' as type, ['manual', 'regex', 'llm', 'link'][doc_id % 4 + 1] as method, 1.0::double as confidence, 'old' as evidence from documents"


@query(sql("select * from stored where method not in ('regex', 'link') union all select * from merged where exists (select 1 from documents where doc_id::varchar = src) and exists (select 1 from documents where doc_id::varchar = dst)", **_CITES, stored=_STORED))
def relation_replace(spark: SparkSession, d: str) -> DataFrame:
    """Automatic edges are replaced, edges that people or models entered stay."""
    docs = corpus.table(spark, d, "documents")
    text = lambda c: c.cast("string")
    method = F.element_at(F.array(*map(F.lit, ("manual", "regex", "llm", "link"))), (F.col("doc_id") % 4).cast("int") + 1)
    stored = docs.select(text(F.col("doc_id")).alias("src"), text(F.col("doc_id") + 1).alias("dst"), F.lit("amends").alias("type"), method.alias("method"), F.lit(1.0).alias("confidence"), F.lit("old").alias("evidence"))
    return relations.replace_edges(stored, _merged(spark, d), docs.select(text(F.col("doc_id")).alias("source_id")))


# --- days in questions: a date phrase is put in front of each benchmark item ---

_PHRASES = [
    ("What held on 1 June 2024?", "2024-06-01"), ("What held as of June 1st, 2021?", "2021-06-01"), ("as on 2024-06-01", "2024-06-01"), ("before 01.06.2024", "2024-05-31"),
    ("rules in March 2024", "2024-03-31"), ("in 2023", "2023-12-31"), ("till 2020", "2019-12-31"), ("during the year 2019", "2019-12-31"), ("on 30 February 2024", None),
    ("March 2024", None), ("in 2031", None), ("in October 2026", "2026-10-04"), ("in 2023-24", None), ("no date", None),
]


@query(
    sql(
        "select item_id as qid, coalesce(day, date '2026-10-04') as as_of, case when item_id % 5 = 0 then 'request' when day is null then 'today' else 'question' end as source from (select item_id, case when item_id % 5 = 0 then date '2020-02-02' else d[item_id % len(d) + 1]::date end as day from benchmark, p)",
        p="select [" + ", ".join("null" if day is None else f"'{day}'" for _, day in _PHRASES) + "] as d",
    )
)
def question_dates(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*(F.lit(p) for p, _ in _PHRASES)), (F.col("item_id") % len(_PHRASES)).cast("int") + 1)
    rows = corpus.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(phrase, F.lit(" "), "text").alias("question"), F.when(F.col("item_id") % 5 == 0, F.lit("2020-02-02").cast("date")).alias("given"))
    return questions.resolve(rows, TODAY).select("qid", "as_of", F.col("as_of_source").alias("source"))


# --- ingest: a stored snapshot (nine of ten documents, some with another text) meets the whole table ---


def snapshots(spark, d):
    docs = corpus.documents(spark, d)
    base = docs.select("doc_id", "source_id", "title", "department", "doc_type", "issued_date", F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("updated_on"), "is_withdrawn", F.col("valid_to").alias("withdrawn_on"), F.lit(None).cast("string").alias("pdf_url"), "text")
    old_text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    old_title = F.when(F.col("doc_id") % 11 == 0, F.concat("title", F.lit("?"))).otherwise(F.col("title"))
    common = lambda df: df.withColumn("listed_date", F.lit(None).cast("date")).withColumn("version_of", F.lit(None).cast("date"))
    stored = common(base.filter("doc_id % 10 <> 0").withColumn("raw_text", old_text).withColumn("title", old_title).withColumn("status", F.lit("ok")))
    status = F.when(F.col("doc_id") % 97 == 1, "missing").otherwise("ok")
    issued = F.when(F.col("doc_id") % 89 == 2, None).otherwise(F.col("issued_date"))
    incoming = common(base.withColumn("raw_text", F.col("text")).withColumn("status", status).withColumn("issued_date", issued).withColumn("seq", F.col("doc_id")))
    return ingest.validity(stored), ingest.validity(incoming)


JUDGED = {
    "inc": "select doc_id, source_id, sha256(text) as h, case when doc_id % 97 = 1 then 'missing' when doc_id % 89 = 2 then 'failed' else 'ok' end as status, title, issued_date, valid_to from docs",
    "st": "select doc_id, source_id, sha256(case when doc_id % 9 = 0 then text || ' old' else text end) as h, case when doc_id % 11 = 0 then title || '?' else title end as title from docs where doc_id % 10 <> 0",
    "own": "select h, min(source_id) as owner from st group by h",
    "cmp": "select inc.*, st.h as old_h, st.title as old_title, owner, st.h is null or st.h <> inc.h as changed from inc left join st using (doc_id) left join own on own.h = inc.h",
    "fst": "select h, min(doc_id) as first from cmp where status = 'ok' and changed group by h",
    "judged": """select doc_id, source_id, changed, cmp.h, case when status <> 'ok' then status when changed and (case when owner is not null then owner <> source_id else doc_id > first end) then 'duplicate'
      when old_h is null then 'new' when changed or title <> old_title then 'updated' else 'unchanged' end as outcome from cmp left join fst on fst.h = cmp.h""",
}


def _outcomes(spark, d):
    stored, incoming = snapshots(spark, d)
    return stored, ingest.outcomes(incoming, stored)


@query(sql("select source_id, outcome from judged", "docs", **JUDGED))
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)[1].select("source_id", "outcome")


@query(sql("select " + ", ".join(f"count(case when outcome = '{o}' then 1 end) as {o}" for o in ingest.OUTCOMES) + " from judged", "docs", **JUDGED))
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.statistics(_outcomes(spark, d)[1])


@query(
    sql(
        """select source_id, h as content_hash, title from st where not exists (select 1 from judged j where j.source_id = st.source_id and outcome in ('new', 'updated'))
        union all select j.source_id, j.h, title from judged j join inc using (doc_id) where outcome in ('new', 'updated')""",
        "docs", **JUDGED,
    )
)
def ingest_merge(spark: SparkSession, d: str) -> DataFrame:
    stored, judged = _outcomes(spark, d)
    return ingest.merged(stored, judged).select("source_id", "content_hash", "title")


@query(sql("select source_id, h as content_hash from judged where outcome = 'duplicate'", "docs", **JUDGED))
def duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)[1].filter("outcome = 'duplicate'").select("source_id", "content_hash")


@query(sql("select source_id, status, issued_date, coalesce(issued_date, date '1900-01-01') as valid_from, coalesce(valid_to, date '1900-01-01') as valid_to, sha256(text) as content_hash from (select source_id, text, valid_to, case when doc_id % 97 = 1 then 'missing' when doc_id % 89 = 2 then 'failed' else 'ok' end as status, case when doc_id % 89 = 2 then null else issued_date end as issued_date from docs)", "docs"))
def validity_derive(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots(spark, d)[1]
    none = F.lit("1900-01-01").cast("date")
    return rows.select("source_id", "status", "issued_date", F.coalesce("valid_from", none).alias("valid_from"), F.coalesce("valid_to", none).alias("valid_to"), "content_hash")


@query(sql("select source_id, doc_id % 3 as ord from st where not exists (select 1 from judged j where j.source_id = st.source_id and outcome = 'updated' and changed)", "docs", **JUDGED))
def chunk_invalidation(spark: SparkSession, d: str) -> DataFrame:
    stored, judged = _outcomes(spark, d)
    return ingest.invalidated(stored.select("source_id", (F.col("doc_id") % 3).alias("ord")), judged)


@query(sql("select st.source_id, case when outcome = 'updated' and not changed then issued_date else date '2000-01-01' end as valid_from from st join judged using (source_id) join docs on docs.source_id = st.source_id", "docs", **JUDGED))
def validity_propagate(spark: SparkSession, d: str) -> DataFrame:
    stored, judged = _outcomes(spark, d)
    chunks = stored.select("source_id", F.lit("2000-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return ingest.propagated(chunks, judged).select("source_id", "valid_from")


@query(sql("select source_id, source_id || '-' || substr(sha256(html), 1, 12) as archived_as from judged join pages on page_id = doc_id where outcome = 'updated'", "docs", **JUDGED))
def archive_history(spark: SparkSession, d: str) -> DataFrame:
    pages = corpus.table(spark, d, "pages").withColumn("source_id", F.col("page_id").cast("string"))
    return ingest.history(_outcomes(spark, d)[1], pages).select("source_id", "archived_as")


_ACTIONS = """select doc_id::varchar as source_id, case when doc_id % 10 = 0 then 'fetch' when stamp is null or (known is not null and stamp <= known) then 'unchanged' else 'refresh' end as action
  from (select doc_id, case when doc_id % 3 > 0 then date '2024-01-01' + cast(doc_id % 50 as integer) end as stamp, case when doc_id % 4 > 0 then date '2024-01-01' + cast(doc_id % 40 as integer) end as known from documents)"""


@query(_ACTIONS)
def refresh_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.table(spark, d, "documents")
    day = lambda n, m: F.when(F.col("doc_id") % m > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % n).cast("int")))
    entries = docs.select(F.col("doc_id").cast("string").alias("source_id"), day(50, 3).alias("updated_on"))
    stored = docs.filter("doc_id % 10 <> 0").select(F.col("doc_id").cast("string").alias("source_id"), day(40, 4).alias("updated_on"))
    return ingest.refresh_actions(entries, stored).select("source_id", "action")


_VERSIONS = """select doc_id, case when length(text) >= 200 then text else v end as raw_text, case when length(text) < 200 and v is null then 'failed' else 'ok' end as status
  from (select d.doc_id, text, (select arg_max(t, (day, hist)) from (select *, row_number() over (order by day desc, hist desc) as k from vs where vs.doc_id = d.doc_id) where k <= 4 and length(t) >= 200) as v from documents d)"""


@query(sql("select doc_id, coalesce(sha256(raw_text), '-') as text_hash, status from (" + _VERSIONS + ")", vs="select d.doc_id, x as hist, date '2020-01-01' + cast(x * (d.doc_id % 7) % 30 as integer) as day, repeat('v' || x || ' ', (d.doc_id * x % 90)::bigint) as t from documents d, range(1, 8) r(x)"))
def version_latest(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus.table(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").alias("source_id"), F.col("text").alias("raw_text"), F.lit("ok").alias("status"))
    versions = docs.select("source_id", "doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("hist_id"))
    versions = versions.select("source_id", "hist_id", F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("hist_id") * (F.col("doc_id") % 7)) % 30).cast("int")).alias("as_of"), F.expr("repeat(concat('v', hist_id, ' '), int(doc_id * hist_id % 90))").alias("version_text"))
    rows = ingest.version_fallback(docs, versions)
    return rows.select("doc_id", F.coalesce(F.sha2("raw_text", 256), F.lit("-")).alias("text_hash"), "status")


@query(sql("select page_id from pages where url ilike '%blog%' and page_id % 4 > 0 and ['Banking', 'Markets', 'Payments'][page_id % 4] ilike '%a%'"))
def listing_filter(spark: SparkSession, d: str) -> DataFrame:
    """Listing rows by title and section; rows without a section drop out."""
    section = F.when(F.col("page_id") % 4 > 0, F.element_at(F.array(*map(F.lit, ("Banking", "Markets", "Payments"))), F.greatest((F.col("page_id") % 4).cast("int"), F.lit(1))))
    rows = corpus.table(spark, d, "pages").select("page_id", F.col("url").alias("title"), section.alias("section"))
    return ingest.select_entries(rows, "BLOG", "a").select("page_id")


@query(sql("select page_id from pages where page_id % 11 not in (1, 2) and not (page_id % 11 = 3 and contains(substr(html, 1, 4000), 'ad 0'))"))
def unblocked_pages(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("page_id") % 11 == 1, 403).when(F.col("page_id") % 11 == 2, 418).when(F.col("page_id") % 11 == 3, 200).otherwise(201)
    return ingest.unblocked(corpus.table(spark, d, "pages").withColumn("status", status), ["ad 0"]).select("page_id")


@query("select doc_id, case when doc_id % 5 = 0 or doc_id % 3 = 1 then 'master_direction' else 'circular' end as doc_type from documents")
def sticky_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of fetched documents: every third was a master direction before, every fifth comes from the index of these."""
    c = F.col("doc_id")
    old = F.when(c % 3 == 1, "master_direction").otherwise("notification")
    return corpus.table(spark, d, "documents").select(c, ingest.sticky_type(old, F.lit("circular"), c % 5 == 0).alias("doc_type"))


@query(sql("select doc_id, case when exists (select 1 from pages where page_id * 2 = doc_id) then 'master_direction' else doc_type end as doc_type from docs", "docs"))
def listed_types(spark: SparkSession, d: str) -> DataFrame:
    """Pages stand for the entries of an index of master directions."""
    listed = corpus.table(spark, d, "pages").select((F.col("page_id") * 2).cast("string").alias("source_id"))
    return ingest.retyped(corpus.documents(spark, d), listed).select("doc_id", "doc_type")


@query(sql("select doc_id, case when doc_id % 4 < 2 or trim(title) = '' then 'listed ' || doc_id else trim(title) end as title from docs", "docs"))
def listed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a title, or with a blank one, take the listing's."""
    c = F.col("doc_id")
    title = F.when(c % 4 == 0, None).when(c % 4 == 1, "  ").otherwise(F.trim("title"))
    return corpus.documents(spark, d).select(c, ingest.title_or_listed(title, F.concat(F.lit("listed "), c)).alias("title"))


_FULL = """select doc_id, case when doc_id % 7 > 0 then issued_date when doc_id % 14 > 0 then issued_date + 5 end as issued, case when doc_id % 2 = 1 then issued_date + 10 end as eff,
  case when doc_id % 3 = 1 then issued_date + 20 end as upd, case when doc_id % 5 = 1 then issued_date + 30 end as ver, valid_to from docs"""


@query(sql("""select doc_id, case when doc_id % 11 = 0 then 'missing' when issued is null then 'failed' else 'ok' end as status, coalesce(issued, date '1900-01-01') as issued_date,
    coalesce(eff, issued, date '1900-01-01') as valid_from, coalesce(valid_to, date '1900-01-01') as valid_to, coalesce(ver, upd, issued, date '1900-01-01') as text_as_of from f""", "docs", f=_FULL))  # fmt: skip
def validity_full(spark: SparkSession, d: str) -> DataFrame:
    """Windows of documents of which some have a commencement, a stamp, an earlier version's text, or no date on the page or anywhere."""
    c, day = F.col("doc_id"), F.col("issued_date")
    rows = corpus.documents(spark, d).select(
        "doc_id", F.col("text").alias("raw_text"), F.when(c % 7 > 0, day).alias("issued_date"), F.when(c % 14 > 0, F.date_add(day, 5)).alias("listed_date"), F.when(c % 2 == 1, F.date_add(day, 10)).alias("effective_from"),
        F.when(c % 3 == 1, F.date_add(day, 20)).alias("updated_on"), F.when(c % 5 == 1, F.date_add(day, 30)).alias("version_of"), F.col("valid_to").alias("withdrawn_on"), F.when(c % 11 == 0, "missing").otherwise("ok").alias("status"),
    )
    none = F.lit("1900-01-01").cast("date")
    return ingest.validity(rows).select("doc_id", "status", *(F.coalesce(x, none).alias(x) for x in ("issued_date", "valid_from", "valid_to", "text_as_of")))


RUN_DAY = "2024-06-15"
_RUN = {
    "st": "select source_id, sha256(case when doc_id % 9 = 0 then text || ' old' else text end) as h from docs where doc_id % 10 <> 0",
    "own": "select h, min(source_id) as owner from st group by h",
    "due": f"""select doc_id, source_id, sha256(text) as h, case when doc_id % 97 = 1 then 'missing' else 'ok' end as status, case when doc_id % 6 = 0 then 'listed ' || doc_id else trim(title) end as title,
      case when doc_id % 5 = 0 or (doc_id % 10 > 0 and doc_type = 'master_direction') then 'master_direction' else 'circular' end as doc_type
      from docs where issued_date >= date '2024-05-01' and issued_date < date '2024-07-01' and (doc_id % 10 = 0 or doc_id % 3 > 0)""",
    "cmp": "select due.*, st.h as old_h, owner, st.h is null or st.h <> due.h as changed from due left join st using (source_id) left join own on own.h = due.h",
    "fst": "select h, min(doc_id) as first from cmp where status = 'ok' and changed group by h",
    "ran": """select source_id, title, doc_type, cmp.h, case when status <> 'ok' then status when changed and (case when owner is not null then owner <> source_id else doc_id > first end) then 'duplicate'
      when old_h is null then 'new' else 'updated' end as outcome from cmp left join fst on fst.h = cmp.h""",
}


def _recent(spark, d):
    c, docs, none = F.col("doc_id"), corpus.documents(spark, d), F.lit(None).cast("date")
    base = docs.select("doc_id", "source_id", F.trim("title").alias("title"), "department", "doc_type", "issued_date", none.alias("effective_from"), F.lit("2024-05-20").cast("date").alias("updated_on"), "is_withdrawn", F.col("valid_to").alias("withdrawn_on"), F.lit(None).cast("string").alias("pdf_url"), "text", none.alias("listed_date"), none.alias("version_of"))
    stored = ingest.validity(base.filter("doc_id % 10 <> 0").withColumn("raw_text", F.when(c % 9 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))).withColumn("status", F.lit("ok")))
    pages = base.withColumn("raw_text", F.col("text")).withColumn("status", F.when(c % 97 == 1, "missing").otherwise("ok")).withColumn("title", F.when(c % 6 == 0, "").otherwise(F.col("title")))
    pages = pages.withColumn("doc_type", F.lit("circular")).withColumn("updated_on", F.lit("2024-06-01").cast("date")).withColumn("seq", c)
    listings = docs.select("source_id", F.concat(F.lit("listed "), c).alias("title"), F.col("issued_date").alias("listed_date"), F.when(c % 3 > 0, F.lit("2024-06-01").cast("date")).alias("updated_on"), (c % 5 == 0).alias("from_index"))
    return stored, *ingest.run_recent(listings, pages, stored, RUN_DAY)


@query(sql("select source_id, outcome, title, doc_type from ran", "docs", **_RUN))
def run_recent(spark: SparkSession, d: str) -> DataFrame:
    """An incremental run over the listings of two months: rows that are due, with fallback titles and types that stick."""
    return _recent(spark, d)[1].select("source_id", "outcome", "title", "doc_type")


@query(sql("select source_id, h as content_hash from st where not exists (select 1 from ran where ran.source_id = st.source_id and outcome in ('new', 'updated')) union all select source_id, h from ran where outcome in ('new', 'updated')", "docs", **_RUN))
def run_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The documents after that run."""
    return _recent(spark, d)[2].select("source_id", "content_hash")


@query("with r as (select unnest(range(lo - 2, hi + 3)) as id from (select min(page_id) as lo, max(page_id) as hi from pages)) select id, row_number() over (order by id desc) as place, exists (select 1 from pages where page_id = id) as known from r")
def id_range(spark: SparkSession, d: str) -> DataFrame:
    """Every id from two below the first page's to two above the last one's, newest first, and whether there is such a page."""
    pages = corpus.table(spark, d, "pages")
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, -5) if low is None else (low, high)
    ids = ingest.id_range(spark, low - 2, high + 2)
    rows = ids.join(pages.select(F.col("page_id").alias("id"), F.lit(True).alias("known")).distinct(), "id", "left")
    return rows.select("id", (F.lit(high + 3) - F.col("id")).alias("place"), F.coalesce("known", F.lit(False)).alias("known"))


@query(sql("""select year(m) as year, month(m) as month, (select count(*) from docs where date_trunc('month', issued_date) = m) as documents
    from (select unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date as m from (select min(issued_date) as lo, max(issued_date) as hi from docs))""", "docs"))  # fmt: skip
def month_range(spark: SparkSession, d: str) -> DataFrame:
    """The months between the first document and the last, with the documents of each."""
    docs = corpus.documents(spark, d)
    low, high = docs.agg(F.min("issued_date").cast("string"), F.max("issued_date").cast("string")).first()
    months = ingest.month_range(spark, low, high) if low else spark.createDataFrame([], "year int, month int")
    found = docs.groupBy(F.year("issued_date").alias("year"), F.month("issued_date").alias("month")).agg(F.count(F.lit(1)).alias("documents"))
    rows = months.join(found, ["year", "month"], "left")
    return rows.select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), F.coalesce("documents", F.lit(0)).alias("documents"))


@query("select doc_id, doc_id % 2 as part from documents")
def appended(spark: SparkSession, d: str) -> DataFrame:
    """Rows added to a table in two runs."""
    path = folders.work_folder(spark, "appended")
    for part in (0, 1):
        folders.append(corpus.table(spark, d, "documents").filter(F.col("doc_id") % 2 == part).select("doc_id", (F.col("doc_id") % 2).alias("part")), path)
    return spark.read.schema("doc_id long, part long").parquet(path)


@query("""select item_id::varchar as id, case when item_id % 7 = 1 then 'missing field' when item_id % 7 = 2 then 'bad date' when item_id % 7 = 3 then 'no relevant ids' when item_id % 7 = 4 then 'duplicate id' else 'good' end as reason,
    case when item_id % 7 = 4 then 2 else 1 end as n from benchmark""")  # fmt: skip
def golden_file(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items written as a file of golden questions, some of them faulty, and read again."""
    c = F.col("item_id")
    line = F.to_json(
        F.struct(
            c.alias("id"), F.when(c % 7 != 1, F.col("text")).alias("question"), F.when(c % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(c.cast("string"))).alias("relevant"),
            F.when(c % 7 == 2, "2024-02-30").when(c % 2 == 0, "2024-02-29").alias("as_of"),
        )
    )
    rows = corpus.table(spark, d, "benchmark").select(F.explode(F.when(c % 7 == 4, F.array(line, line, F.lit(""))).otherwise(F.array(line))).alias("value"))
    path = folders.work_folder(spark, "golden")
    rows.write.text(path)
    good, bad = evaluation.checked_golden(folders.golden_questions(spark, path))
    return good.select("id", F.lit("good").alias("reason")).union(bad.select("id", "reason")).groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"))
