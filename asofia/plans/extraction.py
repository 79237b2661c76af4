"""Queries on page extraction and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofia.functions import text
from asofia.operators import extract, ingest
from asofia.plans.registry import registry
from asofia.plans.views import sql
from asofia.sources import corpus

QUERIES, ORACLE, query = registry()


def _pages(spark, d):
    return corpus.table(spark, d, "pages")


_TAGS = "|".join(sorted(extract.BLOCK_TAGS))
# The references that pages use, amp last, also where a text was cut before its semicolon. The place of a tag stays marked until they are read, as a tag ends a reference.
_READ = "h"
for _name, _sign in (("copy", "'©'"), ("middot", "'·'"), ("nbsp", "chr(160)"), ("quot", "'\"'"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
    _READ = f"regexp_replace({_READ}, '&{_name};?', {_sign}, 'g')"
_BLOCKS = {
    "m0": r"""select page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?i)<br\b[^>]*>', chr(10), 'g') as h from pages""",
    "m1": rf"""select page_id, html, regexp_replace(regexp_replace(regexp_replace(h, '(?i)</t[dh]\b[^>]*>', ' | ', 'g'), '(?i)</?({_TAGS})\b[^>]*>', chr(1), 'g'), '</?[a-zA-Z][^>]*>', chr(2), 'g') as h from m0""",
    "m2": f"select page_id, html, replace({_READ}, chr(2), '') as h from m1",
    "m3": r"""select page_id, html, list_filter(list_transform(string_split(h, chr(1)), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)),
      lambda l: trim(regexp_replace(l, '[\s\x{00a0}]+', ' ', 'g'), ' |')), lambda l: l <> ''), chr(10))), lambda b: b <> '') as blocks from m2""",
}


@query(sql("select page_id as id, len(blocks) as n, sha256(array_to_string(blocks, chr(10) || chr(10))) as text_hash from m3", **_BLOCKS))
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of every page."""
    return extract.page_blocks(_pages(spark, d)).select("id", F.size("blocks").cast("long").alias("n"), F.sha2(F.array_join("blocks", "\n\n"), 256).alias("text_hash"))


@query(r"""select page_id, count(*) as n, count(distinct href) as distinct_n, min(href) as first from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as href from pages) group by page_id""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("href").alias("distinct_n"), F.min("href").alias("first"))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' (Updated as on May 1, 2024)', '(?i)\(\s*Updated as on[^)]*\)', '', 'g'), '[\s\x{00a0}]+', ' ', 'g')) as title from pages""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" (Updated as on May 1, 2024)"))
    return _pages(spark, d).select("page_id", extract.clean_title(raw).alias("title"))


def _docs_with(spark, d, **columns):
    return corpus.table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


def _cycle(values, by: int = 1):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("doc_id") / by) % len(values)).cast("int") + 1)


def _pick(values: list, by: int = 1) -> str:
    return "[" + ", ".join("null" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + f"][doc_id // {by} % {len(values)} + 1]"


_DATES = [("on March 5, 2024 all", "2024-03-05"), ("Sept. 30, 2021", "2021-09-30"), ("February 30, 2024", None), ("no date", None), ("Dec 1 2020 and May 2, 2021", "2020-12-01")]


@query(f"select doc_id, coalesce({_pick([x for _, x in _DATES])}::date, date '1900-01-01') as day from documents")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    return _docs_with(spark, d, day=F.coalesce(text.first_date(F.concat(_cycle([x for x, _ in _DATES]), F.lit("\n"), "text")), F.lit("1900-01-01").cast("date")))


_REFS = [
    ("DOR.SRC.REC.5/14.01.001/2023-24", "Department of Regulation"), ("A. P. (DIR Series) Circular No. 3", "Foreign Exchange Department"), ("Notification No. FEMA 20/2024-RB", "Foreign Exchange Department"),
    ("dpss.CO.OD.1", "Department of Payment and Settlement Systems"), ("XYZ.1", "Urban Banks Department"),
]


@query(f"select doc_id, {_pick([x for _, x in _REFS])} as department from documents")
def dept_from_ref(spark: SparkSession, d: str) -> DataFrame:
    return _docs_with(spark, d, department=extract.department(_cycle([x for x, _ in _REFS]), F.concat(F.lit("to the urban banks department\n"), "text")))


_TITLES = ["Master Direction on Loans", "Reserve Bank (Loans) Directions, 2025", "Reserve Bank (Loans) Amendment Directions, 2025", "Loans", "master directions"]


@query(
    f"""select doc_id, case when doc_id % 13 = 0 or regexp_matches(t, '(?i)^Master Directions?\\b') or (regexp_matches(t, '\\bDirections?, [0-9]{{4}}\\b') and not contains(t, 'Amendment')) then 'master_direction'
    when starts_with(r, 'Notification No') then 'notification' else 'circular' end as doc_type from (select doc_id, {_pick(_TITLES)} as t, {_pick([x for x, _ in _REFS], 5)} as r from documents)"""
)
def doc_type(spark: SparkSession, d: str) -> DataFrame:
    kind = extract.doc_type(_cycle(_TITLES), _cycle([x for x, _ in _REFS], 5), F.col("doc_id") % 13 == 0)
    return _docs_with(spark, d, doc_type=kind)


_CLAUSES = [
    ("These Directions shall come into force with effect from April 1, 2027.", "2027-04-01"), ("This circular shall be effective from the 2nd December, 2024", "2024-12-02"),
    ("Paragraph 5 shall come into force on May 1, 2025.", None), ("These Directions come into effect immediately except para 6, which shall come into effect from May 1, 2025", None),
    ("The Master Guidelines shall come into effect on 1 July 2026, or from any earlier date as decided", None), ("Nothing is said.", None),
]


@query(f"select doc_id, coalesce({_pick([x for _, x in _CLAUSES])}::date, date '1900-01-01') as day from documents")
def effective_from(spark: SparkSession, d: str) -> DataFrame:
    """Commencement clauses before each document's own lines."""
    blocks = F.concat(F.array(_cycle([x for x, _ in _CLAUSES])), F.split(F.coalesce("text", F.lit("")), "\n"))
    return _docs_with(spark, d, day=F.coalesce(extract.commencement(blocks), F.lit("1900-01-01").cast("date")))


_HEADS = [
    (["RBI/2026-27/278\nDOR.1/2026-27", "March 5, 2026", "All banks"], "RBI/2026-27/278", "DOR.1/2026-27", "2026-03-05"), (["Notification No. FEMA 5/2024-RB\nx", "Mumbai, the 2nd December, 2024"], None, "Notification No. FEMA 5/2024-RB", "2024-12-02"),
    (["No. FEMA.396(3)/2024-RB. In exercise", "x"], None, "Notification No. FEMA.396(3)/2024-RB", None), (["RBI/DOR/2024-25/12\nMaster Direction - DOR.7", "May 1 2024"], "RBI/DOR/2024-25/12", "DOR.7", "2024-05-01"), (["Text alone"], None, None, None),
]


@query(f"select doc_id, coalesce({_pick([h[1] for h in _HEADS])}, '-') as number, coalesce({_pick([h[2] for h in _HEADS])}, '-') as reference, coalesce({_pick([h[3] for h in _HEADS])}::date, date '1900-01-01') as issued from documents")
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.concat(F.element_at(F.array(*(F.array(*map(F.lit, h[0])) for h in _HEADS)), (F.col("doc_id") % len(_HEADS)).cast("int") + 1), F.split(F.coalesce("text", F.lit("")), "\n"))
    n = extract.numbers(blocks)
    return _docs_with(spark, d, number=F.coalesce(n["number"], F.lit("-")), reference=F.coalesce(n["reference"], F.lit("-")), issued=F.coalesce(extract.issue_date(blocks), F.lit("1900-01-01").cast("date")))


@query(
    """select page_id, page_id % 3 > 0 as is_withdrawn, coalesce(case when page_id % 3 > 0 and page_id % 5 > 0 then date '2021-03-01' + cast(page_id % 28 as integer) end, date '1900-01-01') as withdrawn_on,
    '[' || array_to_string(list_filter([a, case when b <> a then b end], lambda x: x is not null and x <> page_id), ', ') || ']' as linked, case when page_id % 4 = 0 then 'docs/' || page_id || '.pdf' else '-' end as pdf
    from (select *, page_id * 3 % 50 as a, page_id * 7 % 50 as b from pages)"""
)
def page_marks(spark: SparkSession, d: str) -> DataFrame:
    """Watermark, links (some to the page itself, some repeated) and file link, seeded into each page."""
    day = F.date_format(F.date_add(F.lit("2021-03-01").cast("date"), (F.col("page_id") % 28).cast("int")), "ddMMyyyy")
    mark = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit('<img src="Withdrawn'), day, F.lit('.jpg">'))).otherwise("")
    link = lambda k: F.concat(F.lit('<a href="NotificationUser.aspx?Id='), (F.col("page_id") * k) % 50, F.lit('&Mode=0">x</a>'))
    pdf = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<a href="docs/'), "page_id", F.lit('.pdf">pdf</a>'))).otherwise("")
    rows = _pages(spark, d).select("page_id", F.concat("html", mark, link(3), link(7), link(3), pdf).alias("html"))
    w = extract.withdrawal(F.col("html"), F.when(F.col("page_id") % 5 == 0, F.lit("2022-01-01").cast("date")))
    linked = extract.linked_ids(F.col("html"), F.col("page_id").cast("string"))
    return rows.select(
        "page_id", w["is_withdrawn"].alias("is_withdrawn"), F.coalesce(w["withdrawn_on"], F.lit("1900-01-01").cast("date")).alias("withdrawn_on"),
        F.concat(F.lit("["), F.array_join(linked, ", "), F.lit("]")).alias("linked"), F.coalesce(extract.pdf_link(F.col("html")), F.lit("-")).alias("pdf"),
    )


_STAMPS = [("Loans (Updated as on May 5, 2024)", "2024-05-05"), ("(Updated as on Jan 1, 2020) and (updated as on Sept. 30, 2021)", "2021-09-30"), ("Updated as on May 5, 2024", None), ("(Updated as on February 30, 2024)", None)]


@query(f"select doc_id, coalesce({_pick([x for _, x in _STAMPS])}::date, date '1900-01-01') as day from documents")
def updated_on(spark: SparkSession, d: str) -> DataFrame:
    """The latest stamp of a title and the whole text."""
    head = F.concat(_cycle([x for x, _ in _STAMPS]), F.lit("\n"), F.coalesce("text", F.lit("")))
    return _docs_with(spark, d, day=F.coalesce(extract.latest_stamp(head), F.lit("1900-01-01").cast("date")))


@query("select page_id, page_id % 3 = 0 as has_previous_versions, sha256(html) as html_hash from pages")
def version_links_removed(spark: SparkSession, d: str) -> DataFrame:
    """Links to earlier versions, seeded into every third page, are taken out again, which leaves the page as it was."""
    link = F.concat(F.lit('<a class="x" href="NotificationPreVersion.aspx?id='), "page_id", F.lit('&Histid=4">March 1,\n<b>2024</b></a>'))
    html = F.concat(F.when(F.col("page_id") % 3 == 0, link).otherwise(""), "html")
    rows = _pages(spark, d).select("page_id", html.alias("html"))
    return rows.select("page_id", F.col("html").rlike(extract.VERSION_LINK).alias("has_previous_versions"), F.sha2(extract.without_version_links(F.col("html")), 256).alias("html_hash"))


@query(
    """with rows as (select l_orderkey as page, l_linenumber as pos, min(l_partkey) as part from lineitem group by all),
    h as (select *, case when pos = 1 then 'Section ' || part % 5 when pos % 3 = 2 then null end as named, case when pos % 3 = 2 then date '2024-01-01' + cast(part % 300 as integer) end as day from rows),
    s as (select *, last_value(named ignore nulls) over (partition by page order by pos) as section, count(named) over (partition by page order by pos) as p from h),
    c as (select *, last_value(day ignore nulls) over (partition by page, p order by pos) as listed_date from s)
    select page, pos::bigint as pos, part % 7 as doc_id, coalesce(listed_date, date '1900-01-01') as listed_date, coalesce(section, '-') as section from c where pos > 1 and pos % 3 <> 2
    qualify row_number() over (partition by page, part % 7 order by pos) = 1"""
)
def listing_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for listing pages: their lines are section rows, date rows and entries."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_partkey") % 300).cast("int")), "MMMM d, yyyy")
    header = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Section "), F.col("l_partkey") % 5)).when(F.col("l_linenumber") % 3 == 2, day)
    href = F.when(header.isNull(), F.concat(F.lit("NotificationUser.aspx?Id="), F.col("l_partkey") % 7))
    lines = corpus.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = lines.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("pos"), header.alias("header"), href.alias("href"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("pdf_url"))
    out = extract.listing(rows)
    return out.select("page", "pos", "doc_id", F.coalesce("listed_date", F.lit("1900-01-01").cast("date")).alias("listed_date"), F.coalesce("section", F.lit("-")).alias("section"))


@query("select page_id as id, h as hist_id, date '2020-01-01' + cast(h * (page_id % 50) as integer) as as_of, row_number() over (partition by page_id order by h * (page_id % 50) desc, h desc) as place from pages, range(1, 4) t(h)")
def page_versions(spark: SparkSession, d: str) -> DataFrame:
    day = lambda h: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (h * (F.col("page_id") % 50)).cast("int")), "MMM d, yyyy")
    links = [F.concat(F.lit('<a href="NotificationPreVersion.aspx?id='), "page_id", F.lit(f'&amp;Histid={h}">'), day(h), F.lit("</a>")) for h in (1, 2, 3)]
    return extract.versions(_pages(spark, d).select("page_id", F.concat("html", *links).alias("html"))).select("id", "hist_id", "as_of", "place")


_DETAILS = r"""select page_id as id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\s\x{00a0}]+', ' ', 'g')) as title, case when length(t) >= 200 then 'ok' else 'missing' end as status,
  len(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)(?:NotificationUser|BS_ViewMasDirections)\.aspx\?id=(\d+)', 1), lambda i: regexp_replace(i, '^0+([0-9])', '\1'))), lambda i: i is distinct from page_id::varchar)) as links, length(t) as chars
  from (select *, array_to_string(blocks, chr(10) || chr(10)) as t from m3)"""


@query(sql(_DETAILS, **_BLOCKS))
def page_details(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every page in one pass."""
    rows = extract.details(_pages(spark, d).withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return rows.select("id", "title", "status", F.size("linked_ids").cast("long").alias("links"), F.length("raw_text").cast("long").alias("chars"))


@query("select doc_id, 'https://www.rbi.org.in/Scripts/NotificationUser.aspx?Id=' || doc_id || '&Mode=0' as url, length(substr(documents.text, 1, 3000)) as shown from documents join benchmark on item_id * 7 = doc_id")
def single_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a table of keys, their text cut to the 3000 characters that are shown."""
    keys = corpus.table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("doc_id"))
    rows = corpus.table(spark, d, "documents").join(keys, "doc_id", "left_semi")
    return rows.select("doc_id", extract.detail_url(F.col("doc_id")).alias("url"), F.length(F.substring("text", 1, 3000)).cast("long").alias("shown"))


@query(sql("select doc_id, case when is_withdrawn or valid_to is not null then true else false end as is_withdrawn, coalesce(case when valid_to >= issued_date then valid_to end, date '1900-01-01') as withdrawn_on, issued_date as text_as_of from docs", "docs"))
def backfill_rules(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("date")
    rows = ingest.repaired(corpus.documents(spark, d).withColumn("withdrawn_on", F.col("valid_to")).withColumn("text_as_of", none).withColumn("updated_on", none))
    return rows.select("doc_id", "is_withdrawn", F.coalesce("withdrawn_on", F.lit("1900-01-01").cast("date")).alias("withdrawn_on"), "text_as_of")
