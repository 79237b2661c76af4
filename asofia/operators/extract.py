"""Fields of regulator pages, as columns over tables of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from asofia.functions import text
from asofia.functions.text import MONTH_NAMES

MIN_TEXT = 200
HEAD, NUMBER_HEAD, LETTERHEAD, COMMENCE_HEAD = 8, 5, 3, 150
BASE_URL = "https://www.rbi.org.in/Scripts/"

# Tags that end a paragraph.
BLOCK_TAGS = {
    "p", "div", "li", "tr", "table", "tbody", "thead", "tfoot", "ol", "ul", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "blockquote", "center", "pre", "section",
}
# Reference prefixes and the departments they stand for.
DEPARTMENTS = {
    "DOR": "Department of Regulation",
    "DOS": "Department of Supervision",
    "DPSS": "Department of Payment and Settlement Systems",
    "FED": "Foreign Exchange Department",
    "DCM": "Department of Currency Management",
    "FIDD": "Financial Inclusion and Development Department",
    "DGBA": "Department of Government and Bank Accounts",
    "CEPD": "Consumer Education and Protection Department",
    "FMRD": "Financial Markets Regulation Department",
    "IDMD": "Internal Debt Management Department",
    "DSIM": "Department of Statistics and Information Management",
    "DOC": "Department of Communication",
    "DBR": "Department of Banking Regulation",
    "DBOD": "Department of Banking Operations and Development",
    "DNBR": "Department of Non-Banking Regulation",
    "DNBS": "Department of Non-Banking Supervision",
    "DCBR": "Department of Co-operative Bank Regulation",
    "UBD": "Urban Banks Department",
    "RPCD": "Rural Planning and Credit Department",
    "DBS": "Department of Banking Supervision",
    "DEIO": "Department of External Investments and Operations",
}
# Fixed patterns of the regulator's pages and wording.
_DATE = rf"(?:(?:{MONTH_NAMES})\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTH_NAMES})\.?,?\s+\d{{4}})"
COMMENCE = rf"(?i)(?:(?:come|comes|coming) into (?:force|effect)\s+(?:with effect\s+)?(?:from|on)|shall be effective (?:from|on))\s+(?:the\s+)?({_DATE})"
WHOLE = r"(?i)\b(?:these|this|the)\s+(?:\w+\s+){0,3}?(?:directions?|instructions|guidelines|regulations|circular|framework|scheme|norms|rules|amendments?)\b"
PARTIAL = r"(?i)\b(?:except|para(?:graph)?s?|which|immediately|clause|section|chapter|provisions?)\b"
EARLY = r"(?i)^\W*or\s+(?:from\s+)?(?:any\s+)?(?:an\s+)?earlier"
UPDATED = rf"(?i)\(\s*Updated as on\s+({MONTH_NAMES})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"
NUMBER = r"\bRBI/(?:[A-Za-z]+/)?\d{4}-\d{2,4}/\d+"
LETTER_DATE = rf"(?i)\b(?:Mumbai|New Delhi),?\s+(?:the\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\.?,?\s+(\d{{4}})"
DOC_LINK = r"(?i)(?:NotificationUser|BS_ViewMasDirections)\.aspx\?id=(\d+)"
VERSION_LINK = r"(?i)NotificationPreVersion\.aspx\?id=(\d+)(?:&(?:amp;)?Histid=(\d+))?"
WITHDRAWN = r"(?i)Withdrawn(\d{8})\.jpg"


class _Blocks(HTMLParser):
    """Collects paragraphs: block tags end one, a break starts a line, cells are joined by a bar, footnote marks and scripts are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.parts: list[str] = []
        self.hidden = 0  # depth of script and style
        self.mark: list[str] | None = None  # text of an open sup
        self.note = False  # the open sup links to a footnote

    def close_block(self) -> None:
        lines = (" ".join(line.replace("\xa0", " ").split()).strip("| ") for line in "".join(self.parts).split("\n"))
        block = "\n".join(line for line in lines if line)
        if block:
            self.blocks.append(block)
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "sup":
            self.mark, self.note = [], False
        elif tag == "a" and self.mark is not None and (dict(attrs).get("href") or "").startswith("#"):
            self.note = True
        elif tag in BLOCK_TAGS:
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "sup" and self.mark is not None:
            if not self.note:
                self.parts += self.mark
            self.mark = None
        elif tag in ("td", "th"):
            self.parts.append(" | ")
        elif tag in BLOCK_TAGS:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.parts if self.mark is None else self.mark).append(data)


def html_blocks(html: str | None) -> list[str]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.blocks


def _with_blocks(pages: DataFrame, html_col: str) -> DataFrame:
    """Adds ``blocks``, the paragraphs of each page, and ``error``, what went wrong with a page that can't be parsed; such a page has no paragraphs."""

    def parsed(html: str | None) -> tuple[list[str], str | None]:
        try:
            return html_blocks(html), None
        except Exception as error:  # one bad page must not end the run
            return [], f"{type(error).__name__}: {error}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(h) for h in batch.column(html_col).to_pylist()]
            columns = [pa.array([b for b, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "blocks", "error"])

    schema = StructType([*pages.schema.fields, StructField("blocks", ArrayType(StringType())), StructField("error", StringType())])
    return pages.mapInArrow(run, schema)


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, blocks, error``: the paragraphs of each page."""
    return _with_blocks(pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), "html").drop("html")


def clean_title(title: Column) -> Column:
    return text.squeeze(F.regexp_replace(title, r"(?i)\(\s*Updated as on[^)]*\)", ""))


def latest_stamp(head: Column) -> Column:
    """The latest "(Updated as on …)" date of a text."""
    part = lambda i: F.regexp_extract_all(head, F.lit(UPDATED), F.lit(i))
    return F.array_max(F.transform(F.arrays_zip(part(1).alias("m"), part(2).alias("d"), part(3).alias("y")), lambda x: text.date_of(x["m"], x["d"], x["y"])))


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def numbers(blocks: Column) -> Column:
    """``struct(number, reference)``: the regulator's number and the line after it; notifications of the exchange act have a reference alone."""
    fema = F.transform(
        F.slice(blocks, 1, HEAD),
        lambda b: F.when(F.startswith(b, F.lit("Notification No")), text.first_line(b)).when(b.rlike(r"^No\.\s*FEMA.*?-RB\b"), F.concat(F.lit("Notification No. "), F.regexp_extract(b, r"^No\.\s*(FEMA.*?-RB)\b", 1))),
    )
    notice = _first(F.filter(fema, lambda x: x.isNotNull()))
    block = _first(F.filter(F.slice(blocks, 1, NUMBER_HEAD), lambda b: b.rlike(NUMBER)))
    number = F.regexp_extract(block, NUMBER, 0)
    after = F.regexp_extract(block, NUMBER + r"[^\n]*\n([^\n]*)", 1)
    reference = F.nullif(F.trim(F.regexp_replace(after, r"^Master Direction\s*[-–]?\s*", "")), F.lit(""))
    return F.when(notice.isNotNull(), F.struct(F.lit(None).cast("string").alias("number"), notice.alias("reference"))).when(block.isNotNull(), F.struct(number.alias("number"), reference.alias("reference")))


def issue_date(blocks: Column) -> Column:
    """The date line among the first eight blocks, else the letterhead's date."""
    lines = F.transform(F.slice(blocks, 1, HEAD), text.first_line)
    dated = _first(F.filter(lines, lambda x: F.trim(x, F.lit(" .")).rlike(rf"^(?:{MONTH_NAMES})\.?\s+\d{{1,2}},?\s+\d{{4}}$")))
    letter = F.array_join(F.slice(blocks, 1, LETTERHEAD), "\n")
    part = lambda i: F.nullif(F.regexp_extract(letter, LETTER_DATE, i), F.lit(""))
    return F.when(dated.isNotNull(), text.first_date(dated)).otherwise(text.date_of(part(2), part(1), part(3)))


def commencement(blocks: Column) -> Column:
    """The day from which the whole document applies, if one of its first 150 blocks says so and allows no earlier one."""

    def read(b: Column) -> Column:
        clause = F.regexp_extract(b, COMMENCE, 0)
        at = F.instr(b, clause)
        sentence = F.element_at(F.split(F.substring(b, F.lit(1), at - 1), r"(?<=[.;])\s"), -1)
        subject = F.regexp_extract(sentence, WHOLE, 0)
        rest = F.substring(sentence, F.instr(sentence, subject) + F.length(subject), F.length(sentence))
        early = F.substring(b, at + F.length(clause), F.lit(80)).rlike(EARLY)
        words = F.regexp_extract(b, COMMENCE, 1)
        day_first = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\.?,?\s+(\d{{4}})$"
        month_first = rf"(?i)^({MONTH_NAMES})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$"
        a, c = (lambda i: F.regexp_extract(words, day_first, i)), (lambda i: F.regexp_extract(words, month_first, i))
        day = F.when(words.rlike(day_first), text.date_of(a(2), a(1), a(3))).otherwise(text.date_of(c(1), c(2), c(3)))
        whole = (clause != "") & (subject != "") & ~rest.rlike(PARTIAL)
        return F.struct(whole.alias("whole"), F.when(~early, day).alias("day"))

    return _first(F.filter(F.transform(F.slice(blocks, 1, COMMENCE_HEAD), read), lambda x: x["whole"]))["day"]


def department(reference: Column, head: Column) -> Column:
    """By the reference, else the first department named in the head."""
    names = F.create_map(*(F.lit(x) for pair in DEPARTMENTS.items() for x in pair))
    exchange = reference.rlike(r"(?i)A\.\s*P\.\s*\(DIR Series\)") | reference.rlike(r"\bFEMA\b")
    prefix = F.upper(F.nullif(F.regexp_extract(reference, r"(?i)\b(" + "|".join(DEPARTMENTS) + r")\b", 1), F.lit("")))
    named = _first(F.filter(F.array(*map(F.lit, DEPARTMENTS.values())), lambda n: F.contains(F.lower(head), F.lower(n))))
    return F.when(exchange, DEPARTMENTS["FED"]).otherwise(F.coalesce(F.try_element_at(names, prefix), named))


def withdrawal(html: Column, issued: Column) -> Column:
    """``struct(is_withdrawn, withdrawn_on)`` by the watermark; its date is dropped if it precedes the issue date."""
    digits = F.regexp_extract(html, WITHDRAWN, 1)
    day = F.try_to_date(digits, "ddMMyyyy")
    return F.struct((digits != "").alias("is_withdrawn"), F.when(issued.isNull() | (day >= issued), day).alias("withdrawn_on"))


def linked_ids(html: Column, own: Column) -> Column:
    """Ids of linked documents, each once, in order, without the page's own; ids are numbers, so leading zeros don't count. A page without an id has all, one without text none."""
    ids = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(DOC_LINK), F.lit(1)), lambda i: F.regexp_replace(i, r"^0+(?=\d)", ""))
    return F.filter(F.array_distinct(ids), lambda i: ~i.eqNullSafe(own))


def pdf_link(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)href=[\"']([^\"']+\.pdf)[\"']", 1), F.lit(""))


def without_version_links(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<a[^>]*NotificationPreVersion\.aspx\?id=\d+[^>]*>.*?</a>", "")


def is_master_direction(title: Column) -> Column:
    return title.rlike(r"(?i)^Master Directions?\b") | (title.rlike(r"\bDirections?, \d{4}\b") & ~F.contains(title, F.lit("Amendment")))


def doc_type(title: Column, reference: Column, from_index: Column) -> Column:
    return F.when(from_index | is_master_direction(title), "master_direction").when(F.startswith(F.coalesce(reference, F.lit("")), F.lit("Notification No")), "notification").otherwise("circular")


def detail_url(doc: Column) -> Column:
    return F.concat(F.lit(f"{BASE_URL}NotificationUser.aspx?Id="), doc, F.lit("&Mode=0"))


def details(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", title: str = "title") -> DataFrame:
    """All fields of each page (``title`` is a column of it), one row per row; a page with too little text has status ``missing``, one that can't be parsed ``failed``."""
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"), F.col(title).alias("title"), without_version_links(F.col(html_col)).alias("_html"))
    html_col, title = "html", "title"
    rows = _with_blocks(plain, "_html").withColumn("n", numbers(F.col("blocks"))).withColumn("issued_date", issue_date(F.col("blocks")))
    head = F.array_join(F.slice("blocks", 1, HEAD), "\n")
    rows = rows.withColumn("w", withdrawal(F.col(html_col), F.col("issued_date"))).withColumn("raw_text", F.array_join("blocks", "\n\n"))
    return rows.select(
        "id", clean_title(F.col(title)).alias("title"), F.col("n.number").alias("rbi_no"), F.col("n.reference").alias("ref_no"), department(F.col("n.reference"), head).alias("department"), "issued_date",
        latest_stamp(F.concat_ws("\n", F.col(title), head)).alias("updated_on"), commencement(F.col("blocks")).alias("effective_from"), "w.is_withdrawn", "w.withdrawn_on", pdf_link(F.col(html_col)).alias("pdf_url"),
        linked_ids(F.col(html_col), F.col("id").cast("string")).alias("linked_ids"), F.col(html_col).rlike(VERSION_LINK).alias("has_previous_versions"), "raw_text",
        F.when(F.col("error").isNotNull(), "failed").when(F.length("raw_text") >= MIN_TEXT, "ok").otherwise("missing").alias("status"), "error",
    )


def listing(rows: DataFrame) -> DataFrame:
    """Entries of listing pages from their table rows (``page, pos, header, href, title, pdf_url``).

    A header row carries a date to the entries below it, or a section, which ends the date. Of rows with one id the first counts.
    """
    dated = F.trim("header").rlike(rf"^(?:{MONTH_NAMES})\.? \d{{1,2}}, \d{{4}}$")
    is_header = F.col("href").isNull() & (F.trim(F.coalesce("header", F.lit(""))) != "")
    order = Window.partitionBy("page").orderBy("pos")
    rows = rows.withColumn("is_header", is_header).withColumn("day", F.when(is_header & dated, text.first_date(F.col("header")))).withColumn("named", F.when(is_header & ~dated, text.squeeze(F.col("header"))))
    rows = rows.withColumn("section", F.last("named", True).over(order)).withColumn("part", F.count("named").over(order))
    rows = rows.withColumn("listed_date", F.last("day", True).over(Window.partitionBy("page", "part").orderBy("pos")))
    rows = rows.withColumn("doc", F.nullif(F.regexp_extract("href", DOC_LINK, 1), F.lit(""))).filter("not is_header and doc is not null")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("page", "doc").orderBy("pos"))).filter("k = 1")
    return first.select("page", "pos", F.col("doc").cast("long").alias("doc_id"), clean_title(F.col("title")).alias("title"), "listed_date", "section", "pdf_url", latest_stamp(F.col("title")).alias("updated_on"))


def versions(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, hist_id, as_of, url``: dated earlier versions that a page links to, newest first by ``place``."""
    link = rf"(?is)<a[^>]*href=[\"'][^\"']*NotificationPreVersion\.aspx\?id=(\d+)&(?:amp;)?Histid=(\d+)[^\"']*[\"'][^>]*>(.*?)</a>"
    part = lambda i: F.regexp_extract_all(F.col(html_col), F.lit(link), F.lit(i))
    rows = pages.select(F.col(id_col).alias("id"), F.inline(F.arrays_zip(part(1).alias("doc"), part(2).alias("hist"), part(3).alias("words"))))
    rows = rows.select("id", F.col("hist").cast("long").alias("hist_id"), text.first_date(F.col("words")).alias("as_of"), F.concat(F.lit(f"{BASE_URL}NotificationPreVersion.aspx?id="), "doc", F.lit("&Histid="), "hist").alias("url"))
    rows = rows.filter("as_of is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("as_of"), F.desc("hist_id"))).cast("long"))
