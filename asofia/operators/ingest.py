"""Incremental ingest: what changed, what becomes of it, and the tables after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields that make an update when one differs.
METADATA = ("title", "department", "doc_type", "issued_date", "effective_from", "updated_on", "is_withdrawn", "withdrawn_on", "pdf_url")
OUTCOMES = ("new", "updated", "unchanged", "duplicate", "missing", "failed")
VERSIONS = 4
MIN_TEXT = 200
BLOCKED = (403, 418)


def select_entries(entries: DataFrame, match: str | None = None, section: str | None = None, limit: int | None = None) -> DataFrame:
    """Listing rows whose title and section contain the patterns, in any case; a row without a section fails a section pattern."""
    for column, pattern in (("title", match), ("section", section)):
        if pattern:
            entries = entries.filter(F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))
    return entries.limit(limit) if limit else entries


def refresh_actions(entries: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``fetch`` for unknown rows, ``refresh`` for known ones with a newer stamp than the stored one (or a first one), else ``unchanged``."""
    rows = entries.join(stored.select("source_id", F.col("updated_on").alias("known_on"), F.lit(True).alias("known")), "source_id", "left")
    same = F.col("updated_on").isNull() | (F.col("known_on").isNotNull() & (F.col("updated_on") <= F.col("known_on")))
    action = F.when(F.col("known").isNull(), "fetch").when(F.lit(not force) & same, "unchanged").otherwise("refresh")
    return rows.withColumn("action", action).drop("known", "known_on")


def validity(rows: DataFrame) -> DataFrame:
    """Adds hash, window and text date. Rows without an issue date on page or list get status ``failed``."""
    issued = F.coalesce("issued_date", "listed_date")
    rows = rows.withColumn("content_hash", F.sha2(F.coalesce("raw_text", F.lit("")), 256)).withColumn("issued_date", issued)
    rows = rows.withColumn("valid_from", F.coalesce("effective_from", "issued_date")).withColumn("valid_to", F.col("withdrawn_on"))
    rows = rows.withColumn("text_as_of", F.coalesce("version_of", "updated_on", "issued_date"))
    return rows.withColumn("status", F.when(F.col("status") != "ok", F.col("status")).when(F.col("issued_date").isNull(), "failed").otherwise("ok"))


def sticky_type(old: Column, new: Column, from_index: Column) -> Column:
    """Once a master direction, always one."""
    return F.when((old == "master_direction") | from_index, "master_direction").otherwise(new)


def retyped(docs: DataFrame, listed: DataFrame, doc_type: str = "master_direction") -> DataFrame:
    """Documents with the type that an index page gives to those it lists; of the others nothing changes."""
    rows = docs.join(listed.select("source_id").distinct().withColumn("_listed", F.lit(True)), "source_id", "left")
    return rows.withColumn("doc_type", F.when(F.col("_listed"), doc_type).otherwise(F.col("doc_type"))).select(docs.columns)


def outcomes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """What each incoming row does, one outcome per row.

    A text whose hash another document has already, stored or earlier in this run (by ``seq``), is a duplicate if it would be new to its own document.
    """
    old = stored.select("source_id", F.col("content_hash").alias("old_hash"), F.struct(*(c for c in METADATA if c in stored.columns)).alias("old_fields"))
    mine = F.struct(*(c for c in METADATA if c in stored.columns))
    rows = incoming.withColumn("fields", mine).join(old, "source_id", "left")
    changed = F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash"))
    owner = stored.groupBy("content_hash").agg(F.min("source_id").alias("owner"))
    rows = rows.withColumn("changed", changed).join(owner, "content_hash", "left")
    # a hash that very many rows share is aggregated before the shuffle
    first = rows.filter("status = 'ok' and changed").groupBy("content_hash").agg(F.min("seq").alias("first"))
    rows = rows.join(first, "content_hash", "left")
    taken = (F.col("owner").isNotNull() & (F.col("owner") != F.col("source_id"))) | (F.col("owner").isNull() & (F.col("seq") > F.col("first")))
    outcome = (
        F.when(F.col("status") != "ok", F.col("status")).when(F.col("changed") & taken, "duplicate").when(F.col("old_hash").isNull(), "new")
        .when(F.col("changed") | ~F.col("fields").eqNullSafe(F.col("old_fields")), "updated").otherwise("unchanged")
    )
    return rows.withColumn("outcome", outcome).drop("fields", "old_fields", "old_hash", "owner", "first")


def statistics(*runs: DataFrame) -> DataFrame:
    """Rows per outcome over one run or several; outcomes that didn't occur count zero."""
    rows = runs[0].select("outcome")
    for run in runs[1:]:
        rows = rows.union(run.select("outcome"))
    return rows.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def merged(stored: DataFrame, judged: DataFrame) -> DataFrame:
    """The next snapshot: new and updated rows take their incoming values, all others stay."""
    fresh = judged.filter("outcome in ('new', 'updated')")
    return stored.join(fresh.select("source_id"), "source_id", "left_anti").unionByName(fresh.select(stored.columns))


def invalidated(chunks: DataFrame, judged: DataFrame) -> DataFrame:
    """Passages without those of documents whose text changed."""
    return chunks.join(judged.filter("outcome = 'updated' and changed").select("source_id"), "source_id", "left_anti")


def propagated(chunks: DataFrame, judged: DataFrame) -> DataFrame:
    """Passages with the new window of documents of which only other fields changed."""
    moved = judged.filter("outcome = 'updated' and not changed").select("source_id", F.col("valid_from").alias("vf"), F.col("valid_to").alias("vt"), F.lit(True).alias("moved"))
    rows = chunks.join(moved, "source_id", "left")
    pick = lambda new, old: F.when(F.col("moved"), F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select(*(pick({"valid_from": "vf", "valid_to": "vt"}[c], c) if c in ("valid_from", "valid_to") else c for c in chunks.columns))


def history(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """Old pages of updated documents, named after the first twelve digits of their hash."""
    name = F.concat("source_id", F.lit("-"), F.substring(F.sha2("html", 256), 1, 12))
    return pages.join(judged.filter("outcome = 'updated'").select("source_id"), "source_id", "left_semi").withColumn("archived_as", name)


def version_fallback(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Pages without text take that of the newest of their last four versions that has some, and keep their own other fields; else they fail."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("as_of"), F.desc("hist_id"))
    usable = versions.withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= VERSIONS).filter(F.length("version_text") >= MIN_TEXT)
    usable = usable.groupBy("source_id").agg(F.min_by(F.struct("version_text", F.col("as_of").alias("version_of")), "k").alias("v"))
    rows = pages.join(usable, "source_id", "left")
    bare = F.coalesce(F.length("raw_text"), F.lit(0)) < MIN_TEXT
    return rows.select(
        *(c for c in pages.columns if c not in ("raw_text", "status")),
        F.when(bare, F.col("v.version_text")).otherwise(F.col("raw_text")).alias("raw_text"), F.when(bare, F.col("v.version_of")).alias("version_of"),
        F.when(bare & F.col("v").isNull(), "failed").otherwise(F.col("status")).alias("status"),
    )


def title_or_listed(title: Column, listed: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), listed)


def repaired(docs: DataFrame) -> DataFrame:
    """Missing text dates and withdrawal flags are filled in, withdrawals before the issue date lose their date."""
    on = F.when(F.col("withdrawn_on") >= F.col("issued_date"), F.col("withdrawn_on"))
    return docs.withColumn("is_withdrawn", F.col("is_withdrawn") | F.col("withdrawn_on").isNotNull()).withColumn("withdrawn_on", on).withColumn("text_as_of", F.coalesce("text_as_of", "updated_on", "issued_date"))


def id_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Page ids of a range, both ends included, newest first."""
    return spark.range(first, last + 1).orderBy(F.desc("id"))


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``year, month`` of each month between two days."""
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.year("m").alias("year"), F.month("m").alias("month"))


def recent_months(spark: SparkSession, today: str) -> DataFrame:
    """This month and the one before: the listings of an incremental run."""
    return month_range(spark, f"{today[:8]}01", today).unionByName(spark.sql(f"select year(d) as year, month(d) as month from (select add_months(date'{today}', -1) as d)"))


def run_recent(listings: DataFrame, pages: DataFrame, stored: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """An incremental run: what each due row does, and the next snapshot.

    ``listings`` (``source_id, title, listed_date, updated_on, from_index``) of this month and the last one say which pages are due; ``pages`` has
    the parsed fields of pages. Titles fall back to the listing's, types stick, and a page that could not be parsed fails without ending the run.
    """
    months = F.broadcast(recent_months(listings.sparkSession, today))  # two rows
    due = listings.withColumn("year", F.year("listed_date")).withColumn("month", F.month("listed_date")).join(months, ["year", "month"], "left_semi")
    due = refresh_actions(due, stored).filter("action <> 'unchanged'")
    due = due.select("source_id", F.col("title").alias("listed_title"), F.col("listed_date").alias("_listed"), F.col("from_index").alias("_index"))
    rows = pages.drop("listed_date").join(due, "source_id").join(stored.select("source_id", F.col("doc_type").alias("_old")), "source_id", "left")
    rows = rows.withColumn("title", title_or_listed(F.col("title"), F.col("listed_title"))).withColumn("doc_type", sticky_type(F.coalesce("_old", F.lit("")), F.col("doc_type"), F.col("_index")))
    judged = outcomes(validity(rows.withColumnRenamed("_listed", "listed_date").drop("listed_title", "_index", "_old")), stored)
    return judged, merged(stored, judged)


def unblocked(pages: DataFrame, markers: list[str]) -> DataFrame:
    """Fetched pages that aren't a refusal: no refusing status, and no challenge marker near the start of a good page."""
    marked = F.lit(False)
    for m in markers:
        marked |= (F.col("status") == 200) & F.contains(F.substring("html", 1, 4000), F.lit(m))
    return pages.filter(~F.col("status").isin(*BLOCKED) & ~marked)
