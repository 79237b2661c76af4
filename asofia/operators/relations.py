"""Edges between documents from their texts and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.functions import text

MIN_REFERENCE = 14
EVIDENCE = 500
BEFORE = 40
STRONG, AMENDS, WEAK = 0.9, 0.7, 0.5
# Fixed patterns: the wording by which the regulator's texts state a relation.
YEAR = r"\d{4}-\d{2}\b"
SUPERSEDES = r"(?i)in supersession of|supersedes|superseded"
REPEALS = r"(?i)stands? (?:withdrawn|repealed)|are (?:hereby )?(?:withdrawn|repealed)"
FOOTNOTE = r"(?i)^\s*\d{0,3}\s*(?:amended|inserted|substituted|deleted|added) vide\b"
AMEND = r"(?i)\bamend(?:s|ed|ment)\b"
INSTRUMENT = r"vide|communicated|conveyed"


def dictionary(docs: DataFrame) -> DataFrame:
    """``reference, target, year``: normalised numbers of 14 characters or more that only one document has; ``docs``: ``source_id, circular_no``."""
    rows = docs.select("source_id", text.normalised_reference(F.coalesce("circular_no", F.lit(""))).alias("reference"))
    rows = rows.filter((F.length("reference") >= MIN_REFERENCE) & F.contains("reference", F.lit("/")))
    rows = rows.groupBy("reference").agg(F.min("source_id").alias("target"), F.count_distinct("source_id").alias("n")).filter("n = 1")
    return rows.select("reference", "target", F.regexp_extract("reference", YEAR, 0).alias("year"))


def _reference_key(reference: Column, year: Column) -> Column:
    """Ten characters of a reference around its year: the three before it, or the three after it where it comes first."""
    at = F.instr(reference, year)
    return F.substring(reference, F.when(at > 3, at - 3).otherwise(at), F.lit(10))


def citations(paragraphs: DataFrame, references: DataFrame) -> DataFrame:
    """``source_id, ord, target, instrument``: paragraphs and dictionary meet on ten characters around a year, and by containment then.

    ``instrument``: the number is preceded by words such as "vide", so it is the means and not the object of a statement. A document doesn't cite itself.
    """
    rows = paragraphs.withColumn("years", F.array_distinct(F.regexp_extract_all("paragraph", F.lit(YEAR), F.lit(0)))).filter(F.size("years") > 0)
    rows = rows.withColumn("norm", text.normalised_reference(F.col("paragraph")))
    around = lambda pattern: F.regexp_extract_all("norm", F.lit(f"(?s)(?=({pattern}))"), F.lit(1))
    rows = rows.withColumn("key", F.explode(F.array_distinct(F.concat(around(r".{3}\d{4}-\d{2}"), around(r"\d{4}-\d{2}.{3}")))))
    keyed = references.filter("year <> ''").withColumn("key", _reference_key(F.col("reference"), F.col("year")))
    found = rows.join(keyed, "key").filter(F.array_contains("years", F.col("year")) & F.contains("norm", "reference") & (F.col("target") != F.col("source_id")))
    at = F.instr("norm", F.col("reference"))
    head = F.substring(F.col("norm"), F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE)))
    return found.groupBy("source_id", "ord", "target").agg(F.max(head.rlike(INSTRUMENT)).alias("instrument"))


def kind_of(paragraph: Column, title: Column) -> Column:
    """What a paragraph says: superseding before repealing before amending, else a mere reference."""
    amends = paragraph.rlike(AMEND) | F.contains(F.lower(title), F.lit("amendment"))
    pair = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.lit(c).alias("confidence"))
    return F.when(paragraph.rlike(SUPERSEDES), pair("supersedes", STRONG)).when(paragraph.rlike(REPEALS), pair("repeals", STRONG)).when(amends, pair("amends", AMENDS)).otherwise(pair("refers", WEAK))


def text_relations(docs: DataFrame) -> DataFrame:
    """Edges ``src, dst, type, method, confidence, evidence`` from every paragraph of ``docs`` (``source_id, circular_no, title, raw_text``)."""
    paragraphs = docs.select("source_id", "title", F.posexplode(F.split("raw_text", "\n\n")).alias("ord", "paragraph"))
    cited = citations(paragraphs.select("source_id", "ord", "paragraph"), dictionary(docs)).join(paragraphs, ["source_id", "ord"])
    cited = cited.join(docs.select(F.col("source_id").alias("target"), text.subject(F.col("title")).alias("its_subject")), "target", "left")
    cited = cited.withColumn("kind", kind_of(F.col("paragraph"), F.col("title"))).withColumn("own", text.subject(F.col("title")))
    other = (F.col("kind.type") == "amends") & F.col("own").isNotNull() & ~F.col("its_subject").eqNullSafe(F.col("own"))
    weak = F.col("instrument") | other
    footnote = F.col("paragraph").rlike(FOOTNOTE)
    pick = lambda note, plain: F.when(footnote, note).otherwise(plain)
    return cited.select(
        pick(F.col("target"), F.col("source_id")).alias("src"), pick(F.col("source_id"), F.col("target")).alias("dst"),
        pick(F.lit("amends"), F.when(weak, "refers").otherwise(F.col("kind.type"))).alias("type"), F.lit("regex").alias("method"),
        pick(F.lit(STRONG), F.when(weak & (F.col("kind.type") != "refers"), WEAK).otherwise(F.col("kind.confidence"))).alias("confidence"),
        F.substring(text.squeeze(F.col("paragraph")), 1, EVIDENCE).alias("evidence"),
    )


def link_relations(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges from links ``source_id, target`` between known documents: an amendment amends a linked one with its own subject."""
    side = lambda c, t: docs.select(F.col("source_id").alias(c), F.col("title").alias(t))
    rows = links.filter("source_id <> target").select("source_id", "target").distinct().join(side("source_id", "title"), "source_id").join(side("target", "its_title"), "target")
    own = F.when(F.contains(F.lower("title"), F.lit("amendment")), text.subject(F.col("title")))
    amends = F.coalesce(own == text.subject(F.col("its_title")), F.lit(False))
    return rows.select(
        F.col("source_id").alias("src"), F.col("target").alias("dst"), F.when(amends, "amends").otherwise("refers").alias("type"), F.lit("link").alias("method"),
        F.when(amends, STRONG).otherwise(WEAK).alias("confidence"), F.concat(F.lit("link in "), "title").alias("evidence"),
    )


def merge(edges: DataFrame) -> DataFrame:
    """One edge per source, target and type, the most confident; references go where the pair has a stronger edge."""
    order = Window.partitionBy("src", "dst", "type").orderBy(F.desc("confidence"), "method", "evidence")
    best = edges.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    strong = best.filter("type <> 'refers'").select("src", "dst").distinct().withColumn("strong", F.lit(True))
    return best.join(strong, ["src", "dst"], "left").filter("type <> 'refers' or strong is null").drop("strong")


def replace_edges(stored: DataFrame, fresh: DataFrame, docs: DataFrame, methods: tuple[str, ...] = ("regex", "link")) -> DataFrame:
    """The new edge table: what people or models entered stays, automatic edges are replaced; ends that aren't documents drop out."""
    known = docs.select("source_id")
    ends = lambda c: known.withColumnRenamed("source_id", c)
    fresh = fresh.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    return stored.filter(~F.col("method").isin(*methods)).unionByName(fresh.select(stored.columns))
