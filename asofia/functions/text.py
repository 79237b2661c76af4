"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
# Months by their first three letters, and the spellings that dates may use.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
# English function words that a text index leaves out.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space, no-break spaces included, to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def date_of(month: Column, day: Column, year: Column) -> Column:
    """A date from an English month, day and year in text; null if there is no such day."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3)))
    return F.try_to_date(F.concat_ws("-", year, at.cast("string"), day), "y-M-d")


def first_date(text: Column) -> Column:
    """The first "Month D, YYYY" anywhere in a text."""
    pattern = rf"\b({MONTH_NAMES})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return date_of(part(1), part(2), part(3))


def normalised_reference(text: Column) -> Column:
    """Reference numbers compare equal without case, dashes of other kinds, "no.", spaces and commas. The patterns are fixed values."""
    t = F.regexp_replace(F.lower(text), "[–—]", "-")
    t = F.regexp_replace(t, r"\bnos?\b\.?", "")
    return F.trim(F.regexp_replace(t, r"[\s,]+", ""), F.lit("."))


def subject(title: Column) -> Column:
    """The first bracketed part of a title with eight characters or more, normalised; null without one. The patterns are fixed values."""
    t = F.nullif(F.regexp_extract(title, r"\(([^()]{8,})\)", 1), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(F.lower(t), "[–—]", "-"), r"\s+", " ")
    return F.trim(F.regexp_replace(t, r"\s*-\s*", "-"))


def escape_html(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text
