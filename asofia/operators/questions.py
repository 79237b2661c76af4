"""The day that a question asks about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofia.functions.text import MONTHS

# Fixed wording: a time word must stand before a date.
CUE = "(as of|as on|as at|in|during|on|before|until|till|by|back in|effective)"
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
YEAR = r"((?:19|20)\d{2})(?!\d|-\d)"
DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
BEFORE = ("before", "until", "till", "by")
# Fixed patterns of dates in questions.
#: The most telling first, with the groups that hold year, month and day.
PATTERNS = [
    (rf"\b{CUE}\s+{DAY}\s+{MONTH},?\s+{YEAR}", 4, 3, 2),
    (rf"\b{CUE}\s+{MONTH}\s+{DAY},?\s+{YEAR}", 4, 2, 3),
    (rf"\b{CUE}\s+(\d{{4}})-(\d{{2}})-(\d{{2}})", 2, 3, 4),
    (rf"\b{CUE}\s+(\d{{1,2}})[./](\d{{1,2}})[./]((?:19|20)\d{{2}})", 4, 3, 2),
    (rf"\b{CUE}\s+{MONTH},?\s+{YEAR}", 3, 2, 0),
    (rf"\b{CUE}\s+(?:the\s+year\s+)?{YEAR}", 2, 0, 0),
]


def _month(c: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c, 1, 3))).cast("int")
    return F.when(c.rlike(r"^\d"), c.try_cast("int")).otherwise(named)


def parse_as_of(question: Column, today: Column) -> Column:
    """``struct(day, words)`` of the first pattern that gives a day not after today; null without one.

    A month or a year stands for its last day, but not past today; "before", "until", "till" and "by" for the day before its first.
    """
    def days(pattern: str, year: int, month: int, day: int) -> Column:
        group = lambda i: F.regexp_extract_all(question, F.lit("(?i)" + pattern), F.lit(i))
        rows = F.arrays_zip(group(0).alias("words"), group(1).alias("cue"), group(year).alias("y"), group(month).alias("m"), group(day).alias("d"))

        def read(r: Column) -> Column:
            m = _month(r["m"]).cast("string") if month else F.lit("1")
            first = F.try_to_date(F.concat_ws("-", r["y"], m, r["d"] if day else F.lit("1")), "y-M-d")
            last = first if day else F.last_day(first) if month else F.try_to_date(F.concat(r["y"], F.lit("-12-31")), "y-M-d")
            shown = F.when(F.lower(r["cue"]).isin(*BEFORE), F.date_sub(first, 1)).otherwise(F.least(last, today))
            return F.struct(F.when(first <= today, shown).alias("day"), r["words"].alias("words"))

        return F.filter(F.transform(rows, read), lambda x: x["day"].isNotNull())

    return F.try_element_at(F.concat(*(days(*p) for p in PATTERNS)), F.lit(1))


def resolve(questions: DataFrame, today: str) -> DataFrame:
    """Adds ``as_of`` and where it came from: the request's ``given`` day, the question, or today."""
    day = F.lit(today).cast("date")
    rows = questions.withColumn("read", parse_as_of(F.col("question"), day))
    source = F.when(F.col("given").isNotNull(), "request").when(F.col("read.day").isNotNull(), "question").otherwise("today")
    return rows.withColumn("as_of", F.coalesce("given", "read.day", day)).withColumn("as_of_source", source).withColumn("as_of_words", F.col("read.words")).drop("read")
