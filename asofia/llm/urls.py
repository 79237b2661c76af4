"""URL rules as a sort-merge range join, in DataFrame functions only.

A host is written with its labels reversed (``www.example.com`` becomes ``com.example.www.``), so a rule for a host
and its subdomains is an interval of keys. A rule's path is a prefix of a known length; each URL gets one key for each
path length that occurs in the rules. Rules with one path have nested or disjoint intervals. A sweep over the sorted
keys needs the innermost active rule, the top of a stack of open intervals; the stack is folded into the rules
beforehand: a rule's start puts the rule on top, its end puts back the next rule around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.llm.scratch import Scratch

#: Host, path and verdict of each rule.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sweep takes so many URLs, and so many for each boundary that it has to sort in, so boundaries are never repeated more often than an eighth of the URLs.
_SWEEP_URLS, _URLS_PER_EDGE = 64, 8
#: Labels with rules that are broadcast at most, some 30 bytes each.
_BROADCAST_LABELS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: on to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _key(path: Column, host: Column) -> Column:
    """Sorts like the host's reversed labels within one path. The separators sort below all other characters of either part."""
    labels = F.array_join(F.reverse(F.split(F.translate(host, "\u0000\u0001\u0002", "\u0003\u0003\u0003"), r"\.", -1)), "\u0001")
    return F.concat(path, F.lit("\u0000"), labels, F.lit("\u0001"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The longest fitting rule of each URL and its verdict; one row per input row.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains of it, for paths that start
    with its path. Among fitting rules the one with the longest host plus path wins, then the one with the longer
    host; of rules with the same host and path the one with the greater verdict ("block" over "allow"). A URL that is null
    or has no ``://`` has an empty host and path and fits no rule of a host; a URL no rule fits gets ``default``. Ids may
    be null or repeat. Other columns are ignored; no pages give no rows, no rules leave the default to all.

    URLs are dealt to sweeps by their top label and a salt, and each sweep has all boundaries of that label. A label has as many salts as its
    own URLs and boundaries ask for: a hot host is spread evenly, and a label with many rules has few, long sweeps. Labels without rules need none.
    """
    rules = rules.select("host", "path", "verdict").filter("host <> '' and path is not null and verdict is not null")
    rules = rules.withColumn("host", F.translate("host", _UPPER, _LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("low", _key(F.col("path"), F.col("host"))).withColumn("width", F.length("path"))
    rules = rules.withColumn("label", F.element_at(F.split("host", r"\.", -1), -1))
    # the next rule around each: the longest of the proper suffixes of its host with the same path
    suffixes = rules.select("low", "path", F.split("host", r"\.", -1).alias("parts"))
    suffixes = suffixes.select("low", "path", F.posexplode(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))).alias("at", "_"), "parts")
    suffixes = suffixes.select("low", "path", "at", F.array_join(F.expr("slice(parts, at + 2, size(parts))"), ".").alias("host"))
    around = suffixes.join(rules.select("path", "host", F.struct("low", "host", "path", "verdict").alias("outer")), ["path", "host"])
    around = around.groupBy("low").agg(F.min_by("outer", "at").alias("outer"))
    stacked = rules.join(around, "low", "left").select("label", "low", "width", F.struct("low", "host", "path", "verdict").alias("rule"), "outer")
    # U+0002 after the key's last separator is above every key that continues it with a label, since labels follow U+0001
    empty = F.lit(None).cast("struct<low:string,host:string,path:string,verdict:string>")
    edges = stacked.select("label", F.col("low").alias("key"), F.lit(0).alias("turn"), F.col("rule").alias("top"))
    edges = edges.union(stacked.select("label", F.concat(F.expr("left(low, length(low) - 1)"), F.lit("\u0002")), F.lit(-1), F.coalesce("outer", empty)))

    widths = [r["width"] for r in rules.select("width").distinct().collect()]  # lengths of rule paths, not rows of pages
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not widths:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = F.filter(F.array(*(F.lit(w) for w in sorted(widths))), lambda w: w <= F.length("path"))
    urls = urls.withColumn("label", F.element_at(F.split("host", r"\.", -1), -1))
    labels = edges.groupBy("label").agg(F.count(F.lit(1)).alias("edges"))
    few = labels.count() <= _BROADCAST_LABELS
    counted = urls.select("label").join(F.broadcast(labels.select("label")) if few else labels.select("label"), "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("urls"))
    sweeps = labels.join(counted, "label").select("label", (1 + F.floor(F.col("urls") / F.greatest(F.lit(_SWEEP_URLS), F.col("edges") * _URLS_PER_EDGE))).alias("salts"))
    sweeps = Scratch(pages.sparkSession, "urls").table(sweeps, "sweeps")
    keyed = urls.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(sweeps) if few else sweeps, "label", "left")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "host", "path", "row"), F.coalesce("salts", F.lit(1 << 31))))
    probes = keyed.withColumn("width", F.explode_outer(fits)).select(
        "label", "salt",
        _key(F.expr("left(path, coalesce(width, 0))"), F.col("host")).alias("key"), F.lit(1).alias("turn"), empty.alias("top"),
        F.struct("row", "id", "host", "path").alias("url"),
    )
    spread = edges.join(sweeps, "label").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    spread = spread.select("label", "salt", "key", "turn", "top", F.lit(None).cast(probes.schema["url"].dataType).alias("url"))
    sweep = Window.partitionBy("label", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = probes.union(spread).withColumn("edge", F.last(F.when(F.col("turn") < 1, F.struct("top")), ignorenulls=True).over(sweep))
    swept = swept.filter("turn = 1").select("url", F.col("edge.top").alias("top"))
    swept = swept.withColumn("fits", F.expr("top is not null and startswith(url.path, top.path) and (url.host = top.host or endswith(url.host, '.' || top.host))"))
    best = F.max(F.when(F.col("fits"), F.struct(F.length(F.concat("top.host", "top.path")).alias("n"), F.length("top.host").alias("h"), F.col("top.host").alias("host"), F.col("top.path").alias("path"), F.col("top.verdict").alias("verdict"))))
    out = swept.groupBy("url").agg(best.alias("best"))
    return out.select(
        F.col("url.id").alias(id_col), "url.host", "url.path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
