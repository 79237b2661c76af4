"""WARC archives: written by Spark's text writer, read back in splits with boundary-chain verification.

The magic line ``WARC/1.1`` can also occur inside a payload, and a reader that starts in the middle of a file can't
tell the two apart. Every occurrence is a candidate record; its header's length says where its successor would start.
Only candidates on the chain that begins at the file's start are records. Within a split the chain is followed in
the task, across splits by pointer jumping over the few candidates at which a chain can enter a split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.llm.scratch import Scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Copies of smaller payloads are stored again.
REVISIT_BYTES = 1000


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row: a response, or a revisit of the largest id with an equal payload of 1000 bytes or more.

    The payload is the html in UTF-8; a null one is empty. A null url leaves its header out; line breaks in a url are
    percent-encoded. A null id is written as ``null``; rows that repeat an id and payload are each a record of the same type.
    """
    scratch = Scratch(pages.sparkSession, "warc-copies")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    copies = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    copies = scratch.table(copies.filter("rows > 1").drop("rows"), "copies")
    if copies.count() <= 200_000:  # beyond that a sort-merge join
        copies = F.broadcast(copies)
    rows = rows.join(copies, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name("id")), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


def _bytes(value: Column, start: Column, length: Column) -> Column:
    return F.substring(value.cast("binary"), start + 1, length)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _candidates(spark: SparkSession, path: str | list[str], keep_all: bool) -> DataFrame:
    """The stretches between magic lines. The bytes are kept only of those that aren't a whole record each."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    raw = raw.withColumn("seq", F.monotonically_increasing_id()).withColumn("length", F.octet_length("value").cast("long"))
    raw = raw.withColumn("head", F.substring_index("value", END, 1)).withColumn("head_length", F.octet_length("head").cast("long") + 4)
    raw = raw.withColumn("block_length", F.when(F.col("head_length") <= F.col("length"), _header(F.col("head"), "Content-Length").try_cast("long")))
    whole = F.col("length") == F.col("head_length") + F.col("block_length") + 4
    raw = raw.withColumn("whole", F.coalesce(whole, F.lit(False)))
    block = _bytes(F.col("value"), F.col("head_length").cast("int"), F.col("block_length").cast("int"))
    return raw.select(
        "file", "split", "seq", "length", "head_length", "block_length", "whole", F.when(F.col("block_length").isNotNull(), F.col("head")).alias("head"),
        F.when(F.col("whole"), _payload(block)).alias("payload"), F.when(~F.col("whole") | F.lit(keep_all), F.col("value").cast("binary")).alias("bytes"),
    )


def _payload(block: Column) -> Column:
    """What follows the HTTP header of a block."""
    head = F.octet_length(F.substring_index(block.cast("string"), END, 1))
    return _bytes(block, head + 4, F.octet_length(block))


def _next_inside(starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    at = np.searchsorted(starts, after)
    good = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == after)
    return np.where(good, at, -1)


def _leave(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where its chain leaves the split."""
    rows = rows.sort_values("start")
    starts, after = rows["start"].to_numpy(), rows["after"].fillna(-1).to_numpy(dtype=np.int64)
    last = np.arange(len(rows))
    jump = _next_inside(starts, after)
    while (jump >= 0).any():
        last = np.where(jump >= 0, last[np.maximum(jump, 0)], last)
        jump = np.where(jump >= 0, jump[np.maximum(jump, 0)], -1)
    return pd.DataFrame({"file": rows["file"], "start": starts, "leaves": after[last]})


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from where it enters."""
    rows = rows.sort_values("start")
    starts = rows["start"].to_numpy()
    on = rows["enters"].to_numpy(dtype=bool)
    jump = _next_inside(starts, rows["after"].fillna(-1).to_numpy(dtype=np.int64))
    while (jump >= 0).any():
        on[jump[on & (jump >= 0)]] = True
        jump = np.where(jump >= 0, jump[np.maximum(jump, 0)], -1)
    return rows.loc[on, ["seq", "start", "file"]]


def _chain(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``file``, ``start`` and ``seq`` of the candidates that are records."""
    size = F.col("length") + len(MAGIC)
    splits = found.groupBy("file", "split").agg(F.sum(size).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("file", "split", "seq", "length", "head_length", "block_length", F.coalesce(F.sum(size).over(inside), F.lit(0)).alias("within"))
    places = places.join(splits, ["file", "split"]).withColumn("start", F.col("base") + F.col("within"))
    after = F.col("start") + F.col("head_length") + F.col("block_length") + 4 + len(MAGIC)
    places = scratch.table(places.select("file", "split", "seq", "start", "length", F.when(F.col("block_length") >= 0, after).alias("after")), "places")
    leaves = scratch.table(places.groupBy("file", "split").applyInPandas(_leave, "file string, start long, leaves long"), "leaves")
    heads = places.filter(F.col("start") == len(MAGIC)).select("file", "start")
    gates = leaves.select("file", F.col("leaves").alias("start")).distinct().union(heads).distinct().join(places.select("file", "start"), ["file", "start"], "left_semi")
    jump = scratch.table(leaves.join(gates, ["file", "start"]).select("file", "start", F.col("leaves").alias("to")), "jump")
    reached = scratch.table(heads, "reached")
    while True:
        step = jump.join(reached, ["file", "start"]).select("file", F.col("to").alias("start")).join(gates, ["file", "start"], "left_semi")
        more = scratch.table(step.join(reached, ["file", "start"], "left_anti").distinct(), "more")
        if more.isEmpty():
            break
        reached = scratch.table(reached.union(more), "reached")
        jump = scratch.table(jump.join(jump.select("file", F.col("start").alias("to"), F.col("to").alias("next")), ["file", "to"]).select("file", "start", F.col("next").alias("to")), "jump")
    marked = places.join(reached.withColumn("enters", F.lit(True)), ["file", "start"], "left").withColumn("enters", F.coalesce("enters", F.lit(False)))
    marked = marked.groupBy("file", "split").applyInPandas(_mark, "seq long, start long, file string")
    return scratch.table(places.join(marked.select("seq", F.lit(True).alias("record")), "seq", "left"), "marked")


def read_warc(spark: SparkSession, path: str | list[str], keep_payload: bool = True, keep_all: bool = False) -> DataFrame:
    """The records of all archives below ``path``: ``file``, ``offset``, ``head`` (the header lines), ``payload_bytes``, ``payload_digest`` and, if asked for, ``payload``.

    An empty file has no records. Payloads of records that contain the magic line are put together from their stretches.
    The bytes of a whole record are hashed where they are read and only shuffled if the payload is asked for.
    """
    scratch = Scratch(spark, "warc-read")
    found = _candidates(spark, path, keep_all)
    digest = [F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")]
    found = scratch.table(found.select("*", *digest).drop(*([] if keep_payload else ["payload"])), "candidates")
    marked = _chain(found, scratch)
    owner = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = marked.select("seq", "start", "record", F.last(F.when(F.col("record"), F.col("seq")), ignorenulls=True).over(owner).alias("of"))
    rows = found.join(owned, "seq")
    out = ["file", F.col("start").alias("start"), "head", "payload_bytes", "payload_digest", *(["payload"] if keep_payload else [])]
    whole = rows.filter("record and whole").select(*out)
    broken = found.join(marked.filter("record"), "seq", "left_semi").filter("not whole").select(F.col("seq").alias("of"))
    parts = scratch.table(rows.join(broken.join(marked.select(F.col("seq").alias("of")), "of", "left_semi"), "of", "left_semi"), "parts")
    lost = [r["file"] for r in parts.filter("bytes is null").select("file").distinct().limit(1).collect()]
    if lost and not keep_all:  # a payload holds what looks like a whole record
        return read_warc(spark, path, keep_payload, True)
    joined = parts.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("p"))
    stretch = F.transform("p", lambda x: F.when(x["start"] == F.col("p")[0]["start"], x["bytes"]).otherwise(F.concat(F.lit(MAGIC).cast("binary"), x["bytes"])))
    joined = joined.withColumn("bytes", F.aggregate(stretch, F.lit(b""), lambda a, x: F.concat(a, x)))
    first = parts.filter("record").select("of", "file", "start", "head", "head_length", "block_length")
    joined = joined.select("of", "bytes").join(first, "of").withColumn("payload", _payload(_bytes(F.col("bytes"), F.col("head_length").cast("int"), F.col("block_length").cast("int"))))
    joined = joined.select("file", "start", "head", *digest, *(["payload"] if keep_payload else []))
    return whole.unionByName(joined).withColumn("offset", F.col("start") - len(MAGIC)).drop("start")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as WARC archives, read these back, and describe each record.

    Returns the id, ``payload_bytes`` and ``payload_digest`` (hex SHA-1) of the full payload, ``record_type`` and ``refers_to``.
    What a revisit refers to is looked up among the responses that were read. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archive")
    write_warc(pages, path, id_col, url_col, html_col)
    name = lambda header: F.regexp_extract(_header(F.col("head"), header), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    records = read_warc(spark, path, keep_payload=False).select(
        name("WARC-Record-ID").alias("id"), "payload_bytes", "payload_digest", _header(F.col("head"), "WARC-Type").alias("record_type"),
        name("WARC-Refers-To").alias("refers_to"), F.substring_index(_header(F.col("head"), "WARC-Payload-Digest"), ":", -1).alias("stated"),
    )
    records = Scratch(spark, "warc-records").table(records, "records")
    responses = records.filter("record_type = 'response'").groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.first("payload_bytes").alias("bytes"))
    revisits = records.filter("record_type = 'revisit'").join(responses, ["refers_to", "stated"], "left")
    out = records.filter("record_type = 'response'").select("id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    out = out.union(revisits.select("id", "bytes", "stated", "record_type", "refers_to"))
    return out.withColumnRenamed("id", id_col)
