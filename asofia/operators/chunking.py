"""Passages: text split into blocks with exact offsets, carried headings, greedy packing, merging of tiny ones."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.functions import text

SEPARATOR = "\n\n"
MAX_WORDS, MIN_WORDS, GROWTH = 220, 40, 1.25
HEADING_WORDS, SENTENCE_WORDS = 14, 3
#: Documents that are taken apart at once.
DOCUMENTS = 512
# Fixed patterns: what the regulator's headings look like. Only ASCII letters go on with a word, and only these are spaces, whatever the engine's own classes say.
CHAPTER = r"(?i)^(chapter|part|annex(ure)?|appendix|[s\u017f]chedule)(?![A-Za-z0-9_])"
SECTION = r"^(\d{1,3}[A-Z]?\.|[A-Z]\.)[ \t\n\f\r]+[^ \t\n\f\r]"
WORD, SENTENCE_END = r"[^ \t\n\f\r]+", r"[.;:]\z"
# Fixed pattern: where a long block may be cut.
SENTENCE = re.compile(r"[^.;\n]+(?:[.;\n]+|$)")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ord, block, char_start, char_end``: offsets count characters of the text and slice back to the block. Columns that are ``carried`` come along.

    A document's blocks are placed in its row, batch by batch, so nothing is shuffled or joined; a null text has none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(text_col, SEPARATOR).alias("rows"), *carried).filter("rows is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kinds = {"doc_id": kinds["doc_id"], "ord": "long", "block": "string", "char_start": "long", "char_end": "long"} | {c: kinds[c] for c in carried}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(low, DOCUMENTS)
                lists, block = part.column(1), part.column(1).flatten()
                size = pc.list_value_length(lists).to_numpy().astype(np.int64)
                first = np.repeat(np.cumsum(size) - size, size)
                length = pc.utf8_length(block).to_numpy().astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(length + len(SEPARATOR))])
                start, doc = upto[:-1] - upto[first], pa.array(np.repeat(np.arange(len(size)), size))
                columns = [part.column(0).take(doc), pa.array(np.arange(len(first)) - first), block, pa.array(start), pa.array(start + length), *(part.column(2 + i).take(doc) for i in range(len(carried)))]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ord, block`` and what is ``carried``: blocks without their offsets."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *carried, F.posexplode(F.split(text_col, SEPARATOR)).alias("ord", "block"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "block", *carried)


def heading_kind(block: Column) -> Column:
    """"chapter", "section" or null, by the block's first line; lines that read like sentences are no headings."""
    line = text.first_line(block)
    words = F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    sentence = (words > HEADING_WORDS) | (line.rlike(SENTENCE_END) & (words > SENTENCE_WORDS))
    return F.when(sentence, None).when(line.rlike(CHAPTER), "chapter").when(line.rlike(SECTION), "section")


def headings(rows: DataFrame, known: Column | None = None) -> DataFrame:
    """Adds ``kind``, ``words`` and ``heading`` ("chapter > section"): both are carried forward, a new chapter ends the section.

    ``known`` is the kind of blocks that open a chapter or a section whatever their first line looks like, such as sections numbered beyond 999; null leaves it to the line.
    """
    kind = F.when(F.trim("block") != "", heading_kind(F.col("block")))
    rows = rows.withColumn("kind", kind if known is None else F.coalesce(known, kind)).withColumn("line", text.first_line(F.col("block")))
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = rows.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter", F.col("line")), True).over(order))
    rows = rows.withColumn("part", F.count(F.when(F.col("kind") == "chapter", 1)).over(order))
    within = Window.partitionBy("doc_id", "part").orderBy("ord")
    rows = rows.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("line")), True).over(within))
    heading = F.nullif(F.concat_ws(" > ", "chapter", "section"), F.lit(""))
    return rows.select("doc_id", "ord", "block", "char_start", "char_end", "kind", text.word_count(F.col("block")).cast("long").alias("words"), heading.alias("heading"))


def _cut(block: str, start: int, most: int) -> list[tuple[int, int]]:
    """Offsets of a long block's parts, each closed by the sentence end at which it reaches the limit."""
    sentences = list(SENTENCE.finditer(block))
    ends = [m.end() for m in sentences]
    upto = list(accumulate(len(m.group().split()) for m in sentences))  # words up to each sentence end
    bounds = [0]
    closing = bisect_left(upto, most)
    while closing < len(ends):
        bounds.append(ends[closing])
        closing = bisect_left(upto, upto[closing] + most)
    inner = [(a, b) for a, b in pairwise(dict.fromkeys([*bounds, len(block)])) if not block[a:b].isspace()]
    return [(start + b - len(block[a:b].lstrip()), start + a + len(block[a:b].rstrip())) for a, b in inner]


def _pieces(rows: Iterator[tuple[str, int, int, str | None, int, str | None]], most: int) -> Iterator[tuple[int, int, str | None, int, bool, bool]]:
    """Start, end, heading and words of what is packed, whether it has to open a passage, and whether nothing may follow in that passage."""
    for block, start, end, kind, words, heading in rows:
        if words > most:
            for a, b in _cut(block, start, most):
                yield a, b, heading, len(block[a - start : b - start].split()), True, True
        elif block.strip():
            yield start, end, heading, words, kind is not None, False


def pack(rows: Iterator[tuple[str, int, int, str | None, int, str | None]], most: int = MAX_WORDS, least: int = MIN_WORDS) -> Iterator[tuple[int, int, str | None]]:
    """Spans of one document's passages from its blocks (text, start, end, kind, words, heading), in order, in one go.

    The open passage takes pieces up to ``most`` words. One with fewer than ``least`` isn't let go: the next begins where it does, with its own
    heading and its own room. Only the last can be that short, and goes into the one before it if that doesn't grow too much.
    """
    ready = begin = finish = title = None
    total, room = 0, -1
    for start, end, heading, words, opens, shut in _pieces(rows, most):
        if not opens and words <= room:
            finish, total, room = end, total + words, room - words
            continue
        if begin is None or total >= least:
            if begin is not None:
                if ready:
                    yield ready[:3]
                ready = (begin, finish, title, total)
            begin, total = start, 0
        finish, title, total, room = end, heading, total + words, -1 if shut else most - words
    if begin is None:
        return
    if ready and total < least and ready[3] + total <= int(most * GROWTH):
        yield ready[0], finish, ready[2]
        return
    if ready:
        yield ready[:3]
    yield begin, finish, title


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text", most: int = MAX_WORDS, least: int = MIN_WORDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ord, text, char_start, char_end, heading`` and what is ``carried``. A document's blocks stay in its row, so nothing is shuffled; a null text has no passages.

    Some documents' passages at once leave a task as one batch.
    """
    found = lambda b: F.struct(b.alias("block"), F.when(F.trim(b) != "", heading_kind(b)).alias("kind"), text.word_count(b).alias("words"), text.first_line(b).alias("line"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(F.split(text_col, SEPARATOR), found).alias("rows"), *carried).filter("rows is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kinds = {"doc_id": "long", "ord": "long", "text": "string", "char_start": "long", "char_end": "long", "heading": "string"} | {c: kinds[c] for c in carried}

    def headed(blocks: Iterator[tuple[str, str | None, int, str]]) -> Iterator[tuple[str, int, int, str | None, int, str | None]]:
        chapter = section = None
        start = 0
        for block, kind, words, line in blocks:
            if kind == "chapter":
                chapter, section = line, None
            elif kind == "section":
                section = line
            end = start + len(block)
            yield block, start, end, kind, words, " > ".join(h for h in (chapter, section) if h is not None) or None
            start = end + len(SEPARATOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(low, DOCUMENTS)
                fields = [f.to_pylist() for f in part.column(1).flatten().flatten()]
                size, out, upto = [], [], 0
                for n in pc.list_value_length(part.column(1)).to_pylist():
                    blocks = [f[upto : upto + n] for f in fields]
                    body, before = SEPARATOR.join(blocks[0]), len(out)
                    out += [(i, body[a:b], a, b, h) for i, (a, b, h) in enumerate(pack(headed(zip(*blocks, strict=True)), most, least))]
                    size.append(len(out) - before)
                    upto += n
                doc = pa.array(np.repeat(np.arange(len(size)), size))
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), *columns, *(part.column(2 + i).take(doc) for i in range(len(carried)))], names=list(kinds))

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


#: What ``with_context`` needs of a passage's document.
CONTEXT = ("title", "valid_from", "valid_to")


def with_context(chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Adds the context (title and heading), what is embedded, and the document's window, which ``docs`` has or the passages carry (``CONTEXT``)."""
    rows = chunks if docs is None else chunks.join(docs.select("doc_id", *CONTEXT), "doc_id")
    rows = rows.withColumn("context", F.concat_ws("\n", "title", "heading"))
    return rows.withColumn("embed_text", F.concat_ws(SEPARATOR, "context", "text")).drop("title")


def pending_documents(docs: DataFrame, chunks: DataFrame, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Documents with text and no passages yet, newest first, or in any order where all are taken."""
    rows = docs.filter("text is not null and text <> ''").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = rows.orderBy(F.desc("issued_date"), "doc_id") if ordered or limit else rows
    return rows.limit(limit) if limit else rows


def pending_embeddings(chunks: DataFrame, docs: DataFrame, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Passages without a vector, in the order in which they are embedded, or in any where all are taken; running it again goes on where the last run ended."""
    rows = chunks.filter("embedding is null").join(docs.select("doc_id", "issued_date"), "doc_id")
    rows = rows.orderBy(F.desc("issued_date"), "doc_id", "ord") if ordered or limit else rows
    return rows.limit(limit) if limit else rows
