"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.llm import textkernel as tk
from asofia.llm.scratch import Scratch

GRAM = 3
ACCEPT = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds whose offsets between document and item differ by up to half of this belong to one passage.
SPAN = 32
#: Bits of the filter that spares the join most n-grams: 2 MB, whatever the size of the benchmark.
FILTER_BITS = 1 << 24
#: Item grams that are broadcast at most (24 bytes each); beyond that they meet the hits in a shuffle.
BROADCAST_GRAMS = 1_000_000
#: Ids of documents with candidates that are broadcast at most.
BROADCAST_IDS = 500_000
#: Lists that a document's candidates are dealt to.
LISTS = 8
#: Words of texts that are aligned at once, padding included. A longer pair is aligned alone.
CELLS = 1 << 16

_PLAIN = tk.LOWER.copy()
_PLAIN[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = 32


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, with A-Z lowered and ASCII punctuation taken as space."""
    data, offs = tk.byte_column(column)
    h, row, _, _ = tk.words(_PLAIN[data], offs)
    return h, row


def _item_grams(batches):
    for batch in batches:
        for piece in tk.pieces(batch, 1):
            h, row = plain_words(piece.column(1))
            grams, first = tk.windows(h, row, GRAM)
            start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=piece.num_rows))])[row[first]]
            columns = [piece.column(0).take(pa.array(row[first])), pa.array(grams.view(np.int64)), pa.array(first - start)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "gram", "at"])


def _find(bitmap: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, 1):
                h, row = plain_words(piece.column(1))
                grams, first = tk.windows(h, row, GRAM)
                slot = (grams % tk.U64(FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((bitmap[slot >> 3] >> (slot & 7)) & 1)
                grams, first = grams[hit], first[hit]
                start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=piece.num_rows))])[row[first]]
                columns = [piece.column(0).take(pa.array(row[first])), pa.array(grams.view(np.int64)), pa.array(first - start)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "gram", "pos"])

    return run


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its passage, and where in the passage it ends.

    Word hashes, one pair per row, padded with 0 (items) and 1 (passages). A gap along the passage is a running
    maximum, so each step handles one item word of all pairs and all passage positions at once.
    """
    n, width = passages.shape
    slope = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((n, width), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(items.shape[1]):
        gain = np.where(items[:, i : i + 1] == passages, MATCH, MISMATCH).astype(np.int32)
        gain[:, 1:] += above[:, :-1]
        here = np.maximum(np.maximum(gain, above + GAP), 0)
        here = np.maximum(here, np.maximum.accumulate(here + slope, axis=1) - slope)
        at = here.argmax(axis=1)
        top = here[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = here
    return best, end


def _batches(size: np.ndarray):
    """Indices of pairs of similar size, so many that the longest times their number stays within CELLS."""
    order, low = np.argsort(size, kind="stable"), 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * size[order[high]] <= CELLS and high - low < 256:
            high += 1
        yield order[low:high].tolist()
        low = high


def _score(accept: float):
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64())])

    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, 1, max_rows=512):
                doc, doc_row = plain_words(piece.column(1))
                found = piece.column(2).flatten()
                owner_row = np.repeat(np.arange(piece.num_rows), pc.list_value_length(piece.column(2)).to_numpy())
                item, item_row = plain_words(found.field("item_body"))
                doc_at, item_at = np.searchsorted(doc_row, np.arange(piece.num_rows + 1)), np.searchsorted(item_row, np.arange(len(found) + 1))
                owner, cuts = [], []
                for r, starts in enumerate(found.field("starts").to_pylist()):
                    base = doc_at[owner_row[r]]
                    m, n = item_at[r + 1] - item_at[r], doc_at[owner_row[r] + 1] - base
                    for s in starts:
                        a, b = max(0, s - SPAN), min(n, s + 2 * SPAN + m)
                        # the score can't pass the share of the item's words that the passage has at all
                        if b > a and m and np.isin(item[item_at[r] : item_at[r + 1]], doc[base + a : base + b]).sum() >= accept * m:
                            owner.append(r)
                            cuts.append((a, b))
                for some in _batches(np.array([max(item_at[r + 1] - item_at[r], b - a) for r, (a, b) in zip(owner, cuts, strict=True)], dtype=np.int64)):
                    rows, part = [owner[i] for i in some], [cuts[i] for i in some]
                    words = [int(item_at[r + 1] - item_at[r]) for r in rows]
                    left = np.zeros((len(rows), max(words)), dtype=np.uint64)
                    right = np.ones((len(rows), max(b - a for a, b in part)), dtype=np.uint64)
                    for k, (r, (a, b)) in enumerate(zip(rows, part, strict=True)):
                        left[k, : words[k]] = item[item_at[r] : item_at[r + 1]]
                        right[k, : b - a] = doc[doc_at[owner_row[r]] + a : doc_at[owner_row[r]] + b]
                    best, end = align(left, right)
                    score = best / (MATCH * np.array(words))
                    good = np.flatnonzero(score >= accept)
                    pick = np.array(rows)[good]
                    ends = np.array([a for a, _ in part])[good] + end[good] + 1
                    columns = [piece.column(0).take(pa.array(owner_row[pick])), found.field("item").take(pa.array(pick)), pa.array(score[good]), pa.array(ends)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Pairs of a document and a benchmark item that one of its passages copies, with edits or without.

    Returns the id, ``item_id``, ``score`` and ``end_word`` (the passage's last word, counted from 1) of the best passage. The score
    is the Smith-Waterman score over words (match 2, mismatch and gap -1) as a share of the item's score with itself. Pairs that score
    ``accept`` or more and have three words of the item in a row somewhere are returned; a copy that is edited so evenly that no such gram is
    left (every third word changed, say) isn't found, whatever its score. A pair's verdict does not depend on the other rows. Documents without such a passage have no row.

    Every three-word gram of an item is a seed, and one makes a candidate, however frequent it is; of a candidate only passages that have enough of the item's words
    are aligned. Items and texts that are null, empty or have fewer than three words match nothing, as do rows with a null id. For an id that repeats the best of
    its texts counts. Other columns are ignored; empty tables give an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).filter("id is not null and body is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("item_body")).filter("item is not null and item_body is not null")
    grams = scratch.table(items.mapInArrow(_item_grams, "item long, gram long, at long"), "grams")
    slot = F.expr(f"mod(mod(gram, {FILTER_BITS}) + {FILTER_BITS}, {FILTER_BITS})")
    octets = grams.select(slot.alias("slot")).groupBy((F.col("slot") / 8).cast("int").alias("octet")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    found = octets.toPandas()  # of a fixed number of octets
    bitmap[found["octet"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.uint8)

    hits = docs.mapInArrow(_find(bitmap), "id long, gram long, pos long")
    # a broadcast leaves hits where they are, however many of them one frequent gram has; else Spark splits a skewed join
    small = grams.count() <= BROADCAST_GRAMS
    near = hits.join(F.broadcast(grams) if small else grams, "gram").select("id", "item", (F.col("pos") - F.col("at")).alias("shift"))
    near = near.withColumn("start", F.explode(F.array(*(F.floor((F.col("shift") + k) / SPAN) * SPAN - k for k in (0, SPAN // 2)))))
    pairs = near.groupBy("id", "item").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    pairs = scratch.table(pairs, "pairs")
    # a document's candidates are a few lists beside one copy of its text; both are shuffled by document, texts without candidates are left out before while ids are few
    lists = pairs.join(items, "item").groupBy("id", F.pmod(F.xxhash64("item"), F.lit(LISTS)).alias("part")).agg(F.collect_list(F.struct("item", "starts", "item_body")).alias("found"))
    wanted = pairs.select("id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(wanted), "id", "left_semi")
    texts = docs.join(lists.hint("merge"), "id")
    scored = texts.select("id", "body", "found").mapInArrow(_score(accept), "id long, item long, score double, end_word long")
    best = scored.groupBy("id", "item").agg(F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "best.score", (-F.col("best.e")).alias("end_word"))
