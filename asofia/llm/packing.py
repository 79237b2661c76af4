"""Packing token sequences as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofia.llm import textkernel as tk
from asofia.llm.scratch import Scratch
from asofia.llm.wordtable import Sequences, gather

CAPACITY = 4096
END_ID = 2
#: Lengths are planned in steps of this many tokens.
STEP = 16
#: A Python worker remembers words in 2**TABLE_BITS slots and POOL_IDS ids at most; both together hold 32 MB.
TABLE_BITS, POOL_IDS = 20, 4_000_000
SHARD_PIECES = 200_000

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[tk.SEPARATOR] = 0
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[128:] = _LETTER  # U+00C0 to U+00FF without the signs U+00D7 and U+00F7; other characters don't come here
_KIND[list(b"0123456789")] = _DIGIT

#: Stands between words that go to the tokenizer together.
MARK = b" \x01 "

_encoders: dict[str, Encoder] = {}


def _pretokens(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's own pre-tokens in words of ASCII and Latin-1 letters: letter runs, digits, runs of other characters,
    and the endings 's 't 're 've 'm 'll 'd. Words marked ``whole`` stay in one part."""
    n = len(low)
    kind = _KIND[low]
    word_start = np.zeros(n + 3, dtype=bool)
    word_start[starts] = True
    word_start[n:] = True
    begin = word_start.copy()
    begin[:n] |= kind == _DIGIT
    begin[1:n] |= kind[1:] != kind[:-1]
    # an apostrophe that begins a run and an ending behind it make one part
    at = np.flatnonzero(low == 39)
    at = at[begin[at] & ~word_start[at + 1]]
    one, two = (np.append(low, [0, 0])[at + k] for k in (1, 2))
    short = np.isin(one, list(b"stmd"))
    pair = np.isin(one.astype(np.int64) << 8 | two, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")]) & ~word_start[at + 2]
    begin[at[short | pair] + 1] = False
    begin[at[short] + 2] = True
    begin[at[pair] + 3] = True
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts[~whole]] += 1
    inside[ends[~whole]] -= 1
    begin[:n] &= np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    begin[starts] = True
    first = np.flatnonzero(begin[:n])
    word = np.searchsorted(starts, first, "right") - 1
    return first, np.minimum(np.append(first[1:], n), ends[word])


class Encoder:
    """A tokenizer with a memory of words. It drops white space and never joins what it separates, so a text's ids are those of its parts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        (self.mark,) = self._ids(MARK.decode())
        self.known = Sequences(TABLE_BITS, POOL_IDS)

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _new(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ids of parts end to end, and where each part's begin and how many it has.

        Pre-tokens, each of which ends with its only word-end id, go to the tokenizer many at a time with spaces between; those
        that are ``whole`` words with a control character between, and those that may hold that one or a special token ``alone``.
        """
        ids, size = [np.zeros(0, np.uint32)], np.zeros(len(starts), dtype=np.int64)
        plain, joined, single = (np.flatnonzero(x) for x in (~whole, whole & ~alone, whole & alone))
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            got = self._ids(gather(low, starts[part], ends[part], after=b" ").tobytes().decode(errors="replace"))
            size[part] = np.diff(np.flatnonzero(self.is_last[got]), prepend=-1)
            ids.append(got)
        for at in range(0, len(joined), 4096):
            part = joined[at : at + 4096]
            got = self._ids(gather(low, starts[part], ends[part], after=MARK).tobytes().decode(errors="replace"))
            mark = got == self.mark
            size[part] = np.diff(np.flatnonzero(mark), prepend=-1) - 1
            ids.append(got[~mark])
        for i in single.tolist():
            ids.append(self._ids(low[starts[i] : ends[i]].tobytes().decode(errors="replace")))
            size[i] = len(ids[-1])
        order = np.concatenate([plain, joined, single])
        begin = np.empty(len(order), dtype=np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(ids), {"start": begin, "size": size}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with END_ID after it, and their offsets.

        ASCII capitals are lowered first, as the tokenizer does itself, but not in words with '<|', which may spell a special token.
        Words with characters beyond Latin-1's letters are not cut into pre-tokens here.
        """
        data, offs = tk.byte_column(column)
        starts, ends = tk.spans(~tk.SEPARATOR[data], offs)
        count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        wide = data >= 128
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        wide[latin] = wide[latin + 1] = False
        wide = count(wide)
        whole = wide[ends] > wide[starts]
        alone = np.zeros(len(starts), dtype=bool)
        low = tk.LOWER[data]
        pipes = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        marks = np.flatnonzero(data == MARK[1])
        if len(pipes) or len(marks):
            alone[np.searchsorted(starts, np.concatenate([pipes, marks]), "right") - 1] = True
            for a, b in zip(starts[alone], ends[alone], strict=True):
                low[a:b] = data[a:b]
            whole |= alone
        first, last = _pretokens(low, starts, ends, whole)
        hashes = tk.hash_spans(low, first, last)

        def work(at):
            word = np.searchsorted(starts, first[at], "right") - 1
            return self._new(low, first[at], last[at], whole[word], alone[word])

        pool, found = self.known.get(hashes, work)
        pool = np.append(pool, np.uint32(END_ID))
        rows = len(offs) - 1
        row = tk.row_of(first, offs)
        end = np.cumsum(np.bincount(row, minlength=rows)) + np.arange(rows)  # each row's parts, then the end
        order = np.arange(len(first)) + row
        begins, sizes = np.full(len(first) + rows, len(pool) - 1), np.ones(len(first) + rows, dtype=np.int64)
        begins[order], sizes[order] = found["start"], found["size"]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = pool[np.arange(total[-1]) + np.repeat(begins - total[:-1], sizes)]
        return ids, np.concatenate([[0], total[end + 1]])


def _pieces(path: str, capacity: int):
    def run(batches):
        encoder = Encoder.load(path)
        for batch in batches:
            for part in tk.pieces(batch, 1, max_bytes=1 << 20):
                ids, offs = encoder.encode(part.column(1))
                tokens = np.diff(offs)
                pieces = -(-tokens // capacity)
                row = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(tokens[row] - start, capacity)
                first = offs[row] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[row]))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize each text and cut it after every ``capacity`` ids: full pieces fill a sequence alone, only last pieces need packing."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return docs.mapInArrow(_pieces(tokenizer, capacity), "id long, start long, length long, ids_crc32 long, doc_tokens long")


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: how often to take each size so that the value is greatest."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fit = int(np.searchsorted(sizes, room, "right"))
        if fit:
            with_one = value[room - sizes[:fit]] + values[:fit]
            at = int(with_one.argmax())
            if with_one[at] > value[room] + 1e-12:
                value[room], took[room] = with_one[at], at
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return value[capacity], pattern


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many pieces of each size) and how often to use each, so that all pieces are placed.

    The linear program over patterns starts with one pattern per size; the knapsack prices further ones until none
    improves the bound by more than ``gap``, or ends after ``rounds`` patterns; all pieces are placed however early it ends. Whole
    uses are kept; what rounding leaves over is placed largest first.
    """
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order].astype(float)
    basis = np.diag(capacity // sizes).astype(float)
    used = counts / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = _best_pattern(sizes, dual, capacity)
        if value <= 1 + gap:
            break
        change = np.linalg.solve(basis, pattern)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        used = np.maximum(used - step * change, 0)
        used[out] = step
        basis[:, out] = pattern
    times = np.floor(used + 1e-7).astype(np.int64)
    left = (counts - basis @ times).round().astype(np.int64)
    while (left < 0).any():  # a use that was rounded up by the tolerance takes too much
        p = int(np.flatnonzero((basis[np.argmin(left)] > 0) & (times > 0))[0])
        times[p] -= 1
        left = (counts - basis @ times).round().astype(np.int64)
    back = np.argsort(order)
    out = [(basis[:, p].astype(np.int64)[back], int(times[p])) for p in range(len(sizes)) if times[p]]
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        times_left = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= pattern * times_left
        out.append((pattern[back], times_left))
    return out


def _slots(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """For each size and pattern: the range of ranks it takes, how many a sequence, and the pattern's first sequence."""
    taken, sequence, out = np.zeros(len(sizes), dtype=np.int64), 0, []
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            out.append((int(sizes[i]), int(taken[i]), int(taken[i] + pattern[i] * times), int(pattern[i]), sequence))
            taken[i] += pattern[i] * times
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Deal pieces (``id, start, length, ids_crc32, doc_tokens``) to sequences of at most ``capacity`` tokens.

    Adds ``sequence_id`` and the gapless ``offset``. Only the histogram of lengths in steps of 16 tokens (256 rows
    at most) reaches the driver, where the linear program runs; the plan that goes back has some thousand rows at
    most, whatever the input. Pieces of one size are ranked in shards, so a common length isn't one task's.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / step).cast("int"))
    count = pieces.count()
    shards = 16 + count // SHARD_PIECES
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(shards)))
    tally = pieces.groupBy("size", "shard").agg(F.count(F.lit(1)).alias("n"))
    histogram = sorted((r["size"], r["n"]) for r in tally.groupBy("size").agg(F.sum("n").alias("n")).collect())
    sizes = np.array([s for s, _ in histogram], dtype=np.int64)
    patterns = plan(sizes, np.array([n for _, n in histogram]), capacity // step) if histogram else []
    slots = spark.createDataFrame(_slots(sizes, patterns), "size int, low long, high long, each long, first long")
    base = tally.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("size", "shard", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = pieces.withColumn("local", F.row_number().over(Window.partitionBy("size", "shard").orderBy(F.desc("length"), "id", "start")) - 1)
    ranked = ranked.join(base, ["size", "shard"]).withColumn("rank", F.col("base") + F.col("local"))
    dealt = ranked.join(F.broadcast(slots), "size").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return dealt.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Tokenize all texts and pack them; one row per piece, every id in exactly one piece.

    Null, empty and wordless texts hold the end id alone. Rows that repeat an id, or have a null one, are packed as
    documents of their own. Other columns are ignored; an empty table gives an empty table. Each text is tokenized
    once, with ``tokenizer`` (a file path that every executor can read); the pieces are then a written table.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    return pack(pieces, capacity, step).withColumnRenamed("id", id_col)
