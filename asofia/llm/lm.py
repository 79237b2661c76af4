"""LM scoring by masked pseudo-likelihood: a network over a window predicts every word from both of its sides.

The words around a position, two on each side, each add an embedding of their own for that distance; a tanh layer follows,
and two softmax layers give the masked word's class and its place in the class, together its slot. The most frequent
words have a slot each; the others share slots, and a third level, by their counts in the whole corpus, tells the words of a
slot apart. That table grows with the corpus. A text's score is the sum of log P(word | both sides).

Training covers the whole corpus in synchronous rounds. The first one starts from the words' own frequencies, so whatever the sides add
comes on top of these. In each round every task trains a copy of the current network on a share of its texts, and the copies
are averaged by their number of words, layer slice by layer slice, in a Spark aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.llm import textkernel as tk
from asofia.llm.scratch import Scratch

CLASSES, PLACES = 32, 64  # vocabulary: CLASSES * PLACES words
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
#: Positions of a step, and the first round's pace; the pace falls evenly to a ROUNDSth part.
BATCH, RATE = 8192, 0.05
#: A pass over a table is so many rounds, each on another share of its texts; every table is gone over PASSES times.
ROUNDS, PASSES = 4, 2
#: Small files are read together, so that a copy of the network sees so many words.
COPY_WORDS = 1_000_000
#: Entries that a counting task brings together before it sends them (16 bytes each).
COUNT_ROWS = 2_000_000
#: Counts of words that are broadcast at most (12 bytes each); beyond that, texts' words and their counts meet in a join.
BROADCAST_WORDS = 4_000_000
#: Positions whose places are worked out at once, so that their logits stay in the processor's cache.
ROWS = 512
#: Parameters that one row of the averaging holds.
SLICE = 8192
#: Slots; one more for what lies before a text's first and after its last word.
VOCABULARY = CLASSES * PLACES
#: The most frequent words, with a slot each; a power of two, as is the number of shared slots.
OWN = VOCABULARY // 2
PAD = VOCABULARY

_SHAPES = {
    "context": (len(OFFSETS), VOCABULARY + 1, WIDTH),
    "bias": (WIDTH,),
    "class_out": (WIDTH, CLASSES),
    "class_bias": (CLASSES,),
    "place_out": (CLASSES, WIDTH, PLACES),
    "place_bias": (CLASSES, PLACES),
}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_ONES = np.ones(max(BATCH, CLASSES, PLACES), dtype=np.float32)


@dataclass
class Words:
    """Counts of the corpus: ``own`` are the words with a slot each, by rank; ``word`` and ``log_count`` those of the shared slots
    found more than once, sorted; ``log_total`` is of each shared slot's words together, ``slot_n`` counts the words of each
    slot, ``seen`` all words. Beyond BROADCAST_WORDS ``word`` stays empty and ``table`` has the counts."""

    own: np.ndarray
    word: np.ndarray
    log_count: np.ndarray
    log_total: np.ndarray
    slot_n: np.ndarray
    seen: int = 0
    table: DataFrame | None = None

    @classmethod
    def none(cls) -> Words:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(VOCABULARY), np.zeros(VOCABULARY))

    def log_share(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log P(word | its slot). A word found once, or in no text of the corpus, has one count of its slot's total plus one."""
        out = -self.log_total[ids]
        if len(self.word):
            shared = np.flatnonzero(ids >= OWN)
            hashes = hashes[shared]
            at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
            out[shared] += np.where(self.word[at] == hashes, self.log_count[at], 0)
        return out


@dataclass
class Network:
    context: np.ndarray
    bias: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray
    place_out: np.ndarray
    place_bias: np.ndarray
    words: Words = field(default_factory=Words.none)

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        at, parts = 0, {}
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            parts[name] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return cls(**parts)

    @classmethod
    def start(cls, slot_n: np.ndarray | None = None) -> Network:
        """The same small random weights wherever training begins, with biases by which each slot has the share of its count plus one."""
        net = cls.of(np.random.default_rng(7).normal(0, 0.1, SIZE))
        count = (np.zeros(VOCABULARY) if slot_n is None else slot_n).reshape(CLASSES, PLACES) + 1
        net.bias[:] = 0
        net.class_bias[:] = np.log(count.sum(axis=1) / count.sum())
        net.place_bias[:] = np.log(count / count.sum(axis=1, keepdims=True))
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in _SHAPES])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.context[0].take(around[0], axis=0)
        total += self.bias
        more = np.empty_like(total)
        for k in range(1, len(OFFSETS)):
            total += self.context[k].take(around[k], axis=0, out=more, mode="clip")
        return np.tanh(total, out=total)


def word_ids(column: pa.Array, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each word (A-Z lowered), its row, the slots around it (one line per offset), and its hash."""
    data, offs = tk.byte_column(column)
    h, row, _, _ = tk.words(data, offs, tk.LOWER)
    ids = (OWN + (h & tk.U64(VOCABULARY - OWN - 1))).astype(np.int32)
    if len(own):
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own[order], h), len(own) - 1)
        ids = np.where(own[order][at] == h, order[at], ids).astype(np.int32)
    around = np.full((len(OFFSETS), len(ids)), PAD, dtype=np.int32)
    for k, d in enumerate(OFFSETS):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))  # word, neighbour
        same = row[a] == row[b]
        around[k, a] = np.where(same, ids[b], PAD)
    return ids, row, around, h


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place and their sums by row. Logits stay near log-probabilities; the bound only keeps float32 from overflowing."""
    if logits.max(initial=0) > 60:
        np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ _ONES[: logits.shape[1]]


def _sorted_by_class(ids: np.ndarray) -> np.ndarray:
    """Places of the slots in the order of their classes."""
    return np.argsort((ids // PLACES).astype(np.uint8), kind="stable")


def log_probs(net: Network, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(word | the words around it) of each position."""
    out = np.empty(len(ids))
    for low in range(0, len(ids), 2 * BATCH):
        order = low + _sorted_by_class(ids[low : low + 2 * BATCH])
        kind, place = np.divmod(ids[order], PLACES)
        h = net.hidden(around.take(order, axis=1))
        rows = np.arange(len(order))
        logits = h @ net.class_out + net.class_bias
        found = np.minimum(logits[rows, kind], 60)
        found -= np.log(_exp(logits)[1])
        at, total = np.empty_like(found), np.empty_like(found)
        flat = rows * PLACES + place
        bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
        buffer = np.empty((ROWS, PLACES), dtype=np.float32)
        for c in range(CLASSES):
            for a in range(bounds[c], bounds[c + 1], ROWS):
                b = min(a + ROWS, bounds[c + 1])
                inner = np.matmul(h[a:b], net.place_out[c], out=buffer[: b - a])
                inner += net.place_bias[c]
                inner.ravel().take(flat[a:b] - a * PLACES, out=at[a:b], mode="clip")
                total[a:b] = _exp(inner)[1]
        found += np.minimum(at, 60)
        found -= np.log(total)
        out[order] = found
    return out


class Trainer:
    """Steps of gradient ascent on the log-probability, each parameter's pace set by its own past gradients (Adam)."""

    def __init__(self, net: Network):
        self.flat, self.steps = net.flat(), 0
        self.net = Network(**self._views(self.flat), words=net.words)
        self.mean, self.square, self.grad, self.work = (np.zeros_like(self.flat) for _ in range(4))
        self.parts, self.logits = self._views(self.grad), np.empty((ROWS, PLACES), dtype=np.float32)

    @staticmethod
    def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters as parts of one array."""
        ends = np.cumsum([int(np.prod(shape)) for shape in _SHAPES.values()])
        return {name: part.reshape(shape) for (name, shape), part in zip(_SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}

    @staticmethod
    def _push(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradient of the target's log-probability by the logits, in their place; ``target`` counts through all logits."""
        push, total = _exp(logits)
        push *= (-1 / total)[:, None]
        push.ravel()[target] += 1
        return push

    def gradient(self, ids: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Sums over the positions, in arrays that the next call overwrites."""
        net, grad = self.net, self.parts
        if (ids[1:] // PLACES < ids[:-1] // PLACES).any():
            order = _sorted_by_class(ids)
            ids, around = ids[order], around.take(order, axis=1)
        kind, place = np.divmod(ids, PLACES)
        rows, ones = np.arange(len(ids)), np.ones(len(ids), dtype=np.float32)
        h = net.hidden(around)
        self.grad[:] = 0
        logits = h @ net.class_out
        logits += net.class_bias
        push = self._push(logits, rows * CLASSES + kind)
        back = push @ net.class_out.T
        grad["class_out"][:], grad["class_bias"][:] = h.T @ push, ones @ push
        bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
        target = rows * PLACES + place
        for c in range(CLASSES):
            for a in range(bounds[c], bounds[c + 1], ROWS):
                b = min(a + ROWS, bounds[c + 1])
                logits = np.matmul(h[a:b], net.place_out[c], out=self.logits[: b - a])
                logits += net.place_bias[c]
                inner = self._push(logits, target[a:b] - a * PLACES)
                back[a:b] += inner @ net.place_out[c].T
                grad["place_out"][c] += h[a:b].T @ inner
                grad["place_bias"][c] += ones[a:b] @ inner
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        grad["bias"][:] = ones @ back
        columns = np.ascontiguousarray(back.T, dtype=np.float64)
        for k, near in enumerate(around.astype(np.int64)):
            for j in range(WIDTH):
                grad["context"][k, :, j] = np.bincount(near, columns[j], VOCABULARY + 1)
        return grad

    def step(self, ids: np.ndarray, around: np.ndarray, rate: float) -> None:
        self.steps += 1
        pace = np.float32(rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        self.gradient(ids, around)
        g, mean, square, work = self.grad, self.mean, self.square, self.work
        g *= np.float32(1 / BATCH)
        mean *= np.float32(0.9)
        mean += np.multiply(g, np.float32(0.1), out=work)
        square *= np.float32(0.99)
        np.multiply(g, g, out=work)
        work *= np.float32(0.01)
        square += work
        np.sqrt(square, out=work)
        work += np.float32(1e-6)
        np.divide(mean, work, out=work)
        work *= pace
        self.flat += work

    def text(self, ids: np.ndarray, around: np.ndarray, rate: float) -> None:
        """Steps over all words of a stretch, each with words from all over it, which makes its gradient steadier."""
        order = np.random.default_rng(len(ids)).permutation(len(ids))
        for low in range(0, len(ids), BATCH):
            at = order[low : low + BATCH]
            at = at[_sorted_by_class(ids[at])]
            self.step(ids[at], around.take(at, axis=1), rate)


def _train(start: Network, own: np.ndarray, rate: float):
    flat = start.flat()

    def run(batches):
        trainer, seen = Trainer(Network.of(flat)), 0
        for batch in batches:
            for piece in tk.pieces(batch, 0):
                ids, _, around, _ = word_ids(piece.column(0), own)
                trainer.text(ids, around, rate)
                seen += len(ids)
        if seen:
            out = trainer.flat
            cuts = range(0, SIZE, SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(cuts), pa.int64()), pa.array([seen] * len(cuts), pa.int64()), pa.array([out[c : c + SLICE].astype(np.float32).tobytes() for c in cuts], pa.binary())],
                names=["cut", "words", "weights"],
            )

    return run


def _average(batches):
    """Of the copies of one slice, one batch at a time, so a task holds a single sum."""
    cut, words, total = None, 0, None
    for batch in batches:
        for c, w, x in zip(batch["cut"].to_pylist(), batch["words"].to_pylist(), batch["weights"].to_pylist(), strict=True):
            cut, words = c, words + w
            total = w * np.frombuffer(x, np.float32).astype(np.float64) + (0 if total is None else total)
    yield pa.RecordBatch.from_arrays([pa.array([cut], pa.int64()), pa.array([words], pa.int64()), pa.array([(total / words).astype(np.float32).tobytes()], pa.binary())], names=["cut", "words", "weights"])


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    word, which = np.unique(np.concatenate(words), return_inverse=True)
    return word, np.bincount(which, np.concatenate(counts), len(word)).astype(np.int64)


def _count(batches):
    """Words and their counts; a task sends those of some COUNT_ROWS entries together."""
    words, counts, size = [], [], 0
    for batch in batches:
        for piece in tk.pieces(batch, 0):
            data, offs = tk.byte_column(piece.column(0))
            found, n = np.unique(tk.words(data, offs, tk.LOWER)[0], return_counts=True)
            words.append(found)
            counts.append(n)
            size += len(n)
            if size > COUNT_ROWS:
                found, n = _summed(words, counts)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])
                words, counts, size = [], [], 0
    if words:
        found, n = _summed(words, counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])


def count_words(docs: DataFrame, text_col: str = "text") -> Words:
    """Counts over every text. The driver gets a number for each slot and, if they are BROADCAST_WORDS at most, 12 bytes for each word found more than once."""
    spark = docs.sparkSession
    counts = docs.select(F.col(text_col).alias("body")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = Scratch(spark, "lm-words").table(counts, "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = np.array([r.word for r in top], np.int64)
    rest = counts.join(F.broadcast(spark.createDataFrame([(r.word,) for r in top], "word long")), "word", "left_anti")
    slot_n = np.zeros(VOCABULARY)
    slot_n[: len(top)] = [r.n for r in top]
    several = 0
    for r in rest.groupBy((OWN + F.col("word").bitwiseAND(VOCABULARY - OWN - 1)).alias("slot")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("several")).collect():
        slot_n[r.slot] = r.n
        several += r.several
    total = np.where(np.arange(VOCABULARY) < OWN, 0, np.log(slot_n + 1))
    table = rest.filter("n > 1").select("word", F.log("n").cast("float").alias("log_n"))
    words = Words(own.view(np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.float32), total, slot_n, int(slot_n.sum()))
    if several > BROADCAST_WORDS:
        words.table = table
    else:
        found = table.toArrow()
        word = found["word"].to_numpy().view(np.uint64)
        order = np.argsort(word)
        words.word, words.log_count = word[order], found["log_n"].to_numpy()[order]
    return words


def _round(net: Network, own: np.ndarray, docs: DataFrame, rate: float) -> Network:
    """Copies of the network trained on the texts, and averaged."""
    copies = docs.mapInArrow(_train(net, own, rate), "cut long, words long, weights binary")
    # copies meet in two steps, so that no task gets a slice of every partition
    schema = "cut long, words long, weights binary"
    fold = lambda df, *by: df.groupBy("cut", *by).applyInArrow(lambda t: pa.Table.from_batches(list(_average(t.to_batches()))), schema)
    copies = fold(copies.withColumn("part", F.spark_partition_id() % 64), "part")
    rows = fold(copies).toPandas().sort_values("cut")
    return net if rows.empty else Network.of(np.concatenate([np.frombuffer(x, np.float32) for x in rows["weights"]]))


def train(docs: DataFrame, text_col: str = "text", passes: int = PASSES) -> Network:
    """Count, and train on every word of every text, ``passes`` times over in ROUNDS rounds each, whatever the table's size.

    There is a copy of the network for every COPY_WORDS words, so that a larger table is trained by more tasks.

    What reaches the driver is the counts and, each round, one network of about 0.7 MB. Equal tables in equal partitions give equal networks;
    other partitions give slightly different ones, as a copy sees other texts.
    """
    words = count_words(docs, text_col)
    copies = max(1, words.seen // COPY_WORDS)
    docs = docs.select(F.col(text_col).alias("body")).coalesce(copies)
    rounds = ROUNDS * passes
    share = F.pmod(F.xxhash64("body"), F.lit(ROUNDS))
    net = Network.start(words.slot_n)
    for n in range(rounds if words.seen else 0):
        net = _round(net, words.own, docs.filter(share == n % ROUNDS), RATE * (1 - n / rounds))
    net.words = words
    return net


def pseudo_likelihood(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each text with a trained network; one row per input row, no shuffle.

    Returns the id, ``n_words``, ``word_log_likelihood`` (the sum of the words' conditional log-probabilities, the higher
    the likelier), ``mean_word_log_likelihood``, and ``log_likelihood`` and ``mean_log_likelihood``, the same of the words' slots
    only. A word that the training texts don't have counts as found once. A null, empty or wordless text has 0 words, sums 0 and null means. Ids may be null or
    repeat, and rows may; equal texts get equal scores. Other columns are ignored; an empty table gives an empty table. Texts are scored over their whole length.
    With more counts than may be broadcast, the words of each text are shuffled to their counts and the sums back to the texts.
    """
    table = net.words.table
    joined = table is not None
    model = docs.sparkSession.sparkContext.broadcast(replace(net, words=replace(net.words, table=None)))

    def run(batches):
        net, number = model.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in tk.pieces(batch, 1):
                ids, row, around, hashes = word_ids(piece.column(1), net.words.own)
                count = np.bincount(row, minlength=piece.num_rows)
                total = np.bincount(row, log_probs(net, ids, around), piece.num_rows)
                whole = total + np.bincount(row, net.words.log_share(hashes, ids), piece.num_rows)
                columns = [piece.column(0), pa.array(count, pa.int64()), pa.array(total, pa.float64()), pa.array(whole, pa.float64())]
                if joined:
                    shared = ids >= OWN
                    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[shared], minlength=piece.num_rows))])
                    columns += [pa.array(number + np.arange(piece.num_rows)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes[shared].view(np.int64)))]
                    number += piece.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    kinds = "id long, n_words long, log_likelihood double, word_log_likelihood double" + (", row long, words array<long>" if joined else "")
    names = [x.split()[0] for x in kinds.split(", ")]
    scored = docs.mapInArrow(run, kinds)
    if joined:
        scored = Scratch(docs.sparkSession, "lm-scores").table(scored, "scored")
        more = scored.select("row", F.explode("words").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
        more = more.join(table, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("more"))
        scored = scored.drop("words").join(more, "row", "left").withColumn("word_log_likelihood", F.col("word_log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).alias(f"mean_{c}")
    return scored.select(F.col("id").alias(id_col), "n_words", "log_likelihood", mean("log_likelihood"), "word_log_likelihood", mean("word_log_likelihood"))
