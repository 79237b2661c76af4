"""Token counts of a unigram tokenizer by dynamic programming on a trie of pre-tokens.

The distinct pre-tokens (words with the space mark in front) of a stretch of text are put into a trie. The best
segmentation of a prefix is computed once for all words that share it: a node's score is the best, over the vocabulary pieces that
end there, of the score of the node where the piece begins plus the piece's own. What a word comes to is stored at its last node.

A long word, as in scripts without spaces, is first cut wherever no piece of the vocabulary can lie across, which changes
no segmentation, and its parts go through the trie.

The pieces' probabilities come from the corpus: counts of the best segmentation over all texts, begun with the vocabulary's order and repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.llm import textkernel as tk
from asofia.llm.wordtable import Sequences, gather

SPACE = "▁"
#: Words of more characters are cut. Parts that stay longer, such as one repeated letter, are walked one by one, as levels of a single node.
LONG_WORD = 64
#: A Python worker remembers words in 2**TABLE_BITS slots and POOL_IDS pieces at most.
TABLE_BITS, POOL_IDS = 20, 4_000_000
#: How often the pieces are counted over the corpus.
ROUNDS = 2
_BASE = np.uint64(0xD1342543DE82EF95)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model in its own order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [model.id_to_piece(i) for i in sorted(usual, key=lambda i: (-model.get_score(i), i))]


def rank_scores(n: int) -> np.ndarray:
    """Log-probabilities that fall as 1 / (rank + 10)."""
    weights = 1 / (np.arange(n) + 10)
    return np.log(weights / weights.sum())


class Unigram:
    """A vocabulary with log-probabilities. A character that is no piece is spelt in bytes, one token each, at ``byte_score`` a byte."""

    def __init__(self, pieces: list[str], scores: np.ndarray):
        self.pieces, self.scores = pieces, np.asarray(scores, dtype=float)
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = float(self.scores.min(initial=0.0)) - 10.0
        points = np.array([[*map(ord, p), *[0] * (self.longest - len(p))] for p in pieces], dtype=np.uint64).reshape(len(pieces), self.longest)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        h = np.zeros(len(pieces), dtype=np.uint64)
        for i in range(self.longest):
            h = np.where(i < size, h * _BASE + points[:, i] + np.uint64(1), h)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], dtype=np.uint64)
        self.known: Sequences | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}  # a worker's memory is its own

    def _piece(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def walk(self, word: str) -> tuple[list[int], float]:
        """Pieces and score of one pre-token, character by character; a byte is the number after the last piece."""
        best = [(0.0, 0, 0, 0)]
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode(errors="replace"))
            top = (best[end - 1][0] + self.byte_score * width, best[end - 1][1] - width, end - 1, -width)
            for start in range(max(0, end - self.longest), end):
                piece = self.number.get(word[start:end])
                if piece is not None:
                    top = max(top, (best[start][0] + self.scores[piece], best[start][1] - 1, start, piece), key=lambda x: x[:2])
            best.append(top)
        ids, at = [], len(word)
        while at:
            _, _, before, piece = best[at]
            ids += [piece] if piece >= 0 else [len(self.pieces)] * -piece
            at = before
        return ids[::-1], float(best[-1][0])

    def _cuts(self, text: np.ndarray) -> np.ndarray:
        """Places in a word's code points that no piece lies across."""
        prefix = np.zeros(len(text) + 1, dtype=np.uint64)
        step = np.multiply.accumulate(np.full(len(text) + 1, self.powers[1])) * np.uint64(pow(int(_BASE), -1, 1 << 64))
        inverse = np.multiply.accumulate(np.full(len(text) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        # sum of the points times falling powers: prefix[i] is that of the first i, scaled by BASE**-i
        prefix[1:] = np.cumsum((text.astype(np.uint64) + np.uint64(1)) * inverse[: len(text)])
        across = np.zeros(len(text) + 2, dtype=np.int64)
        for length in range(2, min(self.longest, len(text)) + 1):
            end = np.arange(length, len(text) + 1)
            hit = end[self._piece((prefix[end] - prefix[end - length]) * step[end]) >= 0]
            across[hit - length + 1] += 1
            across[hit] -= 1
        return np.flatnonzero(np.cumsum(across)[1 : len(text)] == 0) + 1

    def trie(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all words end to end, their number and score of each word, by one trie for all. Words are stretches of code points."""
        node, active, depth = np.zeros(len(size), dtype=np.int64), np.flatnonzero(size > 0), 0
        # of each node, level by level (node 0 is the root): parent, hash of the path, best score and its tokens, last piece and where it begins
        up, prefix, score, tokens = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64)
        last, origin = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(active):
            point = text[begin[active] + depth].astype(np.int64)
            edge, first, which = np.unique(node[active] << 21 | point, return_index=True, return_inverse=True)
            above, point = edge >> 21, point[first]
            start, depth = len(up), depth + 1
            up = np.concatenate([up, above])
            prefix = np.concatenate([prefix, prefix[above] * _BASE + point.astype(np.uint64) + np.uint64(1)])
            node[active] = start + which
            width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
            best, fewest, piece, source = score[above] + self.byte_score * width, tokens[above] + width, -width, above
            here, ancestor = prefix[start:], above
            for length in range(1, min(depth, self.longest) + 1):
                found = self._piece(here - prefix[ancestor] * self.powers[length])
                value = np.where(found >= 0, score[ancestor] + self.scores[found], -np.inf) if len(self.scores) else np.full(len(found), -np.inf)
                fewer = tokens[ancestor] + 1
                better = (value > best) | ((value == best) & (fewer < fewest))
                best, fewest = np.where(better, value, best), np.where(better, fewer, fewest)
                piece, source = np.where(better, found, piece), np.where(better, ancestor, source)
                ancestor = up[ancestor]
            score, tokens = np.concatenate([score, best]), np.concatenate([tokens, fewest])
            last, origin = np.concatenate([last, piece]), np.concatenate([origin, source])
            active = active[size[active] > depth]
        count, total = tokens[node], score[node]
        ids = np.full(count.sum(), len(self.pieces), dtype=np.uint32)
        place, live = np.cumsum(count), np.flatnonzero(node > 0)
        while len(live):
            at = node[live]
            place[live] -= np.maximum(-last[at], 1)
            usual = last[at] >= 0
            ids[place[live[usual]]] = last[at[usual]]
            node[live] = origin[at]
            live = live[node[live] > 0]
        return ids, count, total

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        text = np.frombuffer((b" " + gather(data, starts, ends, after=b" ").tobytes()[:-1]).decode(errors="replace").encode("utf-32-le", errors="replace"), dtype=np.uint32).copy()
        begin = np.flatnonzero(text == 32)
        size = np.diff(np.append(begin, len(text)))
        text[begin] = ord(SPACE)
        parts = [begin]
        for i in np.flatnonzero(size > LONG_WORD):
            parts.append(begin[i] + self._cuts(text[begin[i] : begin[i] + size[i]]))
        part = np.sort(np.concatenate(parts))
        owner = np.searchsorted(begin, part, "right") - 1
        length = np.diff(np.append(part, len(text)))
        short = length <= LONG_WORD
        ids, count, score = self.trie(text, part[short], length[short])
        n, s = np.zeros(len(part), dtype=np.int64), np.zeros(len(part))
        n[short], s[short] = count, score
        if not short.all():
            walked = {i: self.walk(text[part[i] : part[i] + length[i]].tobytes().decode("utf-32-le")) for i in np.flatnonzero(~short).tolist()}
            for i, (found, value) in walked.items():
                n[i], s[i] = len(found), value
            every, ids = ids, np.empty(n.sum(), dtype=np.uint32)
            stop = np.cumsum(n)
            in_trie = np.repeat(short, n)
            ids[in_trie] = every
            for i, (found, _) in walked.items():
                ids[stop[i] - n[i] : stop[i]] = found
        edge = np.searchsorted(owner, np.arange(len(begin)))
        return ids, {"size": np.add.reduceat(n, edge), "score": np.add.reduceat(s, edge)}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Row of each word, the pool of pieces, and each word's start in it, size and score."""
        data, offs = tk.byte_column(column)
        hashes, row, starts, ends = tk.words(data, offs)
        self.known = self.known or Sequences(TABLE_BITS, POOL_IDS, score=np.float64)
        pool, found = self.known.get(hashes, lambda at: self._new(data, starts[at], ends[at]))
        return row, pool, found


def _piece_counts(unigram):
    def run(batches):
        model = unigram.value
        total = np.zeros(len(model.pieces) + 1, dtype=np.int64)
        for batch in batches:
            for piece in tk.pieces(batch, 0, max_bytes=2 << 20):
                _, pool, found = model.encode(piece.column(0))
                size = found["size"].astype(np.int64)
                place = np.cumsum(size) - size
                total += np.bincount(pool[np.arange(size.sum()) + np.repeat(found["start"] - place, size)], minlength=len(total))
        used = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

    return run


def train(docs: DataFrame, model: str, text_col: str = "text", rounds: int = ROUNDS) -> Unigram:
    """Probabilities of a sentencepiece file's pieces from their counts over all texts, each plus one.

    A round counts the pieces of the best segmentations under the probabilities so far, beginning with ones that fall with
    the piece's rank. One number for each piece, so some 32,000 whatever the corpus, reaches the driver.
    """
    spark = docs.sparkSession
    pieces = vocabulary(model)
    scores = rank_scores(len(pieces))
    for _ in range(rounds):
        unigram = spark.sparkContext.broadcast(Unigram(pieces, scores))
        found = docs.select(F.col(text_col).alias("body")).mapInArrow(_piece_counts(unigram), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        count = np.ones(len(pieces))
        count[found["piece"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=np.int64)
        scores = np.log(count / count.sum())
    return Unigram(pieces, scores)


def token_counts(docs: DataFrame, unigram: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of each text's best segmentation; one row per input row, in one scan without a shuffle.

    Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` with the space mark in front, case kept. Returns the id, ``n_words``, ``n_tokens``
    and ``score``, the sum of the pieces' log-probabilities; of segmentations with
    one score that with fewer tokens counts. A null, empty or wordless text has zeros. Ids may be null or repeat.
    Other columns are ignored; an empty table gives an empty table. Texts are counted over their whole length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(unigram)

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in tk.pieces(batch, 1, max_bytes=2 << 20):
                row, _, found = model.encode(piece.column(1))
                sums = [np.bincount(row, x, piece.num_rows) for x in (np.ones(len(row)), found["size"], found["score"])]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(sums[2])], names=["id", "n_words", "n_tokens", "score"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return docs.mapInArrow(run, "id long, n_words long, n_tokens long, score double").withColumnRenamed("id", id_col)
