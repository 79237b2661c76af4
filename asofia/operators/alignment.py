"""The stretch of a passage that is most like a quote, for many pairs of texts at once in numpy."""

from __future__ import annotations

import numpy as np

#: Stretches compared at once, and how many of a pair's most promising ones are compared before the others are bounded by them.
CHUNK, FIRST = 32_768, 64
#: Letters of quotes and passages that are prepared at once; one pair is never divided.
LETTERS = 1_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _common(table: np.ndarray, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each stretch, which begins at place ``at`` of ``codes`` and is ``size`` long, with its quote.

    ``table`` has, by word of 64 bits and code, the quote's places that hold the code's letter. All stretches take a step at a time. A bit of a
    stretch's row that turns to zero is a place of the quote where the subsequence grows by one.
    """
    order = np.argsort(-size, kind="stable")
    at, left = at[order], size[order]
    words = len(table)
    rows = [np.full(len(at), ~np.uint64(0)) for _ in range(words)]
    open_at = len(at) - np.searchsorted(left[::-1], np.arange(left[0] if len(left) else 0), side="right")
    for step, k in enumerate(open_at):
        letters, carry = codes[at[:k] + step], None
        for w in range(words):
            row = rows[w][:k]
            hit = row & table[w][letters]
            total = row + hit
            over = total < hit
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            np.bitwise_or(total, row ^ hit, out=row)
    length = np.zeros(len(at), dtype=np.int64)
    length[order] = 64 * words - sum(np.bitwise_count(row).astype(np.int64) for row in rows)
    return length


class _Pairs:
    """Pairs of a shorter text and a longer one, prepared to be compared together."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]):
        self.m = np.array([len(a) for a, _ in pairs], dtype=np.int64)
        self.n = np.array([len(b) for _, b in pairs], dtype=np.int64)
        found = [np.unique(a, return_inverse=True, return_counts=True) for a, _ in pairs]
        base = np.concatenate([[0], np.cumsum([len(letters) + 1 for letters, _, _ in found])])
        # by word: a pair's first code stands for all letters that its shorter text doesn't have
        table = np.zeros((-(-int(self.m.max()) // 64), base[-1]), dtype=np.uint64)
        codes, offset, self.bound = [], [], []
        held = 0
        for i, ((a, b), (letters, place, times)) in enumerate(zip(pairs, found, strict=True)):
            at = np.arange(len(a))
            np.bitwise_or.at(table, (at // 64, base[i] + 1 + place), np.uint64(1) << (at % 64).astype(np.uint64))
            code = np.searchsorted(letters, b)
            code = np.where(letters[np.minimum(code, len(letters) - 1)] == b, code + 1, 0)
            # stretches begin up to m - 1 places before the longer text and end up to as many after it
            low, high = self.edges(i, np.arange(1 - len(a), len(b)))
            # the letters that a stretch shares with the shorter text bound its score; places outside count as no letter, so all stretches are m long here
            around = np.zeros(len(b) + 2 * len(a) - 2, dtype=np.int32)
            around[len(a) - 1 : len(a) - 1 + len(b)] = code
            shared = np.zeros(len(low), dtype=np.int32)
            seen = np.zeros(len(around) + 1, dtype=np.int32)
            for letter, most in enumerate(times):
                np.cumsum(around == letter + 1, out=seen[1:])
                shared += np.minimum(seen[len(a) :] - seen[: -len(a)], np.int32(most))
            self.bound.append(200.0 * shared / (len(a) + high - low))
            codes.append((code + base[i]).astype(np.int64))
            offset.append(held)
            held += len(b)
        self.table, self.codes, self.offset = table, np.concatenate(codes), np.array(offset)

    def edges(self, i, begin):
        return np.maximum(begin, 0), np.minimum(begin + self.m[i], self.n[i])

    def scores(self, pair: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = self.edges(pair, begin)
        common = np.zeros(len(pair), dtype=np.int64)
        for k in range(0, len(pair), CHUNK):
            part = slice(k, k + CHUNK)
            words = -(-int(self.m[pair[part]].max()) // 64)
            common[part] = _common(self.table[:words], self.codes, self.offset[pair[part]] + low[part], high[part] - low[part])
        return 200.0 * common / (self.m[pair] + high - low), low, high

    def best(self) -> list[tuple[float, int, int]]:
        """Score, start and end of each pair's best stretch."""
        top = [np.argpartition(-b, FIRST)[:FIRST] if len(b) > FIRST else np.arange(len(b)) for b in self.bound]
        best = self._reduced(top, [(-1.0, 0, 0)] * len(top))
        # what can't beat the best so far, or equal it from an earlier place, is left
        rest = []
        for b, done, (score, start, _), m in zip(self.bound, top, best, self.m, strict=True):
            may = (b > score) | ((b == score) & (np.arange(len(b)) + 1 - m < start))
            may[done] = False
            rest.append(np.flatnonzero(may))
        return self._reduced(rest, best)

    def _reduced(self, places: list[np.ndarray], best: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        pair = np.repeat(np.arange(len(places)), [len(p) for p in places])
        if not len(pair):
            return best
        score, low, high = self.scores(pair, np.concatenate(places) + 1 - self.m[pair])
        order = np.lexsort((high, low, -score, pair))
        first = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])]
        found = list(best)
        for i, x in zip(pair[first], zip(score[first], low[first], high[first], strict=True), strict=True):
            found[i] = min(found[i], tuple(v.item() for v in x), key=lambda f: (-f[0], f[1], f[2]))
        return found


def best_stretches(quotes: list[str | None], passages: list[str | None]) -> list[tuple[float, int, int]]:
    """Per pair ``score, start, stop``: the stretch of the passage that is most like the quote, 0 to 100 (twice the longest common subsequence
    over both lengths). Stretches have the quote's length, or less at either end of the passage; of equal ones the first counts, then the shortest.

    A quote longer than its passage is compared the other way round: stretches of the quote with the whole passage, which is what is
    returned. Texts of one length are compared both ways. Without a quote or a passage the score is 0.
    """
    found: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(quotes)
    pairs: list[tuple[int, bool, np.ndarray, np.ndarray]] = []

    def compared() -> None:
        for (i, turned, a, _), (score, start, stop) in zip(pairs, _Pairs([(a, b) for _, _, a, b in pairs]).best(), strict=True):
            if score > found[i][0]:
                found[i] = (score, 0, len(a)) if turned else (score, start, stop)
        pairs.clear()

    held = 0
    for i, (quote, passage) in enumerate(zip(quotes, passages, strict=True)):
        if not quote or not passage:
            continue
        q, p = _codes(quote), _codes(passage)
        pairs.extend([(i, False, q, p)] * (len(q) <= len(p)) + [(i, True, p, q)] * (len(p) <= len(q)))
        held += len(q) + len(p)
        if held > LETTERS:
            compared()
            held = 0
    if pairs:
        compared()
    return found
