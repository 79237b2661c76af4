"""Quality rules on repetition coverage: characters inside duplicated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofia.llm import textkernel as tk

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words per n-gram, and the share of word characters inside n-grams found twice or more from which a text is rejected.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.25}
#: The same for characters in lines that are equal to an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_NGRAM = 50, 50, 3


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


def covered_words(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its row holds twice or more."""
    grams, first = tk.windows(hashes, rows, n)
    hit = first[repeated(grams ^ tk.mix(rows[first].astype(np.uint64)))]
    depth = np.zeros(len(hashes) + 1, dtype=np.int64)
    depth[hit] += 1  # each window begins at another word, so no index repeats
    depth[hit + n] -= 1
    return np.cumsum(depth[:-1]) > 0


def repetition(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and coverages of each text; a null counts as empty."""
    data, offs = tk.byte_column(column)
    rows = len(offs) - 1
    inside = ~tk.SEPARATOR[data]
    points = np.concatenate([[0], np.cumsum(inside & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    h, row, start, end = tk.words(data, offs)
    size = points[end] - points[start]
    per_row = lambda mask, weights=None: np.bincount(row[mask], None if weights is None else weights[mask], minlength=rows).astype(np.int64)
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": points[offs[1:]] - points[offs[:-1]],
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_repeat_words": per_row(covered_words(h, row, BASE_NGRAM)),
    }
    line_start, line_end = tk.spans(data != 0x0A, offs)
    line_size = points[line_end] - points[line_start]
    has = line_size > 0
    line_start, line_end, line_size = line_start[has], line_end[has], line_size[has]
    line_row = tk.row_of(line_start, offs)
    key = tk.hash_spans(data, line_start, line_end) ^ tk.mix(line_row.astype(np.uint64))
    later = np.ones(len(key), dtype=bool)
    later[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    out["line_chars"] = np.bincount(line_row[later], line_size[later], minlength=rows).astype(np.int64)
    for n in NGRAM_LIMITS:
        out[f"chars_{n}gram"] = per_row(covered_words(h, row, n), size)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COVERAGE = ["line_chars", *(f"chars_{n}gram" for n in NGRAM_LIMITS)]
_OUT = ", ".join(["id long", *(f"{c} long" for c in _COUNTS), "base_failed boolean, kept boolean", *(f"{c} long" for c in _COVERAGE)])


def judge(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``repetition`` with the verdicts ``base_failed`` and ``kept``."""
    found = repetition(column)
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
    kept = ~failed & (found["line_chars"] <= LINE_LIMIT * found["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        kept &= found[f"chars_{n}gram"] <= limit * found["word_chars"]
    return found | {"base_failed": failed, "kept": kept}


def _measure(batches):
    for batch in batches:
        for piece in tk.pieces(batch, 1):
            found = judge(piece.column(1))
            numbers = lambda names: [pa.array(found[c], pa.int64()) for c in names]
            verdicts = [pa.array(found[c], pa.bool_()) for c in ("base_failed", "kept")]
            yield pa.RecordBatch.from_arrays([piece.column(0), *numbers(_COUNTS), *verdicts, *numbers(_COVERAGE)], names=["id", *_COUNTS, "base_failed", "kept", *_COVERAGE])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure and judge each text; one row per input row, whatever its id.

    Words are ``[^\\x20\\x09-\\x0D]+``, case kept. ``base_failed``: fewer than 50 words, or more than half of the
    words in three-word windows found twice or more. ``kept`` is false for these, and for texts in which the lines
    equal to an earlier one hold more than 30 % of the word characters, or n-grams found twice or more hold more
    than 30, 28 or 25 % (n: 5, 7, 10). Null and empty texts count zero words and fail. An id may be null or repeat;
    other columns are ignored; an empty table gives an empty table. Texts are measured whole, in one scan, with no shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return docs.mapInArrow(_measure, _OUT).withColumnRenamed("id", id_col)


def keep_passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``quality_rules`` keeps."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, at):
                yield piece.filter(pa.array(judge(piece.column(at))["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
