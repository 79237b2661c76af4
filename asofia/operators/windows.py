"""Filters of a search inside its tasks: what a query may find, as arrays of whole numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes a query's attributes and a block's as arrays, all of them whole numbers, and says which vectors the query may find.
Allow = Callable[[dict[str, int], dict[str, np.ndarray]], np.ndarray]
NULL = np.iinfo(np.int64).min
#: What ``in_force`` needs of a vector's document: its window in days and whether it is withdrawn.
WINDOW = ("valid_from", "valid_to", "is_withdrawn")


def with_window(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Vectors with their documents' windows as whole numbers, by the document id in ``key``."""
    days = [F.unix_date(c).alias(c) for c in WINDOW[:2]]
    return rows.join(docs.select(F.col("doc_id").alias(key), *days, F.col("is_withdrawn").cast("int").alias("is_withdrawn")), key)


def in_force(today: int) -> Allow:
    """``temporal.searchable`` over a block's windows, for a query's ``as_of`` (both in days)."""

    def allow(query: dict[str, int], block: dict[str, np.ndarray]) -> np.ndarray:
        day, start, end = query["as_of"], block["valid_from"], block["valid_to"]
        return (start != NULL) & (start <= day) & ((end == NULL) | (end > day)) & ((day < today) | (block["is_withdrawn"] == 0))

    return allow


def day(text: str) -> int:
    """A date as its number of days since 1970."""
    return int(np.datetime64(text, "D").astype(np.int64))
