"""A bounded memory of words, keyed by their hashes, that a Python worker keeps between batches."""

from __future__ import annotations

import numpy as np

from asofia.llm import textkernel as tk


class WordTable:
    """Open table of 2**bits slots with two places for each key; a newer word takes the place of an older one.

    ``columns`` gives the type of each value. Whatever has been pushed out is simply worked out anew, so results don't depend
    on the size.
    """

    def __init__(self, bits: int, **columns: type):
        self.mask = tk.U64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=tk.U64)
        self.values = {name: np.zeros(1 << bits, dtype=kind) for name, kind in columns.items()}

    def clear(self) -> None:
        self.keys[:] = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        first, second = (keys & self.mask).astype(np.int64), (keys >> tk.U64(32) & self.mask).astype(np.int64)
        return np.where(self.keys[first] == keys, first, np.where(self.keys[second] == keys, second, -1))

    def put(self, keys: np.ndarray, **values: np.ndarray) -> None:
        """Store distinct keys that the table doesn't have."""
        first, second = (keys & self.mask).astype(np.int64), (keys >> tk.U64(32) & self.mask).astype(np.int64)
        slot = np.where(self.keys[first] == 0, first, second)
        self.keys[slot] = keys
        won = self.keys[slot] == keys  # of two new keys with one slot the later stays
        for name, column in values.items():
            self.values[name][slot[won]] = column[won]


class Sequences:
    """The ids that each word stands for, in one pool of ``most`` numbers, and further ``columns`` of a word."""

    def __init__(self, bits: int, most: int, **columns: type):
        self.table = WordTable(bits, start=np.int32, size=np.int32, **columns)
        self.pool, self.used = np.zeros(most, dtype=np.uint32), 0

    def get(self, keys: np.ndarray, work) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ids of words, and of each key where its own start, their ``size`` and the further columns.

        ``work`` takes the places of distinct unknown keys and returns their ids end to end and the columns, ``size`` first.
        """
        slot = self.table.find(keys)
        missing = np.flatnonzero(slot < 0)
        found = {name: column[slot] for name, column in self.table.values.items()}
        if not len(missing):
            return self.pool[: self.used], found
        new, at, which = np.unique(keys[missing], return_index=True, return_inverse=True)
        ids, columns = work(missing[at])
        columns = {"start": np.cumsum(columns["size"]) - columns["size"]} | columns if "start" not in columns else columns
        pool = np.concatenate([self.pool[: self.used], ids])
        for name, column in columns.items():
            found[name] = found[name].astype(column.dtype)
            found[name][missing] = column[which] + (self.used if name == "start" else 0)
        if len(ids) <= len(self.pool) // 4:
            if self.used + len(ids) > len(self.pool):
                self.table.clear()
                self.used = 0
            self.table.put(new, **columns | {"start": columns["start"] + self.used})
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return pool, found


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: bytes = b"") -> np.ndarray:
    """The bytes of all spans end to end, with the bytes ``after`` behind each, if any."""
    size = ends - starts
    plain = np.cumsum(size) - size
    taken = data[np.arange(size.sum()) + np.repeat(starts - plain, size)]
    if not after:
        return taken
    out = np.empty(len(taken) + len(size) * len(after), dtype=data.dtype)
    out[np.arange(len(taken)) + np.repeat(np.arange(len(size)) * len(after), size)] = taken
    for i, byte in enumerate(after):
        out[np.cumsum(size) + np.arange(len(size)) * len(after) + i] = byte
    return out
