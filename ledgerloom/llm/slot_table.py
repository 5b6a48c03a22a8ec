"""Minimal perfect hashing of digests in numpy: a place for each key, and no place left over."""

from __future__ import annotations

import numpy as np

from .shingles import mixed

#: Cells for each key in a level, and levels before what is left is kept as a sorted list.
SPREAD, MOST_LEVELS = 2, 32


class SlotTable:
    """Gives each of a set of distinct keys (rows of 64-bit numbers) a slot from 0 on.

    A key has the first level in which no other key falls into its cell. Each slot keeps its whole key, so a key that is
    not in the table is told from those that are, whatever it collides with.
    """

    def __init__(self, *columns: np.ndarray) -> None:
        columns = tuple(np.asarray(c).astype(np.int64).view(np.uint64) for c in columns)
        left, self.levels, taken, places = np.arange(len(columns[0])), [], 0, []
        for level in range(MOST_LEVELS):
            if not len(left):
                break
            cells = max(1, SPREAD * len(left))
            cell = self._cells([c[left] for c in columns], level, cells)
            alone = np.bincount(cell, minlength=cells) == 1
            ranks = np.cumsum(alone) - 1 + taken
            kept = alone[cell]
            self.levels.append((cells, alone, ranks))
            places.append((left[kept], ranks[cell[kept]]))
            taken += int(kept.sum())
            left = left[~kept]
        self.rest = {tuple(int(c[i]) for c in columns): taken + n for n, i in enumerate(left.tolist())}
        if len(left):
            places.append((left, np.arange(taken, taken + len(left))))
        self.slot = np.zeros(len(columns[0]), np.int64)
        for rows, slots in places:
            self.slot[rows] = slots
        self.keys = tuple(np.empty_like(c) for c in columns)
        for own, given in zip(self.keys, columns, strict=True):
            own[self.slot] = given

    @staticmethod
    def _cells(columns: list[np.ndarray], level: int, cells: int) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = mixed(h ^ c, level + 1)
        return (h % np.uint64(cells)).astype(np.int64)

    def find(self, *columns: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for those that are not in the table."""
        columns = tuple(np.asarray(c).astype(np.int64).view(np.uint64) for c in columns)
        found, left = np.full(len(columns[0]), -1, np.int64), np.arange(len(columns[0]))
        for level, (cells, alone, ranks) in enumerate(self.levels):
            cell = self._cells([c[left] for c in columns], level, cells)
            hit = alone[cell]
            found[left[hit]] = ranks[cell[hit]]
            left = left[~hit]
        for i in left.tolist() if self.rest else ():
            found[i] = self.rest.get(tuple(int(c[i]) for c in columns), -1)
        same = found >= 0
        for own, given in zip(self.keys, columns, strict=True):
            same[same] = own[found[same]] == given[same]
        return np.where(same, found, -1)
