"""Cuckoo filters in numpy: 16-bit fingerprints in buckets of four, with whole batches of keys placed at once."""

from __future__ import annotations

import numpy as np

from .shingles import mixed

SLOTS = 4
#: A filter is made so large that its keys fill at most this share of the slots.
LOAD = 0.8
#: Rounds of moving fingerprints before a batch counts as not placed.
MOST_ROUNDS = 400


def bucket_count(keys: int) -> int:
    """The power of two of buckets that holds so many keys under ``LOAD``."""
    return 1 << max(4, int(np.ceil(keys / (SLOTS * LOAD))) - 1).bit_length()


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """The number of equal values before each place of a sorted array."""
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.arange(len(ordered)) - np.flatnonzero(first)[np.cumsum(first) - 1]


class CuckooFilter:
    """A set of 64-bit keys that may say yes to a key that is not in it, never no to one that is.

    A key must be added once only and removed only while it is in. ``full`` marks a filter that could not place its
    keys: it says yes to every key until it is made anew.
    """

    def __init__(self, buckets: int, table: bytes | None = None, full: bool = False) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()
        self.mask = np.uint64(buckets - 1)
        self.full = full

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        made = cls(bucket_count(len(keys)))
        made.add(keys)
        return made

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = np.maximum(keys >> np.uint64(48), np.uint64(1))
        first = keys & self.mask
        return marks.astype(np.uint16), first, self._other(first, marks)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return (bucket ^ mixed(marks.astype(np.uint64), 7)) & self.mask

    def _settle(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; returns which ones found none."""
        order = np.argsort(bucket, kind="stable")
        own, rank = bucket[order], _ranks(bucket[order])
        free = self.table[own] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
        self.table[own[fits], slot[fits]] = marks[order[fits]]
        return np.sort(order[~fits])

    def add(self, keys: np.ndarray) -> None:
        marks, first, second = self._places(np.asarray(keys, np.uint64))
        left = self._settle(marks, first)
        marks, bucket = marks[left], second[left]
        for turn in range(MOST_ROUNDS):
            if not len(marks):
                return
            left = self._settle(marks, bucket)
            marks, bucket = marks[left], bucket[left]
            # One fingerprint of each full bucket takes a slot, and the one that was there moves to its other bucket.
            _, head = np.unique(bucket, return_index=True)
            slot = turn % SLOTS
            out = self.table[bucket[head], slot].copy()
            self.table[bucket[head], slot] = marks[head]
            marks[head], bucket[head] = out, self._other(bucket[head], out)
        self.full = self.full or bool(len(marks))

    def remove(self, keys: np.ndarray) -> None:
        if self.full:
            return
        for mark, first, second in zip(*self._places(np.asarray(keys, np.uint64)), strict=True):
            for bucket in (first, second):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(keys), bool)
        marks, first, second = self._places(np.asarray(keys, np.uint64))
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)
