"""T-occurrence search in one block of shingle sets, with numpy inside tasks."""

from __future__ import annotations

import numpy as np

#: How many candidates are compared at a time: the best one, then more.
CHUNKS = (1, 8, 64, 512)
#: Binary probes made at once.
PROBES = 500_000


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of sizes ``n`` and ``m`` that links them."""
    return -(-percent * (n + m) // (100 + percent))


class BlockIndex:
    """Inverted lists of the sets added so far, and the components of their documents.

    A search takes a set's longest lists aside, so many that a partner must be in one of the others, merges these short
    lists by counting, drops candidates that cannot reach the required overlap or are of the searcher's component, and
    looks the rest up in the long lists by binary search. A linked pair's components become one at once.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.ids: list[int] = []
        self._given: list[int] = []
        self._sets: list[np.ndarray] = []
        self._built = self.visited = False

    def add(self, id_: int, component: int, found: np.ndarray) -> None:
        """Adds a document; one that was just added is not added again."""
        if not self.ids or self.ids[-1] != id_:
            self.ids.append(id_)
            self._given.append(component)
            self._sets.append(found.copy())

    def _build(self) -> None:
        self._built = True
        self.sizes = np.array([len(s) for s in self._sets], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        tokens = np.concatenate([*self._sets, np.empty(0, np.uint64)])
        self._sets = []
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.starts = np.append(np.flatnonzero(new), len(tokens))
        self.lengths = np.diff(self.starts)
        self.tokens = tokens[new]
        # A block has far fewer than 2 ** 31 tokens.
        number = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.lists = np.empty(len(tokens), np.int32)
        self.lists[order] = number
        self.members = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)[order]
        self.places = number.astype(np.int64) * max(1, len(self.ids)) + self.members
        self._labels: dict[int, int] = {}
        self._merged: dict[int, int] = {}
        self.labels = np.array([self._label(c) for c in self._given], np.int64)

    def _label(self, component: int) -> int:
        label = self._labels.setdefault(component, len(self._labels))
        while label in self._merged:
            label = self._merged[label]
        return label

    def _in_lists(self, lists: np.ndarray) -> np.ndarray:
        """How many of ``lists`` each document is in."""
        lengths = self.lengths[lists]
        ends = np.cumsum(lengths)
        if not len(ends):
            return np.zeros(len(self.ids), np.int64)
        at = np.repeat(self.starts[lists] - ends + lengths, lengths) + np.arange(ends[-1])
        return np.bincount(self.members[at], minlength=len(self.ids))

    def _probed(self, candidates: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """In how many of ``lists`` each candidate is, by binary search."""
        found = np.zeros(len(candidates), np.int64)
        step = max(1, PROBES // max(1, len(candidates)))
        for start in range(0, len(lists), step):
            wanted = (lists[start : start + step, None].astype(np.int64) * len(self.ids) + candidates).ravel()
            place = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            found += (self.places[place] == wanted).reshape(-1, len(candidates)).sum(axis=0)
        return found

    def _search(self, id_: int, label: int, size: int, lists: np.ndarray, before: int) -> list[tuple[int, int]]:
        """Links of a set with ``size`` members, of which those in ``lists`` occur here, to documents below ``before``."""
        percent, links = self.percent, []
        aside = -(-percent * size // 100) - 1
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        cut = max(0, len(lists) - aside)
        short, long_ = lists[:cut], lists[cut:]
        if not len(short) or self.lengths[lists[-1]] < 2 and before == len(self.ids) - 1:
            return links
        counts = self._in_lists(short)[:before]
        candidates = np.flatnonzero(counts)
        sizes = self.sizes[candidates]
        need = least_overlap(sizes, size, percent)
        able = (np.minimum(sizes, size) >= need) & (counts[candidates] + len(long_) >= need) & (self.labels[candidates] != label)
        candidates = candidates[able]
        candidates = candidates[np.argsort(-counts[candidates], kind="stable")]
        merged, turn = None, 0
        while len(candidates):
            chunk, candidates = np.split(candidates, [CHUNKS[min(turn, len(CHUNKS) - 1)]])
            turn += 1
            if merged is None and len(chunk) * len(long_) * 4 > int(self.lengths[long_].sum()):
                merged = self._in_lists(long_)
            both = counts[chunk] + (self._probed(chunk, long_) if merged is None else merged[chunk])
            for other in chunk[100 * both >= percent * (self.sizes[chunk] + size - both)].tolist():
                if (theirs := int(self.labels[other])) != label:
                    links.append((id_, self.ids[other]))
                    self._merged[theirs] = label
                    self.labels[self.labels == theirs] = label
            candidates = candidates[self.labels[candidates] != label]
        return links

    def inner_links(self) -> list[tuple[int, int]]:
        """Links among the added documents; none where there were visitors, since a block is compared with itself first."""
        if self.visited:
            return []
        self._build()
        links = []
        for at in range(1, len(self.ids)):
            links += self._search(self.ids[at], int(self.labels[at]), int(self.sizes[at]), self.lists[self.firsts[at] : self.firsts[at + 1]], at)
        return links

    def visit(self, id_: int, component: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Links of a document from elsewhere to the added ones."""
        if not self._built:
            self._build()
        self.visited = True
        if not len(self.tokens):
            return []
        place = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
        return self._search(id_, self._label(component), len(found), place[self.tokens[place] == found], len(self.ids))
