"""Encoding and decoding with sampled segmentations: Gumbel top-k without replacement over the lattice of a text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .shingles import mixed
from .unigram import SPACE, VOCABULARY, Unigram, public_unigram

SAMPLES = 2
#: Texts are drawn together until they hold this many characters.
BATCH_CHARS = 1_000_000
#: States of a lattice; one with more is not read on, the next texts begin a new one.
MAX_STATES = 1_500_000
#: Chunks, which no piece spans: letters or marks with the space before them, else one character.
_CHUNK = re.compile(r" ?[^\W\d_]+|\n| ?[^\n \w]+|.", re.S)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: What random numbers are for: the walks of a sample, the choice where it leaves its base, the bounds and their places.
_WALK, _TURN, _BOUND, _PLACE = 1, 2, 3, 4


def _extended(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of the strings without their last characters ``codes``."""
    with np.errstate(over="ignore"):
        return (hashes ^ (hashes >> np.uint64(29))) * _STEP + codes.astype(np.uint64) + np.uint64(1)


class PieceTable:
    """The beginnings of the pieces of a model by length, to be looked up for many places of a text at once."""

    def __init__(self, model: Unigram):
        self.model, self.longest = model, min(model.longest, 16)
        self.by_length = []
        for size in range(1, self.longest + 1):
            heads = sorted({p[:size] for p in model.scores if len(p) >= size and len(p) <= self.longest})
            codes = np.frombuffer("".join(heads).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
            keys = np.zeros(len(codes), np.uint64)
            for column in codes.T:
                keys = _extended(keys, column)
            order = np.argsort(keys)
            scores = np.array([model.scores.get(heads[i], -np.inf) for i in order])
            ids = np.array([model.ids.get(heads[i], -1) for i in order], np.int64)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two beginnings of pieces have one hash")
            self.by_length.append((keys[order], codes[order, -1], scores, ids))
        surface = model.surface
        self.lengths = np.array([len(x) for x in surface], np.int64)
        self.offsets, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(surface), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; the space in front, which encoding adds, goes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes[at].tobytes().decode("utf-8", "surrogatepass")[1:]


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, thing: str) -> int:
        number = self[thing] = len(self)
        return number


class Lattice:
    """The lattices of all distinct chunks of the texts read so far, each chunk built once. A state is a place in the
    joined chunks, each ended by a zero; the edges of a state, the pieces that begin there, stand together, shorter
    pieces first."""

    def __init__(self, table: PieceTable, temperature: float = 1.0):
        self.table, self.temperature, self.byte_ids = table, temperature, table.model.byte_ids
        self.number = _Numbers()
        none = lambda kind: np.empty(0, kind)
        self.starts, self.codes, self.ended = none(np.int64), none(np.uint32), none(bool)
        self.first, self.at, self.next, self.ids = np.zeros(1, np.int64), none(np.int64), none(np.int64), none(np.int32)
        self.logs, self.until = none(np.float64), none(np.float64)

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """The first state of each chunk of each text."""
        known = len(self.number)
        lists = [list(map(self.number.__getitem__, _CHUNK.findall(" " + text))) for text in texts]
        self._extend([SPACE + c[1:] if c[0] == " " else c for c in islice(self.number, known, None)])
        return [self.starts[np.array(x, np.int64)] for x in lists]

    def _extend(self, chunks: list[str]) -> None:
        if not chunks:
            return
        base, edge_base = len(self.codes), len(self.at)
        codes = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) + 1 for c in chunks])
        n, ends = len(codes), np.cumsum(sizes) - 1
        left = np.repeat(ends, sizes) - np.arange(n)
        at, size, score, ids = self._edges(codes, left)
        order = np.argsort(at * 32 + size, kind="stable")
        at, size, score, ids = at[order], size[order], score[order], ids[order]
        counts = np.bincount(at, minlength=n)
        first = np.cumsum(counts) - counts
        # Mass of what is left from each place, from the ends of the chunks backwards, all chunks at once.
        mass, weights = np.zeros(n), np.empty(len(at))
        places = np.argsort(left, kind="stable")
        levels = np.searchsorted(left[places], np.arange(1, left.max() + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            here = places[a:b]
            own = np.cumsum(counts[here]) - counts[here]
            rows = np.repeat(first[here] - own, counts[here]) + np.arange(int(counts[here].sum()))
            w = score[rows] + mass[at[rows] + size[rows]]
            top = np.maximum.reduceat(w, own)
            mass[here] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, counts[here])), own))
            weights[rows] = w
        logs = weights - mass[at]
        # For each edge the share of its state's mass in it and the edges before it, added up within the state.
        until, rank = np.exp(logs), np.arange(len(at)) - first[at]
        for k in range(1, int(counts.max())):
            later = np.flatnonzero(rank == k)
            until[later] += until[later - 1]
        joined = lambda old, new: np.concatenate([old, new])
        self.starts = joined(self.starts, base + ends + 1 - sizes)
        self.codes, self.ended = joined(self.codes, codes), joined(self.ended, left == 0)
        self.first = joined(self.first[:-1], np.append(edge_base + first, edge_base + len(at)))
        self.at, self.next, self.ids = joined(self.at, base + at), joined(self.next, base + at + size), joined(self.ids, ids.astype(np.int32))
        self.logs, self.until = joined(self.logs, logs), joined(self.until, until)

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place, length, score and id of each piece in ``codes`` that ends with its chunk or before."""
        found = []
        single = np.zeros(len(codes), bool)
        alive, hashed = np.flatnonzero(left >= 1), None
        for size, (keys, letters, values, ids) in enumerate(self.table.by_length, 1):
            if size > 1:
                inside = left[alive] >= size
                alive, hashed = alive[inside], hashed[inside]
            hashed = _extended(np.zeros(len(alive), np.uint64) if hashed is None else hashed, codes[alive + size - 1])
            place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            # Beginnings have distinct hashes, so equal hashes of equal last characters mean equal beginnings.
            hit = (keys[place] == hashed) & (letters[place] == codes[alive + size - 1])
            alive, hashed, place = alive[hit], hashed[hit], place[hit]
            piece = ids[place] >= 0
            at, place = alive[piece], place[piece]
            if size == 1:
                single[at] = True
            found.append((at, np.full(len(at), size), values[place], ids[place]))
        # A character without a piece is spelled in bytes, as one edge of its own.
        odd = np.flatnonzero(~single & (left > 0))
        lengths = 1 + (codes[odd] > 0x7F).astype(int) + (codes[odd] > 0x7FF) + (codes[odd] > 0xFFFF)
        found.append((odd, np.ones(len(odd), int), lengths * self.table.model.byte_score, np.full(len(odd), -1)))
        at, size, score, ids = (np.concatenate(x) for x in zip(*found))
        return at, size, score * self.temperature, ids

    def piece_ids(self, edges: np.ndarray) -> np.ndarray:
        """The ids of a path, with spelled characters as the ids of their bytes."""
        ids = self.ids[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        raw = [chr(self.codes[self.at[e]]).encode("utf-8", "surrogatepass") for e in edges[odd]]
        out = np.repeat(ids, 1 + np.bincount(odd, weights=[len(r) - 1 for r in raw], minlength=len(ids)).astype(int))
        out[out < 0] = [self.byte_ids[b] for r in raw for b in r]
        return out


def _keyed(seed: int, *parts: int) -> int:
    """A key for random numbers, from a row's key and what they are for."""
    for part in parts:
        seed = (seed ^ (part + 1) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & _MASK
        seed ^= seed >> 31
    return seed


def _uniform(keys: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and place alone."""
    with np.errstate(over="ignore"):
        return ((mixed(keys + np.asarray(at).astype(np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(states: np.ndarray, keys: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Draws the edges from each state to the end of its chunk by their probabilities: (edges, how many for each state)."""
    walk = np.flatnonzero(~lattice.ended[states])
    now, step, drawn = states[walk], 0, []
    while len(walk):
        u = _uniform(keys[walk], step)
        edge, last = lattice.first[now], lattice.first[now + 1] - 1
        open_ = np.flatnonzero((lattice.until[edge] < u) & (edge < last))
        while len(open_):
            edge[open_] += 1
            open_ = open_[(lattice.until[edge[open_]] < u[open_]) & (edge[open_] < last[open_])]
        drawn.append((walk, edge))
        now = lattice.next[edge]
        alive = ~lattice.ended[now]
        now, walk = now[alive], walk[alive]
        step += 1
    counts = np.zeros(len(states), np.int64)
    for walk, _ in drawn:
        counts[walk] += 1
    firsts = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), np.int64)
    for step, (walk, edge) in enumerate(drawn):
        edges[firsts[walk] + step] = edge
    return edges, counts


def _below(mass: float, bound: float, u: float) -> float:
    """The largest Gumbel of a set of mass ``mass``, given that it is below ``bound``."""
    top = math.log(mass)
    return top - math.log(math.exp(min(top - bound, 700.0)) - math.log(u))


class _Search:
    """A best-first search over sets of segmentations of one text, in which a set's bound is the largest Gumbel in it.

    Taking the best member out of a set leaves, for each place, the set that agrees with the member before the place
    and differs there. The largest of their bounds is the largest Gumbel of all that is left, and it falls to a place by
    the places' masses; so does the next one among the other places. Only so many bounds are drawn as can still be
    reached. The best bound that remains at the end is the threshold of the inclusion probabilities.
    """

    def __init__(self, states: np.ndarray, seed: int, k: int):
        self.states, self.seed, self.k = states, seed, k
        self.bound = -math.log(-math.log(self._draw(0, 0)))
        self.at, self.barred, self.head, self.chunk = 0, [], np.empty(0, np.int64), -1
        self.found: list[tuple[np.ndarray, float, float]] = []
        #: Each set: its bound, the segmentation it agrees with, its chunk ends, the place, the edges barred there.
        self.sets: list[tuple[float, np.ndarray, np.ndarray, int, list[int]]] = []

    def _draw(self, what: int, number: int) -> float:
        """A number in (0, 1) for one choice after so many samples as are found."""
        turn = len(self.found) if what else 0
        return ((_keyed(self.seed, turn, what, number) >> 11) + 0.5) * 2.0**-53

    def starts(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """The states from which the next segmentation has to be drawn, and the keys of their random numbers."""
        chunks = np.arange(self.chunk + 1, len(self.states))
        states = self.states[self.chunk + 1 :]
        if self.chunk >= 0:
            states, chunks = np.concatenate([lattice.next[self.head[-1:]], states]), np.concatenate([[self.chunk], chunks])
        with np.errstate(over="ignore"):
            return states, mixed(chunks.astype(np.uint64) * _STEP + np.uint64(_keyed(self.seed, len(self.found), _WALK)))

    def take(self, edges: np.ndarray, counts: np.ndarray, lattice: Lattice) -> None:
        """Takes the segmentation that was drawn, splits the rest of its set, and turns to the best set that is left."""
        ends = np.cumsum(counts) + len(self.head)
        if self.chunk >= 0:
            ends = np.concatenate([self.ends[: self.chunk], ends])
            edges = np.concatenate([self.head, edges])
        after = np.cumsum(lattice.logs[edges])
        self.found.append((edges, float(after[-1]), self.bound))
        self._split(edges, ends, after, lattice)
        if len(self.found) < self.k and self.sets:
            self._turn(lattice)
        else:
            self.k = len(self.found)

    def _split(self, edges: np.ndarray, ends: np.ndarray, after: np.ndarray, lattice: Lattice) -> None:
        """Draws the best bounds among the sets that differ from ``edges`` at one place. Masses are relative to the set
        of all segmentations with the same edges before the first place."""
        at = self.at
        start = float(after[at - 1]) if at else 0.0
        whole = 1.0 - float(np.exp(lattice.logs[self.barred]).sum()) if self.barred else 1.0
        stay = math.exp(float(after[at]) - start)
        first = max(0.0, whole - stay)
        bound, taken = self.bound, []
        for number in range(self.k - len(self.found) + 1):
            mass = first + stay * -math.expm1(float(after[-1] - after[at])) - sum(m for _, m, _ in taken)
            if mass <= 1e-12:
                break
            bound = start + _below(mass, bound - start, self._draw(_BOUND, number))
            point = mass * self._draw(_PLACE, number)
            for _, m, low in sorted(taken, key=lambda t: t[2]):
                point += m if point >= low else 0.0
            # The mass up to a place is that of all segmentations that leave ``edges`` there or before.
            place, low, high = at, 0.0, first
            if point >= first:
                rest = stay - (point - first)
                level = start + math.log(rest) if rest > 0.0 else -math.inf
                place = min(max(at + 1, int(np.searchsorted(-after, -level))), len(edges) - 1)
                low = first + stay - math.exp(float(after[place - 1]) - start)
                high = first + stay - math.exp(float(after[place]) - start)
            if any(t[0] == place for t in taken) or high <= low:  # nothing but rounding is left
                break
            taken.append((place, high - low, low))
            self.sets.append((bound, edges, ends, place, (self.barred if place == at else []) + [int(edges[place])]))

    def _turn(self, lattice: Lattice) -> None:
        """Draws where the next segmentation leaves the base of the best set."""
        self.bound, base, self.ends, self.at, self.barred = self.sets.pop(max(range(len(self.sets)), key=lambda i: self.sets[i][0]))
        self.chunk = int(np.searchsorted(self.ends, self.at, side="right"))
        state = lattice.at[base[self.at]]
        options = np.setdiff1d(np.arange(lattice.first[state], lattice.first[state + 1]), self.barred)
        weights = np.cumsum(np.exp(lattice.logs[options]))
        chosen = options[min(int(np.searchsorted(weights, self._draw(_TURN, 0) * weights[-1], side="right")), len(options) - 1)]
        self.head = np.append(base[: self.at], chosen)

    def results(self) -> list[tuple[np.ndarray, float, float, float]]:
        threshold = max((s[0] for s in self.sets), default=-np.inf)
        return [(edges, log_p, perturbed, log_inclusion(log_p, threshold)) for edges, log_p, perturbed in self.found]


def log_inclusion(log_p: float, threshold: float) -> float:
    """The logarithm of the probability that a Gumbel with location ``log_p`` is over ``threshold``; finite for any text."""
    if threshold == -np.inf:
        return 0.0
    over = log_p - threshold
    return over if over < -30.0 else float(np.log(-np.expm1(-np.exp(min(over, 700.0)))))


def sample_segmentations(states: list[np.ndarray], lattice: Lattice, seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations in the order of their perturbed log-probability:
    (edges, log-probability, perturbed, log-inclusion). All texts are drawn together, each with its own random numbers.
    """
    searches = [_Search(s, seed & _MASK, k) for s, seed in zip(states, seeds)]
    for _ in range(k):
        now = [s for s in searches if len(s.found) < s.k]
        if not now:
            break
        starts, keys = zip(*(s.starts(lattice) for s in now))
        edges, counts = _walk(np.concatenate(starts), np.concatenate(keys), lattice)
        walk_ends = np.cumsum([len(s) for s in starts])
        edge_ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], walk_ends])]
        for i, (search, end) in enumerate(zip(now, walk_ends)):
            search.take(edges[edge_ends[i] : edge_ends[i + 1]], counts[end - len(starts[i]) : end], lattice)
    return [s.results() for s in searches]


_TABLES: dict[str, PieceTable] = {}


def worker_table(vocabulary: str) -> PieceTable:
    if vocabulary not in _TABLES:
        _TABLES[vocabulary] = PieceTable(public_unigram(vocabulary))
    return _TABLES[vocabulary]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[str]]]:
    """Rows of batches in portions of about ``BATCH_CHARS`` characters."""
    for batch in batches:
        ids, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS or i == len(texts) - 1:
                yield ids[start : i + 1], keys[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0


def sample_encodings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, vocabulary: str = VOCABULARY, temperature: float = 1.0) -> DataFrame:
    """Up to ``k`` rows per document: doc_id, sample (from 1), n_pieces, log_prob, perturbed, log_inclusion, ids, decoded_same.

    The samples of a document are distinct segmentations of its whole text, drawn without replacement by their
    probabilities, and depend on its id and text alone. Pieces do not span spaces, line ends, or letters and marks.
    ``log_inclusion`` is the logarithm of the inclusion probability, which itself is too small for a double where a text
    is long. ``decoded_same`` says that decoding gives the text back; texts that hold the sign for a space themselves
    come back with spaces. A null text counts as empty and has the one segmentation of the space in front of it; repeated
    rows have equal samples; an empty table gives no rows; further columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lattice = worker_table(vocabulary), None
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.bool_())
        names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids", "decoded_same"]
        for doc_ids, keys, texts in _portions(batches):
            if lattice is None or len(lattice.codes) > MAX_STATES:
                lattice = Lattice(table, temperature)
            rows = []
            for doc_id, text, samples in zip(doc_ids, texts, sample_segmentations(lattice.read(texts), lattice, keys, k)):
                plain = text.replace(SPACE, " ")
                for rank, (edges, log_p, perturbed, inclusion) in enumerate(samples, 1):
                    ids = lattice.piece_ids(edges)
                    same = table.decode(ids) == plain
                    rows.append((doc_id, rank, len(ids), log_p, perturbed, inclusion, ids.astype("<u4").tobytes(), same))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(encode, "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids binary, decoded_same boolean")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sample_encodings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return samples.select("doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", F.crc32("ids").alias("ids_crc32"), "decoded_same")
