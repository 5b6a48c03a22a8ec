"""Hashed word shingles of whole texts, many texts at once, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that are hashed at once.
PIECE = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_RANDOM = np.random.default_rng(20)
#: Odd multipliers, one for each word of a shingle, and one for its number of words.
_STEPS = _RANDOM.integers(1 << 62, 1 << 63, 33, dtype=np.uint64) | np.uint64(1)
#: A random number for each byte, and factors for its place in a word: place = 4096 * high + low.
_BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOW, _HIGH = (_RANDOM.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word: sums of the bytes' random numbers, each times a factor for its place."""
    codes = np.frombuffer(raw.translate(_LOWER), np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    np.logical_not(_BLANK[codes], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    codes = codes[inside[1:-1]]
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        values = _BYTES[codes] * _LOW[place & 4095]
        if sizes.max() > 4096:
            values *= np.where(place > 4095, _HIGH[(place >> 12) & 4095] + (place >> 24).astype(np.uint64) * np.uint64(2), np.uint64(1))
        return mixed(np.add.reduceat(values, firsts) + sizes.astype(np.uint64)), starts


def _long_text(raw: bytes) -> np.ndarray:
    """The word hashes of a text of any length, cut into pieces at white space."""
    found, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        found.append(_word_hashes(raw[start:end])[0])
        start = end
    return np.concatenate([*found, np.empty(0, np.uint64)])


def _shingled(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the shingle that begins at each word; windows run on over ends of texts."""
    with np.errstate(over="ignore"):
        total = np.full(max(0, len(words) - size + 1), _STEPS[-1] * np.uint64(size), np.uint64)
        for k in range(size):
            total += words[k : len(words) - size + 1 + k] * _STEPS[k % 32]
        return mixed(total)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def _group(raws: list[bytes], size: int) -> Iterator[np.ndarray]:
    words, starts = _word_hashes(b" ".join(raws))
    offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
    cuts = np.searchsorted(starts, offsets).tolist()
    windows = _shingled(words, size)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= size:
            yield _distinct(windows[a : b - size + 1])
        else:
            yield _shingled(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def shingle_sets(raws: Iterable[bytes], size: int) -> Iterator[np.ndarray]:
    """For each UTF-8 text the sorted hashes of its distinct ``size``-word shingles; with fewer words, of the whole
    sequence; empty without words.

    Words are runs of other than ASCII white space, with A-Z lower-cased.
    """
    waiting, held = [], 0
    for raw in raws:
        if len(raw) > PIECE:
            yield from _group(waiting, size) if waiting else ()
            waiting, held = [], 0
            words = _long_text(raw)
            yield _distinct(_shingled(words, min(size, len(words)))) if len(words) else words
            continue
        waiting.append(raw)
        held += len(raw)
        if held > PIECE:
            yield from _group(waiting, size)
            waiting, held = [], 0
    if waiting:
        yield from _group(waiting, size)


def shingle_set(text: str | bytes, size: int) -> np.ndarray:
    """The shingle set of one text."""
    return next(shingle_sets([text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text], size))
