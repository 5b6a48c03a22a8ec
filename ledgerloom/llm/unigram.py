"""Unigram scores of the pieces of a public vocabulary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"


@dataclass(frozen=True)
class Unigram:
    """Log-probabilities by piece. A character without a piece is spelled by its UTF-8 bytes."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    byte_score: float
    longest: int
    #: The bytes that each id stands for, the sign for a space as a space.
    surface: tuple[bytes, ...] = ()

    def edges(self, text: str, at: int) -> list[tuple[str, float]]:
        """The pieces that begin at ``at`` in ``text``."""
        scores, found = self.scores, []
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            score = scores.get(piece)
            if score is not None:
                found.append((piece, score))
        return found

    def spelled(self, char: str) -> tuple[int, float]:
        """(number of byte pieces, score) of a character without a piece."""
        size = len(char.encode("utf-8", "surrogatepass"))
        return size, size * self.byte_score


def make_unigram(pieces: list[str], ids: list[int], byte_ids: list[int], size: int) -> Unigram:
    """Gives the pieces, in the order of their ranks, the probabilities of Zipf's law; bytes are rarer than any piece."""
    ranks = np.log(np.arange(len(pieces)) + 10.0)
    scores = -ranks - np.log(np.exp(-ranks).sum())
    surface = [b""] * size
    for piece, number in zip(pieces, ids):
        surface[number] = piece.replace(SPACE, " ").encode("utf-8", "surrogatepass")
    for value, number in enumerate(byte_ids):
        surface[number] = bytes([value])
    return Unigram(dict(zip(pieces, scores.tolist())), dict(zip(pieces, ids)), tuple(byte_ids), float(scores.min() - 2.0), max(map(len, pieces)), tuple(surface))


@lru_cache(maxsize=1)
def public_unigram(vocabulary: str = VOCABULARY) -> Unigram:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    size = model.get_piece_size()
    bytes_ = [i for i in range(size) if model.is_byte(i)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return make_unigram([model.id_to_piece(i) for i in ranked], ranked, bytes_, size)
