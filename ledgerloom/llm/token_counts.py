"""Token counts: forward scores of a unigram model, computed once for each prefix in a trie of pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .unigram import SPACE, VOCABULARY, Unigram, public_unigram

#: Nodes and pre-tokens that a worker holds; the trie starts anew when it is full.
MAX_NODES, MAX_WORDS = 600_000, 300_000
#: Longer pre-tokens are counted without the trie, so that it never holds many more nodes than that.
LONG_WORD = 500


def best_count(text: str, model: Unigram) -> int:
    """The number of pieces of the best segmentation; of the forward scores only those that a piece can reach are held."""
    longest = model.longest
    best, tokens = [0.0] * (longest + 1), [0] * (longest + 1)
    for end, char in enumerate(text, 1):
        size, score = model.spelled(char) if char not in model.scores else (1, model.scores[char])
        top, count = best[(end - 1) % (longest + 1)] + score, tokens[(end - 1) % (longest + 1)] + size
        for start in range(max(0, end - longest), end - 1):
            score = model.scores.get(text[start:end])
            at = start % (longest + 1)
            if score is not None and best[at] + score > top:
                top, count = best[at] + score, tokens[at] + 1
        best[end % (longest + 1)], tokens[end % (longest + 1)] = top, count
    return tokens[len(text) % (longest + 1)]


class PrefixTrie(dict):
    """Pre-token to token count. A missing one is inserted: nodes on its path that exist keep their forward scores, only
    new nodes are computed, and the count of the best segmentation is stored at its last node. Very long ones are counted
    without it."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model = model
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}  # node * 2 ** 21 + code point, to node
        self.best, self.tokens = [0.0], [0]

    def __missing__(self, word: str) -> int:
        if len(self.best) > MAX_NODES or len(self) > MAX_WORDS:
            self.restart()
        text = SPACE + word
        if len(word) > LONG_WORD:
            return best_count(text, self.model)
        model, best, tokens = self.model, self.best, self.tokens
        scores, longest, path, node = model.scores, model.longest, [0], 0
        for end, char in enumerate(text, 1):
            edge = node << 21 | ord(char)
            child = self.children.get(edge)
            if child is None:
                size, score = model.spelled(char) if char not in scores else (1, scores[char])
                top, count = best[node] + score, tokens[node] + size
                for start in range(max(0, end - longest), end - 1):
                    score = scores.get(text[start:end])
                    if score is not None and best[path[start]] + score > top:
                        top, count = best[path[start]] + score, tokens[path[start]] + 1
                child = self.children[edge] = len(best)
                best.append(top)
                tokens.append(count)
            node = child
            path.append(node)
        self[word] = tokens[node]
        return tokens[node]


_TRIES: dict[str, PrefixTrie] = {}


def worker_trie(vocabulary: str) -> PrefixTrie:
    if vocabulary not in _TRIES:
        _TRIES[vocabulary] = PrefixTrie(public_unigram(vocabulary))
    return _TRIES[vocabulary]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_chars, n_words, n_tokens.

    Pre-tokens are runs of other than white space, each with the sign for a space in front; white space itself has no
    tokens. Each task counts whole documents with a trie of its own, so nothing is shuffled. A null or empty text has no
    tokens; repeated rows are counted alike; an empty table gives no rows; further columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_trie(vocabulary)
        for batch in batches:
            words = [text.split() for text in batch.column("text").to_pylist()]
            tokens = [sum(map(trie.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array([len(w) for w in words], pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text_of(text_col)).cast("long").alias("n_chars"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_chars long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
