"""Toxicity: a weighted lexicon, learned from labelled rows and matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a word of the lexicon is harmless; a hit inside one does not count.
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "pathetic fallacy", "clown fish", "not stupid", "not an idiot"]
#: Bounds of the labelled sample the lexicon is learned from: toxic and other rows, chosen by the hash of their id.
MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
MIN_PREFIX, MAX_PREFIX = 3, 16
#: A row is held out of learning when crc32 of its id as text has this remainder zero.
FOLDS = 5

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0x200B: None, 0x200D: None, 0xAD: None}
#: The first measure of a text without hits or words, from which it is counted.
EMPTY = float(np.log(0.1 / 20.0))
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, with look-alike letters and digits that stand for letters replaced, and invisible characters gone."""
    return text.lower().translate(_FOLD)


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


@dataclass
class Lexicon:
    """Weights of word beginnings, the exception phrases, and the logistic curve over what they find in a text."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: list[float] | None = None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, entry))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), 0.0, None))
        found.make_automaton()
        return found

    def measures(self, texts) -> np.ndarray:
        """For each text, as logarithms: weight found per word, weight found, different entries found; zeros without a hit."""
        found, out = self.automaton(), np.zeros((len(texts), 3))
        if not self.weights:
            return out
        for row, text in enumerate(texts):
            text = fold(text)
            hits, safe = [], []
            for end, (length, weight, entry) in found.iter(text):
                start = end - length + 1
                if entry is None:
                    safe.append((start, end))
                elif not start or not text[start - 1].isalnum():
                    hits.append((start, end, weight, entry))
            if safe:
                hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in safe)]
            if hits:
                # Of entries that begin at one place, the longest counts.
                best = {h[0]: h for h in hits}
                # What is repeated over and over says little more than once.
                times = Counter(h[3] for h in best.values())
                total = sum(self.weights[entry] * (1.0 + math.log(n)) for entry, n in sorted(times.items()))
                words = text.count(" ") + text.count("\n") + 1
                out[row] = np.log((total + 0.1) / (words + 20.0)) - EMPTY, np.log1p(total), np.log1p(len(times))
        return out

    def scores(self, texts) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        bias, *slopes = self.curve
        return 1 / (1 + np.exp(-np.clip(bias + self.measures(texts) @ np.asarray(slopes), -30, 30)))


def word_beginnings(text: str) -> set[str]:
    return {w[:k] for w in set(_WORD.findall(fold(text))) for k in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1)}


def choose_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least_weight: float = 2.5) -> dict[str, float]:
    """Picks word beginnings by log-odds from (toxic rows, clean rows) that have each.

    A beginning yields to a one letter longer one that nearly all its toxic rows have, and a longer one is left out
    when a shorter one that was kept says as much.
    """
    weight = {w: float(np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))) for w, (p, n) in counts.items()}
    longer: dict[str, str] = {}
    for w, (p, _) in counts.items():
        if w[:-1] in counts and p >= 0.97 * counts[w[:-1]][0] and weight[w] >= weight[w[:-1]] - 0.05:
            longer[w[:-1]] = w
    kept: dict[str, float] = {}
    for w in sorted(counts, key=lambda w: (len(w), w)):
        if weight[w] >= least_weight and w not in longer and not any(kept.get(w[:k], -9.0) >= weight[w] - 0.7 for k in range(MIN_PREFIX, len(w))):
            kept[w] = weight[w]
    return kept


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Lexicon:
    """Learns from labelled rows that are not held out, at most ``max_toxic`` and ``max_clean`` of them.

    The sampled ids are bounded, so they are broadcast and the texts stay where they are. Without rows of both labels
    the lexicon is empty and every score is 0.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    take = lambda label, most: usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = take(1, max_toxic).unionByName(take(0, max_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (sizes.get(1) and sizes.get(0)):
        return Lexicon()

    def counted(only: frozenset[str] | None):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for text in batch["text"]:
                    seen.update(word_beginnings(text) if only is None else word_beginnings(text) & only)
            yield pd.DataFrame({"entry": list(seen.keys()), "rows": list(seen.values())}).astype({"entry": "object", "rows": "int64"})

        return count

    schema = "entry string, rows long"
    total = lambda label, only: texts.where(F.col("toxic") == label).mapInPandas(counted(only), schema).groupBy("entry").agg(F.sum("rows").alias("rows"))
    # In the bounded sample, a beginning with this support has so many rows: what reaches the driver is bounded too.
    support = max(5, sizes[1] // 200)
    toxic = {r.entry: r.rows for r in total(1, None).where(F.col("rows") >= support).collect()}
    clean = {r.entry: r.rows for r in total(0, frozenset(toxic)).collect()}
    lexicon = Lexicon(choose_entries({w: (p, clean.get(w, 0)) for w, p in toxic.items()}, sizes[1], sizes[0]))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(lexicon.measures(batch["text"]), columns=["a", "b", "c"]).assign(toxic=batch["toxic"].to_numpy())

    rows = texts.mapInPandas(measure, "a double, b double, c double, toxic int").toPandas()
    lexicon.curve = fit_curve(rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy(dtype=float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores are computed from the text alone; a null or empty text has the score of a text without hits. Repeated rows
    are scored alike, and an empty table gives no rows. Further columns are ignored.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": lexicon.scores(batch["text"])})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), text_of(text_col).alias("text"))
    scored = rows.mapInPandas(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; columns as given."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.scores(texts))

    return docs.where(score(text_of(text_col)) < 0.5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, learn_lexicon(docs, labels))
