"""Packing: documents in the order of a Hilbert curve through hashed vectors, cut into sequences of tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_of

VOCABULARY = "word_bpe_49k.json"
SEQUENCE_LENGTH = 4096
#: Id that ends each document.
END_ID = 2
#: Chunks of text whose ids a worker keeps; the store is emptied when it is full.
CHUNK_STORE = 1_000_000
#: The ASCII marks: neither letters nor digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: How byte-level vocabularies show bytes: printable ones as themselves, others as letters from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Buckets of hashed words, dimensions of the projection and bits of each on the curve.
WORD_BUCKETS, DIMENSIONS, BITS = 1024, 4, 7
#: Rows of the corpus for each range of the curve.
RANGE_ROWS = 20_000


class ChunkTokenizer(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit numbers.

    The vocabulary's pre-tokens never span a space or a line end, so the chunks between them are encoded once. Its
    normaliser lower-cases, so A-Z are lower-cased first and more chunks are equal, unless a special token may stand in
    the text. A chunk of Latin letters is one pre-token, and ASCII marks behind it are another: these go to the
    vocabulary's merges at once. Every other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def _word(self, text: str) -> bytes:
        shown = text.lower().encode("utf-8").decode("latin-1").translate(_SHOWN)
        return np.array([x.id for x in self.model.tokenize(shown)], "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        head = chunk.rstrip(MARKS)
        word = head.decode("utf-8", "surrogatepass")
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            found = self._word(word) + (self[chunk[len(head) :]] if len(head) < len(chunk) else b"")
        else:
            found = np.array(self.tokenizer.encode(chunk.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = found
        return found

    def encode(self, raw: bytes) -> bytes:
        if len(self) > CHUNK_STORE:
            self.clear()
        lowered = raw if b"<|" in raw else raw.translate(_LOWER)
        return b"".join(map(self.__getitem__, lowered.replace(b"\n", b" ").split(b" ")))


@lru_cache(maxsize=1)
def chunk_tokenizer(vocabulary: str) -> ChunkTokenizer:
    import public_tokenizers

    return ChunkTokenizer(public_tokenizers.path(vocabulary))


def projection(seed: int = 7) -> np.ndarray:
    """A fixed projection of bucket counts to ``DIMENSIONS``."""
    return np.random.default_rng(seed).standard_normal((WORD_BUCKETS, DIMENSIONS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows of ``cells``), each coordinate below 2 ** bits."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(n):
            on = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = np.where(on, x[d], x[d] ^ swap)
        q >>= 1
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ turn) >> bit) & 1)
    return key


def curve_keys(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as token ids: counts in hashed buckets, projected and scaled to unit length."""
    points = np.zeros((len(ids), DIMENSIONS))
    for row, tokens in enumerate(ids):
        if len(tokens):
            point = np.log1p(np.bincount((tokens * np.uint32(2654435761)) >> np.uint32(22), minlength=WORD_BUCKETS)) @ directions
            points[row] = point / (np.linalg.norm(point) or 1.0)
    return hilbert_key(np.clip(((points + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1))


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text_key, curve, n_tokens, ids of ``docs`` (doc_id, text): ids as little-endian unsigned 32-bit numbers with ``END_ID`` at the end."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, directions, end = chunk_tokenizer(vocabulary), projection(), np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [tokenizer.encode(text.as_buffer().to_pybytes() if text.as_buffer() else b"") for text in part.column("text")]
                keys = curve_keys([np.frombuffer(x, "<u4") for x in ids], directions)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.int64()), pa.array([len(x) // 4 + 1 for x in ids], pa.int64()), pa.array([x + end for x in ids], pa.binary())],
                    names=["doc_id", "text_key", "curve", "n_tokens", "ids"],
                )

    return docs.mapInArrow(encode, "doc_id long, text_key long, curve long, n_tokens long, ids binary")


def running_start(rows: DataFrame, order: list[str], amount: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``begin``: the sum of ``amount`` over all rows before this one in ``order``.

    Rows are range-partitioned; each range adds up its own rows, and only one total for each range meets in one task.
    """
    parts = max(1, rows.count() // range_rows + 1)
    ranged = materialise(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum(amount).alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("own", F.coalesce(F.sum(amount).over(own), F.lit(0))).join(F.broadcast(totals), "part").withColumn("begin", F.col("base") + F.col("own")).drop("part", "own", "base")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE_LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset, curve.

    Documents follow each other along the curve without a gap and are cut at every ``length`` tokens, so every sequence
    but the last is full. A null or empty text is a document with the end id alone. A null id is kept. Repeated rows
    are packed as often as they come. An empty table gives no rows. Further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    encoded = materialise(tokenise(texts.withColumn("text_key", F.xxhash64("text")), vocabulary).withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    # Equal texts share a point of the curve; the hash of the row spreads them over ranges.
    order = encoded.select("row", "curve", F.xxhash64("text_key", "row").alias("spread"), "n_tokens")
    placed = running_start(order, ["curve", "spread", "row"], "n_tokens").select("row", "begin")
    whole = encoded.join(placed, "row")
    begin, end, step = F.col("begin"), F.col("begin") + F.col("n_tokens"), F.lit(length)

    def piece(at):
        low, high = F.greatest(at, begin), F.least(at + step, end)
        start, size = low - begin, high - low
        ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * size).cast("int"))
        return F.struct(start.alias("start"), size.alias("length"), ids.alias("ids"), at.alias("at"), (low - at).alias("offset"))

    # Pieces are cut before the rows multiply, so a very long document is copied once and not once for each piece.
    pieces = F.transform(F.sequence(begin - F.pmod(begin, step), end - 1, step.cast("long")), piece)
    cut = whole.select("doc_id", "n_tokens", "curve", F.explode(pieces).alias("piece"))
    return cut.select(
        "doc_id", "piece.start", "piece.length", "piece.ids", F.col("n_tokens").alias("doc_tokens"),
        F.expr(f"piece.at div {length}").alias("sequence_id"), "piece.offset", "curve",
    )


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
