"""Line dedup that can be undone: sharded cuckoo filters over exact tables of references.

A line's key is the line without white space at its ends and with A-Z lower-cased. The index has a row for each document
and key (``refs``), the number of documents and the largest document of each key (``counts``), and for each shard a
cuckoo filter of the keys that enough documents hold. Documents are read against the filters, so that only lines that may
be repeated are joined to the exact table, which decides. Inserting and deleting documents changes counts, and keys
enter and leave the filters as they cross the threshold; every change gives a new index and leaves the old one as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, materialise, text_of
from .cuckoo import LOAD, SLOTS, CuckooFilter

#: A key counts when it has so many code points, and repeats when so many documents hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Filters are broadcast up to this size in all; beyond it every key goes through the exact join.
FILTER_BYTES = 64 << 20
SHARDS = 64
_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LATER_BYTES = bytes(range(0x80, 0xC0))
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class LineIndex:
    """One version of the index; its tables are on shared files."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    need: int = LEAST_DOCS
    chars: int = LEAST_CHARS


def line_keys(text: bytes, chars: int) -> dict[bytes, list[int]]:
    """The digest of each key of at least ``chars`` code points in a text, with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for number, line in enumerate(text.translate(_LOWER).split(b"\n")):
        line = line.strip(_BLANKS)
        if len(line) >= chars and (len(line) >= 4 * chars or len(line.translate(None, _LATER_BYTES)) >= chars):
            found.setdefault(hashlib.blake2b(line, digest_size=16).digest(), []).append(number)
    return found


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _refs(docs: DataFrame, chars: int) -> DataFrame:
    """(k1, k2, doc_id): each key of each document once."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owners = [], []
            for owner, text in enumerate(_texts(batch)):
                keys = line_keys(text, chars)
                digests += keys
                owners += [owner] * len(keys)
            halves = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(pa.array(owners, pa.int64()))], ["k1", "k2", "doc_id"])

    refs = docs.select("doc_id", "text").mapInArrow(read, "k1 long, k2 long, doc_id long")
    # Rows with one id are one document.
    return refs.dropDuplicates() if docs.groupBy("doc_id").count().where("count > 1").limit(1).count() else refs


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int")


def _changed_filters(filters: DataFrame, changes: DataFrame, counts: DataFrame, need: int) -> DataFrame:
    """The filters after ``changes`` (k1, k2, step: 1 enters, -1 leaves). A shard that would get too full, or that could
    not place its keys, is made anew from the exact table."""
    shards = filters.count()
    changes = changes.withColumn("shard", _shard(shards))
    sizes = filters.select("shard", "full", (F.length("table") / 2).alias("slots"), "n_keys").join(changes.groupBy("shard").agg(F.sum("step").alias("more"), F.count(F.lit(1)).alias("moved")), "shard")
    sizes = sizes.select("shard", (F.col("full") | (F.col("n_keys") + F.col("more") > F.col("slots") * LOAD) | (F.col("moved") > F.col("slots"))).alias("anew"))
    touched = F.broadcast(sizes)  # a row for each shard
    anew = counts.where(F.col("n_docs") >= need).withColumn("shard", _shard(shards)).join(touched.where("anew"), "shard").select("shard", "k1", F.lit(0).alias("step"))
    steps = changes.join(touched.where("not anew"), "shard").select("shard", "k1", "step").unionByName(anew).unionByName(touched.where("anew").select("shard", F.lit(0).cast("long").alias("k1"), F.lit(2).alias("step")))

    def change(shard: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        row, step = old.iloc[0], new["step"].to_numpy()
        keys = new["k1"].to_numpy(np.int64).view(np.uint64)
        if (step == 2).any():
            kept = CuckooFilter.of(keys[step == 0])
            n_keys = int((step == 0).sum())
        else:
            kept = CuckooFilter(len(row.table) // (2 * SLOTS), row.table, bool(row.full))
            kept.remove(keys[step == -1])
            kept.add(keys[step == 1])
            n_keys = int(row.n_keys + step.sum())
        return pd.DataFrame({"shard": [int(shard[0])], "n_keys": [n_keys], "full": [kept.full], "table": [kept.table.tobytes()]})

    return filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(change, filters.schema)


def empty_index(spark: SparkSession, need: int = LEAST_DOCS, chars: int = LEAST_CHARS, shards: int = SHARDS) -> LineIndex:
    """An index of no documents."""
    blank = CuckooFilter(16).table.tobytes()
    return LineIndex(
        spark.createDataFrame([], "k1 long, k2 long, doc_id long"), spark.createDataFrame([], "k1 long, k2 long, n_docs long, top_doc long"),
        spark.createDataFrame([(i, 0, False, bytearray(blank)) for i in range(shards)], "shard int, n_keys long, full boolean, table binary"), need, chars,
    )


def _with(index: LineIndex, refs: DataFrame, counts: DataFrame, moved: DataFrame) -> LineIndex:
    """``moved``: keys with their numbers of documents before and after."""
    step = F.when((F.col("before") < index.need) & (F.col("after") >= index.need), 1).when((F.col("before") >= index.need) & (F.col("after") < index.need), -1)
    moved = moved.select(*KEY, step.alias("step")).where("step is not null")
    filters = materialise(_changed_filters(index.filters, moved, counts, index.need), "line-filters")
    return LineIndex(refs, counts, filters, index.need, index.chars)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with these documents. Lines of an id that it has already are added to that document."""
    spark = docs.sparkSession
    new, old = _refs(_given(docs, id_col, text_col), index.chars), index.refs
    first = old.isEmpty()
    if not first:
        known = [new.k1 == old.k1, new.k2 == old.k2, new.doc_id.eqNullSafe(old.doc_id)]
        new = new.join(old, known, "left_anti")
    new = materialise(new, "line-refs")
    counted = new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
    if first:
        counted = counted.withColumn("before", F.lit(0).cast("long"))
    else:
        both = counted.withColumn("before", F.lit(0).cast("long")).unionByName(index.counts.withColumn("before", F.col("n_docs")))
        counted = both.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"), F.sum("before").alias("before"))
    counted = materialise(counted, "line-counts")
    moved = counted.select(*KEY, "before", F.col("n_docs").alias("after"))
    return _with(index, new if first else spark.read.schema(new.schema).parquet(*_files(old), *_files(new)), counted.drop("before"), moved)


def _files(df: DataFrame) -> list[str]:
    return df.inputFiles()


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents with these ids; ids that it does not have change nothing."""
    ids = ids.select(F.col(id_col).cast("long").alias("gone")).distinct()
    refs = materialise(index.refs.join(ids, index.refs.doc_id.eqNullSafe(F.col("gone")), "left_anti"), "line-refs")
    lost = index.refs.join(ids, index.refs.doc_id.eqNullSafe(F.col("gone")), "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("lost"))
    touched = materialise(index.counts.join(lost, KEY).select(*KEY, F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("lost")).alias("after")), "line-touched")
    # Only keys that lost a document look for their largest document anew.
    tops = lookup_join(refs, touched.where("after > 0"), KEY, "after").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
    counts = materialise(index.counts.join(touched.select(*KEY), KEY, "left_anti").unionByName(tops), "line-counts")
    return _with(index, refs, counts, touched)


def _loaded(index: LineIndex):
    """The filters by shard as a broadcast variable, or nothing when they are larger than ``FILTER_BYTES``."""
    total = index.filters.agg(F.sum(F.length("table"))).first()[0] or 0
    if total > FILTER_BYTES:
        return None
    rows = index.filters.orderBy("shard").collect()
    return index.filters.sparkSession.sparkContext.broadcast([(len(r.table) // (2 * SLOTS), bytes(r.table), r.full) for r in rows])


READ = "row long, doc_id long, n_lines long, kept_sha256 string, text binary, hits array<struct<k1:long,k2:long,lines:array<int>>>"
_HITS = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("lines", pa.list_(pa.int32()))]))


def _candidates(docs: DataFrame, index: LineIndex, all_texts: bool) -> DataFrame:
    """A row for each document, with the keys that the filters do not rule out; the text where there are any, or always."""
    loaded, chars = _loaded(index), index.chars

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if loaded is None else [CuckooFilter(*x) for x in loaded.value]
        for batch in batches:
            out = {"n_lines": [], "kept_sha256": [], "text": [], "hits": []}
            for text in _texts(batch):
                keys = line_keys(text, chars)
                halves = _halves(list(keys))
                passed = np.ones(len(halves), bool)
                if filters is not None and len(halves):
                    shards = halves[:, 1] % len(filters)
                    for shard in np.unique(shards).tolist():
                        own = shards == shard
                        passed[own] = filters[shard].holds(halves[own, 0].view(np.uint64))
                hits = [{"k1": a, "k2": b, "lines": lines} for ok, (a, b), lines in zip(passed.tolist(), halves.tolist(), keys.values(), strict=True) if ok]
                out["n_lines"].append(text.count(b"\n") + 1)
                out["hits"].append(hits)
                out["text"].append(text if hits or all_texts else None)
                out["kept_sha256"].append(None if hits else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(out["n_lines"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["text"], pa.binary()), pa.array(out["hits"], _HITS)],
                ["row", "doc_id", "n_lines", "kept_sha256", "text", "hits"],
            )

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(read, READ)


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the lines with the numbers in ``drop`` out of each text."""
    for batch in batches:
        texts, counts = [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            gone = set(drop or ())
            texts.append(b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in gone) if gone else text)
            counts.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("n_lines"), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
            ["row", "doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
        )


def drop_repeated_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Takes the lines out of ``docs`` whose key at least ``index.need`` documents of the index hold, except in the one
    with the largest id. Returns (doc_id, n_lines, n_dropped, kept_sha256) and, ``with_text``, kept_text.

    A null or empty text is one empty line. Rows with one id, or without one, are one document to the counts, and come
    back as often as given; a null id is less than all others. An empty table gives no rows; further columns are ignored.
    Of a document that loses all its lines an empty text is left.
    """
    given = _given(docs, id_col, text_col)
    rows = materialise(_candidates(given, index, with_text), "line-candidates")
    hits = rows.select("row", "doc_id", F.explode("hits").alias("hit")).select("row", F.col("doc_id").alias("own"), "hit.*")
    repeated = index.counts.where(F.col("n_docs") >= index.need)
    dropped = lookup_join(hits, repeated, KEY, "n_docs").where(~F.col("own").eqNullSafe(F.col("top_doc")))
    drops = dropped.groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("drop"))
    changed = rows.where("kept_sha256 is null").select("row", "doc_id", "n_lines", "text").join(drops, "row", "left")
    changed = changed.mapInArrow(_kept, "row long, doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    same = rows.where("kept_sha256 is not null").withColumn("n_dropped", F.lit(0).cast("long")).withColumn("kept_text", F.col("text").cast("string"))
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if with_text else [])]
    return changed.select(*names).unionByName(same.select(*names))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs, insert(empty_index(spark), docs), with_text=False)


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (
  select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (
  select r, doc_id, line, i,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from e),
g as (
  select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (
  select k.r, k.doc_id, k.line, k.i, coalesce(g.top <> k.doc_id, false) as gone from k left join g using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by r
"""
