"""Exact dedup through an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup_join, materialise, text_of

#: What normalisation deletes: the characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: The directory never has more than 2 ** MAX_DEPTH cells, so it stays small on the driver; fuller buckets chain pages.
MAX_DEPTH = 14


def normalised(text: Column) -> Column:
    """The text without white space. Nested replacements work on bytes and are quicker than one pattern."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def split_directory(counts: dict[int, int], probe_bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """Grows an extendible-hash directory from the entry counts of its finest cells.

    Starts with one bucket of depth 0 and splits every bucket over ``capacity`` by its next hash bit, doubling the
    directory when a bucket is as deep as the directory, until buckets fit or ``probe_bits`` are used up. Returns
    (first cell, cell after the last, local depth) for each bucket in the order of the hash.
    """
    running = [0]
    for cell in range(1 << probe_bits):
        running.append(running[-1] + counts.get(cell, 0))
    done, open_ = [], [(0, 1 << probe_bits, 0)]
    while open_:
        low, high, depth = open_.pop()
        if running[high] - running[low] > capacity and depth < probe_bits:
            middle = (low + high) // 2
            open_ += [(middle, high, depth + 1), (low, middle, depth + 1)]
        else:
            done.append((low, high, depth))
    return sorted(done)


def _cell(key: str, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit hash."""
    return F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 50_000, owners: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Builds the index over ``docs``; returns (one narrow row per document with its bucket, one index entry per distinct text).

    Both are tables on shared files. An entry has its bucket, its place in the chain of texts with the same 64-bit key,
    and the document that stays. The directory splits on distinct keys, so copies never overfill a bucket; it leads each
    document to its bucket. Owner tasks hold ranges of buckets and keys. Texts that share a key are told apart by
    comparing their bytes: whole texts are grouped, pre-aggregated before the shuffle.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    norm = normalised(text)
    rows = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("text_key"), norm.alias("norm")).select(
            "doc_id", "n_chars", "text_key", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
        ),
        "dedup-rows",
    )
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row"))
    groups = materialise(rows.groupBy("key", "text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    entries = groups.count()
    bits = min(MAX_DEPTH, max(0, (8 * entries // bucket_capacity).bit_length()))
    counts = {r["cell"]: r["count"] for r in groups.groupBy(_cell("key", bits).alias("cell")).count().collect()}
    buckets = split_directory(counts, bits, bucket_capacity)
    directory = F.broadcast(spark.createDataFrame([(cell, number) for number, (low, high, _) in enumerate(buckets) for cell in range(low, high)], "cell int, bucket int"))
    in_bucket = lambda frame: frame.withColumn("cell", _cell("key", bits)).join(directory, "cell").drop("cell")
    compared = (
        docs.select(norm.alias("norm"))
        .select(F.xxhash64("norm").alias("key"), "norm")
        .groupBy("key", "norm")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "copies")
    )
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    index = (
        in_bucket(groups.join(compared, ["key", "text_sha256"]))
        # Two texts with one digest would give a group fewer copies than rows.
        .where(F.assert_true(F.col("copies") == F.col("group_size"), F.lit("texts with one digest differ")).isNull())
        .withColumn("chain", F.row_number().over(chain))
        .select("bucket", "key", "chain", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.shorter").alias("shorter"), F.col("best.text_key").alias("keep_text_key"), "group_size")
        .repartitionByRange(owners or min(len(buckets), 4 * spark.sparkContext.defaultParallelism), "bucket", "key")
        .sortWithinPartitions("bucket", "key", "chain")
    )
    return in_bucket(rows), materialise(index, "dedup-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 50_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the longest original stays, then the
    smallest id. A null text counts as empty; a null id comes after all others; of repeated rows with one id and text,
    one row is kept; an empty table gives no rows; further columns are ignored.
    """
    rows, index = build_index(docs, id_col, text_col, bucket_capacity)
    entries = index.select("bucket", "key", "text_sha256", "keep_id", "keep_row", "group_size")
    found = lookup_join(rows, entries, ["bucket", "key", "text_sha256"], "group_size")
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text: the longest original, then the one with the smallest id, then any of
    the rows with that id and text. Columns as given, whatever their names; nulls as in ``exact_dedup``."""
    rows, index = build_index(docs, id_col, text_col)
    stays = materialise(index.select(F.col("text_sha256").alias("sha"), (-F.col("shorter")).alias("chars"), F.col("keep_id"), F.col("keep_text_key")), "dedup-stays")
    again = ["key", "text_sha256", "n_chars", "doc_id", "text_key"]
    repeated = materialise(rows.groupBy(*again).count().where("count > 1").select(F.col("text_sha256").alias("sha")).distinct(), "dedup-repeated")
    text = text_of(text_col)
    given = docs.select(F.struct(*docs.columns).alias("given"), F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("n"), F.xxhash64(text).alias("t"), F.sha2(normalised(text), 256).alias("own"))
    same = (F.col("own") == F.col("sha")) & (F.col("n") == F.col("chars")) & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("t") == F.col("keep_text_key"))
    kept = given.join(stays, same, "left_semi")
    if repeated.limit(1).count():
        several = kept.join(repeated, F.col("own") == F.col("sha"), "left_semi").dropDuplicates(["own"])
        kept = kept.join(repeated, F.col("own") == F.col("sha"), "left_anti").unionByName(several)
    return kept.select("given.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (
  select text_sha256, count(*) as group_size, arg_min(doc_id, {'n': -n, 'd': doc_id}) as keep_id from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256 from t join g using (text_sha256)
"""
