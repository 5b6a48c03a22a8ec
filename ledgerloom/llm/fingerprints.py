"""Document fingerprints: a homomorphic multiset hash of a document's paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_of

#: Equality lanes and likeness lanes, both of 32 bits. A likeness lane counts up and down by one for each pair of words, so
#: it does not wrap in any text that a row can hold.
SUM_LANES, SKETCH_LANES = 8, 64
SUM_BASE = SKETCH_BASE = 1 << 32
#: Runs of other than white space are cut into pieces of so many characters for likeness.
PIECE_CHARS = 8
#: Ids are ordered with null before all others.
NO_ID = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """The lines of a text that are not blank, as they are. A text is equal to another, to this hash, when it has the
    same lines equally often."""
    return F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")


def features(paragraph: Column) -> Column:
    """Hashes of neighbouring pieces of words; the first piece stands with the beginning of the paragraph."""
    cut = F.regexp_replace(paragraph, rf"(\S{{{PIECE_CHARS}}})(?=\S)", "$1 ")
    pieces = F.filter(F.split(F.concat(F.lit("^ "), cut), r"\s+"), lambda w: w != "")
    return F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces)), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))


def _lane_sums(digest: Column, h: Column) -> list[Column]:
    """Sums over paragraphs: equality lanes of those with a ``digest``, then likeness lanes of features ``h``, two to a long."""
    sums = [F.sum(F.when(digest.isNotNull(), F.xxhash64(F.concat(digest, F.lit(f":{lane}"))).bitwiseAND(SUM_BASE - 1)).otherwise(0)).alias(f"e{lane}") for lane in range(SUM_LANES)]
    lane, sign = h.bitwiseAND(SKETCH_LANES - 1), F.when(F.shiftright(h, 20).bitwiseAND(1) == 1, 1).otherwise(-1).cast("long")
    step = F.when(lane.bitwiseAND(1) == 1, F.shiftleft(sign, 32)).otherwise(sign)
    sums += [F.sum(F.when(F.shiftright(lane, 1) == pair, step).otherwise(0)).alias(f"s{pair}") for pair in range(SKETCH_LANES // 2)]
    return sums


def _reduced(copies: Column) -> tuple[Column, Column]:
    """(equality lanes, likeness lanes) as arrays of longs, each modulo its power; sums hold ``copies`` equal rows."""
    even = lambda c: F.expr(f"`{c}` div copies")
    sums = F.array(*[F.pmod(even(f"e{lane}"), F.lit(SUM_BASE)) for lane in range(SUM_LANES)])
    low = lambda x: x.bitwiseAND(SUM_BASE - 1).bitwiseXOR(1 << 31) - (1 << 31)
    lanes = []
    for pair in range(SKETCH_LANES // 2):
        x = even(f"s{pair}")
        lanes += [F.pmod(low(x), F.lit(SKETCH_BASE)), F.pmod(F.shiftright(x - low(x), 32), F.lit(SKETCH_BASE))]
    return sums, F.array(*lanes)


def fingerprint_text(sums: Column, lanes: Column) -> Column:
    """Both arrays in hexadecimal, 8 digits a lane."""
    return F.array_join(F.transform(F.concat(sums, lanes), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def combine(left: Column, right: Column, base: int, sign: int = 1) -> Column:
    """The lanes after inserting (``sign`` 1) or deleting (-1) the paragraphs of ``right``."""
    return F.zip_with(left, right, lambda x, y: F.pmod(x + sign * y, F.lit(base)))


def likeness(left: Column, right: Column) -> Column:
    """Cosine of two arrays of likeness lanes, from 0 to 1; 1 of two empty ones, 0 of one empty one."""
    signed = lambda x: (x.bitwiseXOR(SKETCH_BASE // 2) - SKETCH_BASE // 2).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dot = total(F.zip_with(left, right, lambda x, y: signed(x) * signed(y)))
    a, b = (total(F.transform(side, lambda x: signed(x) * signed(x))) for side in (left, right))
    return F.when(left == right, 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.sqrt(a * b))))


def fingerprint_sides(docs: DataFrame, keys: list[str], sides: dict[str, Column]) -> DataFrame:
    """Fingerprints one or more texts of each row; returns ``keys`` and, for each side, ``<side>_sums`` and ``<side>_lanes``.

    Rows with equal ``keys`` must have equal texts; they come back as often as they were given. The partial sums of a
    document are complete before the shuffle, so a very long text sends no more than a short one.
    """
    names = list(sides)
    flat = docs.select(*keys, F.posexplode(F.array(*sides.values())).alias("side", "body"))
    lines = flat.select(*keys, "side", F.posexplode_outer(paragraphs(F.col("body"))).alias("line", "part"))
    lines = lines.select(*keys, "side", F.coalesce("line", F.lit(0)).alias("line"), F.sha2("part", 256).alias("digest"), features(F.col("part")).alias("hashes"))
    parts = lines.select(*keys, "side", "line", "digest", F.posexplode_outer("hashes").alias("place", "h"))
    first = F.coalesce("place", F.lit(0)) == 0
    parts = parts.select(*keys, "side", (first & (F.col("line") == 0)).alias("head"), F.when(first, F.col("digest")).alias("digest"), "h")
    summed = parts.groupBy(*keys, "side").agg(F.sum(F.when(F.col("head"), 1).otherwise(0)).alias("copies"), *_lane_sums(F.col("digest"), F.col("h")))
    sums, lanes = _reduced(F.col("copies"))
    summed = summed.select(*keys, "side", "copies", F.struct(sums.alias("sums"), lanes.alias("lanes")).alias("print"))
    paired = summed.groupBy(*keys).agg(F.max("copies").alias("copies"), *[F.max(F.when(F.col("side") == i, F.col("print"))).alias(n) for i, n in enumerate(names)])
    paired = paired.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    return paired.select(*keys, *[F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in names for part in ("sums", "lanes")])


def with_next_id(ids: DataFrame, id_col: str) -> DataFrame:
    """Adds ``next_id``, the next larger id (after the last: the first), to a frame of distinct ids.

    Ids are range-partitioned and numbered by partition; only one row for each partition meets in a single task.
    """
    parts = materialise(ids.repartitionByRange(id_col).withColumn("part", F.spark_partition_id()), "next-ids")
    own = Window.partitionBy("part").orderBy(id_col)
    firsts = parts.groupBy("part").agg(F.min(id_col).alias("first"))
    over = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(over), F.min("first").over(Window.partitionBy())).alias("after"))
    return parts.withColumn("next_id", F.lead(id_col).over(own)).join(F.broadcast(firsts), "part").withColumn("next_id", F.coalesce("next_id", "after")).drop("part", "after")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text, its edited text and how near they are to each other and to the next document.

    The edited text has its last quarter of code points replaced by the head of the next document by ascending id.
    Null texts count as empty; a null id comes before all others; of rows with one id the next document's head is the
    smallest such head and its fingerprint the smallest such fingerprint; a single document is its own next one;
    repeated rows come back as often as given; further columns are ignored.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    needs = docs.groupBy(order.alias("id")).agg(F.max(quarter).alias("need"), F.count(F.lit(1)).alias("n_rows"))
    following = materialise(with_next_id(needs, "id"), "next-docs")
    heads = following.join(docs, F.col("next_id") == order).select("id", F.expr("substring(text, 1, need)").alias("head"))
    if following.where("n_rows > 1").limit(1).count():
        heads = heads.groupBy("id").agg(F.min("head").alias("head"))
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 4) as int)), substring(head, 1, cast(floor(length(text) / 4) as int)))")
    both = docs.join(heads, order == F.col("id")).withColumn("edited", edited)
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("text_key", F.sha2("text", 256))
    prints = materialise(
        fingerprint_sides(both, ["id", "doc_id", "n_chars", "text_key", "edited_sha256"], {"own": F.col("text"), "new": F.col("edited")}).select(
            "id", "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own_sums"), F.col("own_lanes")).alias("fingerprint"),
            fingerprint_text(F.col("new_sums"), F.col("new_lanes")).alias("edited_fingerprint"), "own_lanes", "new_lanes",
        ), "fingerprints",
    )
    after = prints.groupBy("id").agg(F.min(F.struct("fingerprint", "own_lanes")).alias("best"))
    after = following.select(F.col("id").alias("before"), "next_id").join(after, F.col("next_id") == F.col("id")).select("before", F.col("best.own_lanes").alias("next_lanes"))
    return prints.join(after, F.col("id") == F.col("before")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own_lanes"), F.col("new_lanes")).alias("near_edited"), likeness(F.col("own_lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
