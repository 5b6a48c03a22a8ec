"""N-gram Jaccard join: a T-occurrence search over inverted lists, in the manner of DivideSkip.

Of each document's shingles, a prefix in one order of all shingles, rare before frequent, is posted to inverted lists; a
partner shares at least one of them. Documents of like lists meet in blocks of bounded size. There a document's short
lists are merged and counted, the long ones are probed by binary search, and those that reach the required overlap link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.components import connected_components

from .common import HOT_SHARE, lookup_join, materialise, text_of
from .occurrence import BlockIndex
from .shingles import mixed, shingle_sets

SHINGLE_WORDS = 4
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Cells of the count sketch that finds frequent shingles, and the slices in which it is added up.
SKETCH_BITS, SLICES = 18, 64
#: Bits of the bitmap that tells which documents may have candidates: 4 MB, whatever the size of the data.
BITMAP_BITS = 25
#: Rows of a list that are counted exactly; longer lists are all ordered as equally long.
LONG_LIST = 65_536
#: A block holds so many documents of up to ``UNIT`` shingles, or fewer longer ones.
BLOCK_DOCS, UNIT = 2_000, 1_000
#: Order of shingles out of the counted slice, and of those in frequent cells: after all counted ones.
UNCOUNTED, FREQUENT = 1 << 40, 1 << 41
NO_ID = -(1 << 63)


def short_list_count(n: int, percent: int = PERCENT) -> int:
    """How many of ``n`` lists have to be looked at so that no partner is missed."""
    return n - (-(-percent * n // 100)) + 1 if n else 0


def counted_share(percent: int) -> int:
    """Of 1024 parts of all shingles, those whose lists are counted: 5/3 of what a document has to post at least."""
    return min(1024, -(-5 * (100 - percent) * 1024 // 300))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_key(found: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(_signed(mixed(found, seed).sum(dtype=np.uint64, keepdims=True))[0])


def _cells(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], size: int):
    for batch in batches:
        raws = (text.as_buffer().to_pybytes() if text.as_buffer() else b"" for text in batch.column("text"))
        yield from zip(batch.column("did").to_pylist(), shingle_sets(raws, size))


def _sizes_and_sketch(size: int):
    schema = pa.schema([("did", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, rows, waiting, held = np.zeros(1 << SKETCH_BITS, np.int64), [], [], 0

        def flush():
            did, n, key, key2 = map(list, zip(*rows))
            nulls = [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (did, n, key, key2)), *nulls], schema=schema)

        for did, found in _each(batches, size):
            rows.append((did, len(found), _class_key(found, 1), _class_key(found, 2)))
            waiting.append(_cells(found))
            held += len(found)
            if held > 500_000:
                sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
                waiting, held = [], 0
            if len(rows) == 4096:
                yield flush()
                rows.clear()
        if held:
            sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
        if rows:
            yield flush()
        if sketch.any():
            parts = [x.astype("<i8").tobytes() for x in np.split(sketch, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            new = np.frombuffer(counts, "<i8")
            total[part] = total[part] + new if part in total else new
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])


def frequency_levels(sketches: DataFrame) -> np.ndarray:
    """The level of each cell of the summed sketch: 0 up to four times the mean count, one more for each doubling.

    Cells only order shingles and split the lists of frequent ones; any collision costs time and never a result. The
    sketch has ``2 ** SKETCH_BITS`` cells for any amount of data, so it is safe to bring to the driver and to send to tasks.
    """
    slices = sketches.repartition(SLICES // 8, "slice").mapInArrow(_added_up, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for r in slices:
        counts[r.slice] += np.frombuffer(r.counts, "<i8")
    counts = counts.ravel()
    return np.floor(np.log2(np.maximum(1.0, counts / (4 * max(1.0, counts.mean()))))).astype(np.uint8)


def _in_slice(tokens: np.ndarray, share: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) & np.uint64(1023)) < np.uint64(share)


def _postings(size: int, percent: int, levels, hot: dict[int, int]):
    """Posts all of a document's shingles of the counted slice and, where these are too few, further ones, rare cells
    first. ``meta`` holds the size of the set and the number of postings; ``salt`` splits the lists of frequent shingles."""
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("meta", pa.int64()), ("salt", pa.int32())])
    share = counted_share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, tokens, rows, held = levels.value, [], [], 0

        def flush():
            counts = np.array([r[2] for r in rows])
            posted = np.concatenate(tokens)
            ids, metas = (np.repeat(np.array(x, np.int64), counts) for x in ([r[0] for r in rows], [r[1] for r in rows]))
            heights = level[_cells(posted)].astype(np.int64)
            salt = np.where(heights > 0, 1 + (mixed(ids.view(np.uint64), 5) % (np.uint64(2) << np.minimum(heights, 20).astype(np.uint64))).astype(np.int64), 0)
            return pa.RecordBatch.from_arrays([pa.array(_signed(posted)), pa.array(ids), pa.array(metas), pa.array(salt.astype(np.int32))], schema=schema)

        for did, found in _each(batches, size):
            if not len(found):
                continue
            key = _class_key(found, 1)
            if hot.get(key, did) != did:
                continue
            own, need = level[_cells(found)], short_list_count(len(found), percent)
            counted = _in_slice(found, share) & (own == 0)
            chosen = found[counted]
            if len(chosen) < need:
                rest, heights = found[~counted], own[~counted]
                chosen = np.concatenate([chosen, rest[np.argsort(heights, kind="stable")[: need - len(chosen)]]])
            tokens.append(chosen)
            rows.append((key, len(found) << 32 | len(chosen), len(chosen)))
            held += len(chosen)
            if held > 200_000:
                yield flush()
                tokens, rows, held = [], [], 0
        if rows:
            yield flush()

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str, most: int):
    """Rows of sorted input in portions of whole runs of equal ``key``, as numpy columns; runs over ``most`` rows come in
    parts. Gives (columns, which rows belong to a run over ``most`` rows)."""
    rest, long_key = None, None
    for batch in chain(batches, [None]):
        table = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names} if batch is not None else None
        if rest is not None:
            table = {k: np.concatenate([rest[k], v]) for k, v in table.items()} if table is not None else rest
        if table is None or not len(table[key]):
            continue
        keys = table[key]
        last = int(np.searchsorted(keys, keys[-1])) if batch is not None else len(keys)
        if batch is not None and len(keys) - last > most:
            long_key, last = keys[-1], len(keys)
        rest = {k: v[last:] for k, v in table.items()} if last < len(keys) else None
        if last:
            done = {k: v[:last] for k, v in table.items()}
            _, place, sizes = np.unique(done[key], return_inverse=True, return_counts=True)
            yield done, (sizes[place] > most) | (done[key] == long_key if long_key is not None else False)


def _shared(percent: int, levels):
    """From postings sorted by (token, id): those of lists with two members or more, with their place in the order."""
    share = counted_share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, last = levels.value, (None, None)
        for table, long_run in _runs(batches, "token", LONG_LIST):
            token, ids, meta = table["token"], table["id"], table["meta"]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
            new[0] = last != (token[0], ids[0])
            last = (token[-1], ids[-1])
            token, ids, meta, long_run = token[new], ids[new], meta[new], long_run[new]
            if not len(token):
                continue
            _, place, sizes = np.unique(token, return_inverse=True, return_counts=True)
            heights = level[_cells(token.view(np.uint64))].astype(np.int64)
            order = np.where(long_run, LONG_LIST, sizes[place])
            order = np.where(_in_slice(token.view(np.uint64), share), order, UNCOUNTED)
            order = np.where(heights > 0, FREQUENT + heights, order)
            keep = (sizes[place] > 1) | long_run | (heights > 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, meta, token, order)], names=["id", "meta", "token", "place"])

    return run


def _prefixes(docs: DataFrame, size: int, percent: int, levels, hot: dict[int, int]) -> DataFrame:
    """id, n, tokens: the shared shingles in the prefix of each document that has any.

    A prefix is the first ``short_list_count`` shingles of a document in the order of (place, token). Shingles that no
    other document posts come before all others, so a document with enough of those has no partner.
    """
    posted = docs.mapInArrow(_postings(size, percent, levels, hot), "token long, id long, meta long, salt int")
    lists = posted.repartition("token", "salt").sortWithinPartitions("token", "id")
    shared = lists.mapInArrow(_shared(percent, levels), "id long, meta long, token long, place long")
    grouped = shared.groupBy("id", "meta").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("found"))
    n, posts = F.shiftright("meta", 32), F.col("meta").bitwiseAND((1 << 32) - 1)
    need = n - F.ceil(percent * n / 100) + 1
    kept = grouped.select("id", n.alias("n"), "found", (need - posts + F.size("found")).cast("int").alias("room")).where("room > 0")
    return materialise(kept.select("id", "n", F.expr("slice(found, 1, room).token").alias("tokens")), "ngram-prefixes")


def _placed(prefixes: DataFrame) -> DataFrame:
    """id, n, tokens, block0, block1: documents with like lists in the same block.

    A document belongs to the longest of its lists. Small groups share blocks, large ones are dealt over blocks by a hash
    of the id, anew in ``block1``; ``block1`` is null where a group has one block.
    """
    rows = prefixes.select("id", "n", F.explode("tokens").alias("token"))
    sizes = materialise(rows.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "ngram-list-sizes")
    rows = lookup_join(rows, sizes, "token", "size")
    units = F.greatest(F.lit(1.0), F.col("n") / UNIT)
    docs = rows.groupBy("id", "n").agg(F.max(F.struct("size", "token")).getField("token").alias("leader"), F.collect_list("token").alias("tokens"))
    docs = materialise(docs.withColumn("units", units), "ngram-leaders")
    groups = materialise(docs.groupBy("leader").agg(F.sum("units").alias("weight"), F.count(F.lit(1)).alias("members")), "ngram-groups")
    bins = max(1, int((groups.agg(F.sum("weight")).first()[0] or 0) * 2 // BLOCK_DOCS))
    parts = F.ceil(F.col("weight") / BLOCK_DOCS)
    dealt = lambda turn: F.xxhash64("leader", F.pmod(F.xxhash64("id", F.lit(turn)), parts), F.lit(turn))
    known = lookup_join(docs, groups, "leader", "members")
    return known.select(
        "id", "n", "tokens",
        F.when(parts > 1, dealt(0)).otherwise(F.pmod(F.xxhash64("leader"), F.lit(bins))).alias("block0"),
        F.when(parts > 1, dealt(1)).alias("block1"),
    )


def _slot(did: int) -> int:
    return (did * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - BITMAP_BITS)


def _bitmap(dids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, ``2 ** BITMAP_BITS`` bits for any number of ids; a shared bit lets one more text through."""
    page_bits = BITMAP_BITS - 6

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for did in batch.column("did").to_pylist():
                slot = _slot(did)
                held.setdefault(slot >> page_bits, np.zeros(1 << page_bits, bool))[slot & ((1 << page_bits) - 1)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["page", "bits"])

    found = np.zeros((64, 1 << page_bits), bool)
    for r in dids.coalesce(8).mapInArrow(pages, "page int, bits binary").toLocalIterator():
        found[r.page] |= np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return np.packbits(found.ravel())


def _sets_of(bitmap, size: int):
    """The shingle sets of the documents whose bit is set."""
    schema = pa.schema([("did", pa.int64()), ("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            with np.errstate(over="ignore"):
                slots = (batch.column("did").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)
            yes = (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slots & np.uint64(7)).astype(np.uint8))) & 1
            part = batch.filter(pa.array(yes.astype(bool)))
            for start in range(0, part.num_rows, 1000):
                found = list(_each(iter([part.slice(start, 1000)]), size))
                columns = [d for d, _ in found], [_class_key(s, 1) for _, s in found], [s.tobytes() for _, s in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


_SEARCH = "left long, right long"


def _searched(percent: int):
    """From rows (block, visiting, id, component, shingles) sorted by (block, visiting, id): links between documents of
    different components that join the components. Documents of the block are all compared with each other, visiting
    ones with those of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, here = None, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("block", "visiting", "id", "component"))
            for block, visiting, id_, component, shingles in zip(*columns, batch.column("shingles")):
                if block != here:
                    links += index.inner_links() if index else []
                    index = None  # let it go before the next one grows
                    index, here = BlockIndex(percent), block
                found = np.frombuffer(shingles.as_buffer() or b"", np.uint64)
                if visiting:
                    links += index.visit(id_, component, found)
                else:
                    index.add(id_, component, found)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["left", "right"])
        links = index.inner_links() if index else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["left", "right"])

    return run


def _block_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """left, right: links found in blocks. ``rows``: block, visiting, id, component; their sets are made from the texts,
    which only those documents send whose bit is set."""
    spark = docs.sparkSession
    wanted = materialise(rows.join(classes.select(F.col("key").alias("id"), F.col("rep").alias("did")), "id"), "ngram-wanted")
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted.select("did").distinct()))
    sets = docs.mapInArrow(_sets_of(bitmap, size), "did long, id long, shingles binary").join(wanted, ["id", "did"])
    blocks = sets.select("block", "visiting", "id", "component", "shingles").repartition("block").sortWithinPartitions("block", "visiting", "id")
    return materialise(blocks.mapInArrow(_searched(percent), _SEARCH), "ngram-links")


def _visits(placed: DataFrame, components: DataFrame) -> DataFrame:
    """block, visiting, id, component: which documents have to be compared with which of other blocks.

    In a list whose documents are of different components, those that are not of its most frequent component visit the
    blocks of the others. Of two such documents the one in the smaller block visits. Of a visited block, only documents
    of these lists take part.
    """
    known = placed.select("id", "block0", "tokens").join(components, "id").select("id", "component", F.col("block0").alias("block"), F.explode("tokens").alias("token"))
    known = materialise(known, "ngram-known")
    parts = known.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    major = parts.groupBy("token").agg(F.sum("size").alias("members"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("size", "component")).getField("component").alias("major"))
    major = materialise(major.where("kinds > 1").select("token", "members", "major"), "ngram-open")
    rows = materialise(lookup_join(known, major, "token", "members").drop("members"), "ngram-open-rows")
    targets = rows.groupBy("token", F.col("block").alias("target")).agg(F.max(F.col("component") == F.col("major")).alias("has_major"))
    probes = rows.where("component != major").select("token", "id", "component", "block")
    met = materialise(probes.join(targets, "token").where("target != block and (has_major or target > block)").select("token", "id", "component", F.col("target").alias("block")), "ngram-met")
    guests = met.select("block", F.lit(True).alias("visiting"), "id", "component").distinct()
    homes = rows.join(met.select("token", "block").distinct(), ["token", "block"], "left_semi").select("block", F.lit(False).alias("visiting"), "id", "component").distinct()
    return materialise(homes.unionByName(guests), "ngram-visits")


def _components_of(ids: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links, "left", "right").withColumnRenamed("node", "id")
    return materialise(ids.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "ngram-components")


def ngram_links(docs: DataFrame, classes: DataFrame, levels, hot: dict[int, int], size: int, percent: int) -> DataFrame:
    """left, right: links between classes of documents that make the same components as all links together."""
    placed = materialise(_placed(_prefixes(docs, size, percent, levels, hot)), "ngram-placed")
    ids, at_home = placed.select("id"), F.lit(False).alias("visiting")
    links = _block_links(docs, classes, placed.select(F.col("block0").alias("block"), at_home, "id", F.col("id").alias("component")), size, percent)
    components = _components_of(ids, links)
    again = placed.where("block1 is not null")
    if again.limit(1).count():
        second = again.join(components, "id").select(F.col("block1").alias("block"), at_home, "id", "component")
        links = links.unionByName(_block_links(docs, classes, second, size, percent))
        components = _components_of(ids, links)
    visits = _visits(placed, components)
    if not visits.limit(1).count():
        return links
    return links.unionByName(_block_links(docs, classes, visits, size, percent))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents with equal shingle sets form a class and are compared once. Each class is compared with all classes of
    its block, and with those classes of other blocks that share a posted shingle and are of another component: no link
    between components is lost, and members of one component are not compared again.

    ``component_id`` is the smallest id reachable by links. A null or empty text has no shingles and is linked with
    nothing. Repeated rows belong to one class. A row without an id takes part and has the component of its class; it
    is null when no row of the component has an id. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), text_of(text_col).alias("text"))
    counted = materialise(docs.mapInArrow(_sizes_and_sketch(size), "did long, n long, key long, key2 long, slice int, counts binary"), "ngram-sizes")
    rows = counted.where("slice is null").select("did", "n", "key", "key2")
    real = F.when(F.col("did") != NO_ID, F.col("did"))
    classes = rows.where("n > 0").groupBy("key", "key2", "n").agg(F.min("did").alias("rep"), F.min(real).alias("smallest"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "ngram-classes")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = {r.key: r.rep for r in classes.where(F.col("copies") > max(1, int(total * HOT_SHARE))).select("key", "rep").collect()}
    levels = spark.sparkContext.broadcast(frequency_levels(counted.where("slice is not null").select("slice", "counts")))
    final = connected_components(ngram_links(docs, classes, levels, hot, size, percent), "left", "right")

    named = classes.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = materialise(lookup_join(named.select("key", "component", "copies"), materialise(smallest, "ngram-smallest"), "component", "members").select("key", "component_id", "copies"), "ngram-named")
    linked = lookup_join(rows.where("n > 0").select("did", "n", "key"), named, "key", "copies").select("did", "n", "component_id")
    alone = rows.where("n = 0").select("did", "n", real.alias("component_id"))
    return linked.unionByName(alone).select(real.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Columns as given.

    Rows without shingles and rows of a component without any id all stay; of repeated rows with that id, one stays.
    """
    found = ngram_jaccard_join(docs, id_col, text_col, size, percent)
    alone = F.col("component_id").isNull() | (F.col("n_shingles") == 0)
    drop = found.where(~alone & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("dropped")).distinct()
    given = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), text_of(text_col).alias("body"))
    left = given.join(drop, F.col("did") == F.col("dropped"), "left_anti")
    repeated = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice"))
    if repeated.limit(1).count():
        again = left.join(repeated, F.col("did") == F.col("twice"), "left_semi").dropDuplicates(["did", "body"])
        left = left.join(repeated, F.col("did") == F.col("twice"), "left_anti").unionByName(again)
    return left.select("row.*")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
