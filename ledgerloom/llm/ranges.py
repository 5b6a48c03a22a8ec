"""Work along sorted ranges: running numbers and digests of groups of any size, of which no task ever holds a whole one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from .common import materialise

#: Bytes of a piece of what a group's digest is made of.
PIECE_BYTES = 1 << 20


def running(rows: DataFrame, group: str, order: list[str], sums: list[str], name: str) -> DataFrame:
    """Adds to each row ``place``, its number within its group from 1, and ``run_<c>``, the sum of each of ``sums`` (longs)
    up to and with the row, in the ``order`` given (nulls first).

    Rows are sorted in ranges of (group, order), so a large group lies in several ranges. Each range counts for itself;
    then the groups at the ends of ranges, two for a range at most, learn what came before. The result is a table on
    shared files. A null group is a group.
    """
    added = ["place", *[f"run_{c}" for c in sums]]
    schema = StructType(list(rows.schema.fields))
    for c in ["part", *added]:
        schema = schema.add(c, LongType())
    schema = schema.add("edge", "boolean")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, held = TaskContext.get().partitionId(), None, None, None
        for batch in (b for b in batches if b.num_rows):
            if held is not None:
                yield held
            groups = batch.column(group).to_pylist()
            heads = np.flatnonzero([True, *[a != b for a, b in zip(groups[1:], groups)]])
            run = np.zeros(len(groups), np.int64)
            run[heads[1:]] = 1
            run = np.cumsum(run)
            values = [np.ones(len(groups), np.int64), *[batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in sums]]
            totals = []
            for i, x in enumerate(values):
                total = np.cumsum(x)
                total = total - (total - x)[heads][run]
                if last is not None and groups[0] == last[0]:
                    total[run == 0] += last[1][i]
                totals.append(total)
            if last is None:
                first = (groups[0],)
            last = (groups[-1], [int(t[-1]) for t in totals])
            edge = np.array([(g,) == first for g in groups])
            held = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(groups), part)), *[pa.array(t) for t in totals], pa.array(edge)], schema.names)
        if held is not None:
            yield held

    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    counted = materialise(ranged.mapInArrow(count, schema), name)
    # The groups that go on: the last of each range. Both kinds are a row for each range.
    lasts = counted.groupBy("part").agg(F.max(F.struct(F.col(group).isNotNull().alias("known"), F.col(group).alias("group"), "place", *[F.col(c) for c in added[1:]])).alias("end"))
    over = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.where("edge").groupBy("part", F.col(group).alias("group")).agg(F.max(F.struct(*added)).alias("end"))
    named = [F.col(f"end.{c}").alias(c) for c in added]
    ends = firsts.select("part", "group", *named).unionByName(lasts.select("part", F.col("end.group").alias("group"), *named)).dropDuplicates(["part", "group"])
    before = ends.select(F.col("part").alias("_part"), F.col("group").alias("_group"), *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_{c}") for c in added])
    before = materialise(before.where("_place > 0"), name + "-before")
    joined = counted.join(F.broadcast(before), (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(*rows.columns, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in added])


def sha256_of_pieces(pieces: DataFrame, keys: list[str], order: list[str], piece: str, between: bytes) -> DataFrame:
    """``keys`` and ``sha256`` of each group's binary pieces in ``order``, with ``between`` between them.

    The hash of one group is a chain, so its pieces come to one task; it reads them one after the other and holds one.
    """

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            owners, digests = [], []
            for i in range(batch.num_rows):
                key = tuple(c[i].as_py() for c in columns)
                if sha is None or key != now:
                    if sha is not None:
                        owners.append(now)
                        digests.append(sha.hexdigest())
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(between)
                sha.update(batch.column(piece)[i].as_py())
            if owners:
                yield record(owners, digests)
        if sha is not None:
            yield record([now], [sha.hexdigest()])

    types = StructType([f for f in pieces.select(*keys).schema.fields]).add("sha256", "string")
    record = lambda owners, digests: pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.int64() if isinstance(t.dataType, LongType) else None) for c, t in zip(zip(*owners), types.fields)], pa.array(digests)], types.names)
    # Batches end by their number of rows: pieces of some size go in few rows.
    return pieces.select(*keys, *order, piece).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(chain, types)


def sha256_of_lists(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys`` (longs) and ``sha256`` of each group's ``value`` (longs) as decimals, ascending, joined by commas.

    Rows are sorted in ranges; a group within one range is done there, and of others each range makes pieces.
    """
    schema = StructType([f for f in rows.select(*keys).schema.fields]).add("part", "integer").add("number", "integer").add("alone", "string").add("piece", "binary")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, size, number, first, out = TaskContext.get().partitionId(), None, [], 0, 0, True, []

        def made() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([*[pa.array([r[0][i] for r in out], pa.int64()) for i in range(len(keys))], *[pa.array([r[i] for r in out], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.binary()))]], schema.names)
            out.clear()

        def end(whole: bool) -> None:
            text = ",".join(map(str, held)).encode()
            out.append((now, part, number, hashlib.sha256(text).hexdigest(), None) if whole else (now, part, number, None, text))

        for batch in batches:
            for *key, x in zip(*[batch.column(k).to_pylist() for k in (*keys, value)], strict=True):
                key = tuple(key)
                if key != now:
                    if now is not None:
                        end(not first and not number)
                        first = False
                    now, held, size, number = key, [], 0, 0
                elif size >= PIECE_BYTES // 16:
                    end(False)
                    held, size, number = [], 0, number + 1
                held.append(x)
                size += 1
            if len(out) > 2000:
                yield from made()
        if now is not None:
            end(False)
        yield from made()

    ranged = rows.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    read_rows = materialise(ranged.mapInArrow(read, schema), name)
    whole = read_rows.where("alone is not null").select(*keys, F.col("alone").alias("sha256"))
    return whole.unionByName(sha256_of_pieces(read_rows.where("alone is null"), keys, ["part", "number"], "piece", b","))
