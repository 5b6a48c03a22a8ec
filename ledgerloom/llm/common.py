"""What the corpus operators share: scratch tables, null handling and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import materialise, scratch_path

__all__ = ["lookup_join", "materialise", "scratch_path", "text_of"]

#: A key counts as hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000


def text_of(column: str = "text"):
    """The text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lookup_join(rows: DataFrame, entries: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """Joins ``rows`` to ``entries``, which has one row per ``key`` and in ``size`` the number of ``rows`` with that key.

    Keys with more than ``HOT_SHARE`` of the rows are broadcast: there are at most ``1 / HOT_SHARE`` of them, whatever
    the size of the data. All other keys go through a shuffle join, in which no key is hot.
    """
    keys = [key] if isinstance(key, str) else key
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    floor = max(1, int(total * HOT_SHARE))
    hot, cold = entries.where(F.col(size) > floor), entries.where(F.col(size) <= floor)
    names = [c for c in entries.columns if c not in keys]
    tagged = rows.join(F.broadcast(hot.select(*keys, F.struct(*names).alias("_hot"))), keys, "left")
    first = tagged.where(F.col("_hot").isNotNull()).select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in names))
    rest = tagged.where(F.col("_hot").isNull()).drop("_hot").join(cold, keys, how).select(*rows.columns, *names)
    return first.unionByName(rest)
