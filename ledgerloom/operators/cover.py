"""Greedy set cover over overlapping keys, in rounds of keys that nothing can overtake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.plans.scratch import materialise

from .audit import UNCATEGORISED, dominant_categories, rule_keys

#: Order of rule types among keys of equal gain, purity and value: fixed values.
RULE_ORDER = {"document_equals": 0, "counterparty_contains": 1, "description_contains": 2, "counterparty_and_amount_range": 3}


def mined_covers(rows: DataFrame) -> DataFrame:
    """(rule_type, value, purity, id): the rows that each mined key, of four types, would put into its dominant category.
    ``rows`` as for ``audit.mine_rules``, with id."""
    best = dominant_categories(rows)
    each = rule_keys(rows, "id")
    return each.join(best.select("rule_type", "value", F.col("b.category_id").alias("category_id"), (F.col("b.n") / F.col("all")).alias("purity")), ["rule_type", "value", "category_id"]).select("rule_type", "value", "purity", "id").distinct()


def greedy_picks(covers: DataFrame) -> DataFrame:
    """All picks of the greedy cover: (rule_type, value, purity, gain). ``covers``: (rule_type, value, purity, id).

    The greedy cover takes the key that adds most rows, then the purest, then the first by value and type. A key that comes
    before all keys with which it shares an open row is taken before any of them, with the rows that it adds now: what they
    add only falls. So each round takes all such keys at once, leaves their rows out, and writes what is left to a scratch
    table; the picks, sorted, are those of one key a step. A row meets the few keys that it has, never other rows.
    """
    kind = F.create_map(*[F.lit(x) for pair in RULE_ORDER.items() for x in pair])
    left = materialise(covers.select("id", F.struct((-F.col("purity")).alias("impure"), "value", F.coalesce(F.try_element_at(kind, F.col("rule_type")), F.lit(9)).alias("kind"), "rule_type").alias("key")).distinct(), "cover-open")
    picks = None
    while left.limit(1).count():
        gains = left.groupBy("key").agg(F.count(F.lit(1)).alias("gain"))
        first = left.join(gains, "key").groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("order"), "key")).alias("first"))
        won = first.groupBy("first").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") == -F.col("first.order"))
        taken = materialise(won.select("first.key", F.col("rows").alias("gain")), "cover-taken")
        gone = left.join(taken.select("key"), "key", "left_semi").select("id").distinct()
        left = materialise(left.join(gone, "id", "left_anti"), "cover-open")
        picks = taken if picks is None else picks.unionByName(taken)
    if picks is None:
        return covers.select("rule_type", "value", "purity", F.lit(0).cast("long").alias("gain")).limit(0)
    return picks.select("key.rule_type", "key.value", (-F.col("key.impure")).alias("purity"), "gain")


def rule_cover(covers: DataFrame, targets: int, goal: float = 0.8) -> DataFrame:
    """The picks of the greedy cover, in order, until ``goal`` of ``targets`` rows are covered: (step, rule_type, value,
    purity, gain, covered). Steps and sums run over sorted ranges of picks."""
    kind = F.create_map(*[F.lit(x) for pair in RULE_ORDER.items() for x in pair])
    picks = greedy_picks(covers).withColumn("kind", F.coalesce(F.try_element_at(kind, F.col("rule_type")), F.lit(9)))
    order = [F.desc("gain"), F.desc("purity"), F.asc("value"), F.asc("kind")]
    ranged = materialise(picks.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "cover-picks")
    sums = ranged.groupBy("part").agg(F.sum("gain").alias("own"), F.count(F.lit(1)).alias("own_steps"))  # a row for each range
    over = Window.orderBy("part")
    sums = sums.select("part", (F.sum("own").over(over) - F.col("own")).alias("before"), (F.sum("own_steps").over(over) - F.col("own_steps")).alias("steps"))
    within = Window.partitionBy("part").orderBy(*order)
    placed = ranged.withColumns({"sum": F.sum("gain").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.row_number().over(within)}).join(F.broadcast(sums), "part")
    whole = placed.select((F.col("steps") + F.col("n")).alias("step"), "rule_type", "value", "purity", "gain", (F.col("before") + F.col("sum")).alias("covered"))
    return whole.where(F.col("covered") - F.col("gain") < F.ceil(F.lit(targets * goal)))


def uncategorised(rows: DataFrame) -> DataFrame:
    """Rows that a rule may be mined for."""
    return rows.where((F.col("category_id") != "") & (F.col("category_id") != UNCATEGORISED))
