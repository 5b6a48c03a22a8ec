"""Statistics of a group of transactions: gaps, amounts, categories, scores and the kind of recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import is_cadence_pair, is_monthly_pair, round_half_up, round_money
from ledgerloom.functions.text import context_shape, digits, installment


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def periodicity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``rows`` (keys, date): how monthly its distinct dates are.

    The score weighs monthly gaps by 0.7 and the day of the month by 0.3; a monthly gap with months left out counts
    0.75. The median day of an even number of dates is the upper one. Two dates score at most 0.62, or 0.2 when they
    are not a monthly pair; fewer score 0.
    """
    dates = rows.select(*keys, "date").distinct()
    gaps = dates.withColumn("previous", F.lag("date").over(Window.partitionBy(*keys).orderBy("date")))
    return _period_scored(gaps.groupBy(*keys).agg(*_period_counts(F.lit(True))), keys)


def _period_counts(counts: Column) -> list[Column]:
    """What ``periodicity`` adds up over rows with date and ``previous``, the date before; only rows with ``counts`` count."""
    monthly = is_monthly_pair(F.col("previous"), F.col("date"))
    skipped = ~monthly & is_cadence_pair(F.col("previous"), F.col("date"))
    return [
        F.count_if(counts).alias("n_dates"), F.count_if(counts & monthly).alias("monthly"), F.count_if(counts & skipped).alias("skipped"), F.array_sort(F.collect_list(F.when(counts, F.day("date")))).alias("days"),
        F.max("date").alias("last_date"), F.avg(F.when(counts, F.datediff("date", "previous"))).alias("average_gap"),
    ]


def _period_scored(grouped: DataFrame, keys: list[str], *more: str) -> DataFrame:
    gap_count = F.col("n_dates") - 1
    ratio = F.when(gap_count > 0, (F.col("monthly") + F.col("skipped") * 0.75) / gap_count).otherwise(0.0)
    median = F.element_at("days", (F.floor(F.size("days") / 2) + 1).cast("int"))
    spread = F.aggregate(F.transform("days", lambda d: F.abs(d - F.col("median_day")).cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size("days")
    grouped = grouped.withColumn("median_day", median).withColumn("ratio", ratio).withColumn("consistency", F.when(F.col("n_dates") >= 2, clamp01(1 - spread / 5)).otherwise(0.0))
    raw = F.col("ratio") * 0.7 + F.col("consistency") * 0.3
    score = F.when(F.col("n_dates") < 2, 0.0).when((F.col("n_dates") == 2) & (F.col("monthly") == 1), F.least(raw, F.lit(0.62))).when(F.col("n_dates") == 2, F.least(raw, F.lit(0.2))).otherwise(raw)
    scored = grouped.withColumn("score", clamp01(score))
    is_monthly = (F.col("score") >= 0.55) & (F.col("ratio") >= 0.5)
    return scored.select(
        *keys, "n_dates", "average_gap", "ratio", "consistency", "score", F.when(is_monthly, "monthly").otherwise("unknown").alias("frequency"),
        F.when(is_monthly, F.add_months("last_date", 1)).alias("next_date"), *more,
    )


def amount_stability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: average, bounds, variation in per cent, population deviation and a score of 1 to 0.1."""
    return _amounts_scored(rows.groupBy(*keys).agg(*_amount_sums()), keys)


def _amount_sums() -> list[Column]:
    a = F.abs("amount")
    return [F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean"), F.avg(a).alias("mean_abs"), F.min(a).alias("low"), F.max(a).alias("high"), F.stddev_pop(a).alias("deviation")]


def _amounts_scored(grouped: DataFrame, keys: list[str], *more: str) -> DataFrame:
    variation = F.when(F.col("mean_abs") == 0, 0.0).otherwise((F.col("high") - F.col("low")) / F.col("mean_abs") * 100)
    grouped = grouped.withColumn("variation_percent", variation)
    v = F.col("variation_percent")
    return grouped.select(
        *keys, "n", round_money(F.col("mean")).alias("average_amount"), round_money(F.col("low")).alias("min_amount"), round_money(F.col("high")).alias("max_amount"), "variation_percent",
        F.when(F.col("mean_abs") == 0, 0.0).otherwise(F.col("deviation") / F.col("mean_abs")).alias("coefficient"), F.when(v <= 5, "fixed").otherwise("variable").alias("recurrence_type"),
        F.when(v <= 5, 1.0).when(v <= 15, 0.8).when(v <= 30, 0.55).when(v <= 50, 0.35).otherwise(0.1).alias("amount_score"), *more,
    )


def category_consistency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent category of each group and its share of all rows; 0.5 without any. Ties: first by date and id."""
    each = rows.where(F.col("category_id").isNotNull()).groupBy(*keys, "category_id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("date", "id")).alias("first"))
    best = each.groupBy(*keys).agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "category_id")).alias("b"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return total.join(best, keys, "left").select(*keys, *_category_scored())


def _category_scored() -> list[Column]:
    return [F.coalesce(-F.col("b.k") / F.col("n"), F.lit(0.5)).alias("category_score"), F.col("b.category_id").alias("category_id")]


def series_facts(rows: DataFrame, keys: list[str], categories: bool = True) -> DataFrame:
    """``periodicity``, ``amount_stability`` and, with ``categories``, ``category_consistency`` side by side, from one shuffle of the
    rows by ``keys``: rows are read, and their keys computed, once. Where keys hold very many rows each, the three apart shuffle less."""
    own = Window.partitionBy(*keys)
    found = []
    if categories:
        of_category = Window.partitionBy(*keys, "category_id")
        rows = rows.withColumns({"_k": F.count(F.lit(1)).over(of_category), "_first": F.min(F.struct("date", "id")).over(of_category)})
        found = [F.min(F.when(F.col("category_id").isNotNull(), F.struct((-F.col("_k")).alias("k"), F.col("_first").alias("first"), "category_id"))).alias("b")]
    # Of the rows of one date the first stands for it; null is a date here, as it is for ``distinct``.
    ranked = rows.withColumns({"previous": F.lag("date").over(own.orderBy("date")), "_place": F.row_number().over(own.orderBy("date"))})
    first = (F.col("_place") == 1) | ~F.col("date").eqNullSafe(F.col("previous"))
    grouped = ranked.groupBy(*keys).agg(*_period_counts(first), *_amount_sums(), *found)
    periods = _period_scored(grouped, keys, "n", "mean", "mean_abs", "low", "high", "deviation", *(["b"] if categories else []))
    facts = ["n_dates", "average_gap", "ratio", "consistency", "score", "frequency", "next_date"]
    if not categories:
        return _amounts_scored(periods, keys, *facts)
    return _amounts_scored(periods, keys, *facts, "b").select("*", *_category_scored()).drop("b")


def occurrence_score(n: Column) -> Column:
    return F.when(n >= 4, 1.0).when(n == 3, 0.75).when(n == 2, 0.25).otherwise(0.0)


def legacy_score(period: Column, text: Column, amount: Column, category: Column, n: Column) -> Column:
    """30, 25, 20, 15 and 10 points; at most 59 when the period scores below 0.55."""
    raw = round_half_up(period * 30 + text * 25 + amount * 20 + category * 15 + occurrence_score(n) * 10)
    return F.when(period < 0.55, F.least(raw, F.lit(59))).otherwise(raw).cast("int")


def pattern_score(kind: Column, pattern: Column, identity: Column, amount: Column, category: Column, n: Column) -> Column:
    def weighed(p, i, a, c, o):
        return round_half_up(pattern * p + identity * i + amount * a + category * c + occurrence_score(n) * o)

    return F.when(kind.isin("monthly_fixed", "installment"), weighed(30, 30, 25, 5, 10)).when(kind.isin("monthly_variable", "recurring_income"), weighed(30, 35, 5, 5, 25)).otherwise(weighed(35, 35, 5, 5, 20)).cast("int")


def gap_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct dates of each group with the gap in days to the one before (null for the first)."""
    dates = rows.select(*keys, "date").distinct()
    return dates.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))))


def short_cadence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weekly (5 to 9 days) or biweekly (11 to 17) groups of four dates or more, at least 60 % of the gaps in rhythm."""
    within = lambda a, b: F.count_if(F.col("gap").between(a, b)) / F.count("gap")
    grouped = gap_rows(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates"), within(5, 9).alias("weekly"), within(11, 17).alias("biweekly"))
    best = F.greatest("weekly", "biweekly")
    return grouped.where((F.col("n_dates") >= 4) & (best >= 0.6)).select(
        *keys, "n_dates", F.when(F.col("weekly") >= F.col("biweekly"), "weekly").otherwise("biweekly").alias("frequency"), best.alias("gap_ratio"), clamp01(0.5 + best * 0.45).alias("score")
    )


def frequent_business(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of four dates in three months or more whose gaps keep to their median."""
    gaps = gap_rows(rows, keys)
    grouped = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates"), F.count_distinct(F.trunc("date", "MM")).alias("months"), F.median("gap").alias("median_gap"), F.collect_list("gap").alias("gaps"))
    m = F.col("median_gap")
    regular = F.size(F.filter("gaps", lambda g: (g >= m * 0.55) & (g <= m * 1.45))) / F.size("gaps")
    grouped = grouped.where((F.col("n_dates") >= 4) & (F.col("months") >= 3) & m.between(5, 60)).withColumn("gap_ratio", regular).where("gap_ratio >= 0.6")
    score = clamp01(0.48 + F.col("gap_ratio") * 0.35 + F.least(F.lit(0.12), F.col("n_dates") * 0.015))
    return grouped.select(*keys, "n_dates", "months", "median_gap", "gap_ratio", F.when(m <= 35, "frequent_supplier").otherwise("irregular_business_recurring").alias("kind"), score.alias("score"))


def installments(rows: DataFrame, keys: list[str], total: Column | None = None) -> DataFrame:
    """Groups in which every description has ``n/m`` and two rows or more share the most frequent total."""
    marked = rows.withColumn("total", installment(F.col("description"))["total"] if total is None else total)
    each = marked.groupBy(*keys, "total").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("date", "id")).alias("first"))
    best = each.where("total is not null").groupBy(*keys).agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "total")).alias("b"), F.sum("k").alias("marked"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return total.join(best, keys).where((F.col("marked") == F.col("n")) & (F.col("n") >= 2) & (-F.col("b.k") >= 2) & (F.col("b.total") > 0)).select(*keys, "n", F.col("b.total").alias("total"), F.lit(0.9).alias("score"))


def representative(rows: DataFrame, keys: list[str], text: str = "normalized_description") -> DataFrame:
    """The row that stands for a group: first by date and id of its most frequent text; ties go to the longer text."""
    each = rows.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("date", "id")).alias("first"))
    best = each.groupBy(*keys).agg(F.min(F.struct((-F.col("k")).alias("k"), (-F.length(text)).alias("shorter"), "first", text)).alias("b"))
    return best.select(*keys, F.col("b.first.id").alias("id"), F.col(f"b.{text}").alias(text))


def diversity(rows: DataFrame, keys: list[str], text: str = "normalized_description", shape: Column | None = None) -> DataFrame:
    """Distinct texts, and distinct shapes of the raw description, over rows."""
    share = lambda c: F.count_distinct(c) / F.count(F.lit(1))
    return rows.groupBy(*keys).agg(share(F.col(text)).alias("text_diversity"), share(context_shape(F.col("description")) if shape is None else shape).alias("context_diversity"))


def several_in_a_month(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.count(F.lit(1)) > F.count_distinct(F.trunc("date", "MM"))).alias("several_in_a_month"))


def stable_identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all rows of a group share one document, or one counterparty."""
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.count_distinct(c) == 1)
    return rows.groupBy(*keys).agg((one(digits(F.col("document_number"))) | one(F.col("normalized_counterparty"))).alias("stable"))


def cadence_track(rows: DataFrame, keys: list[str], days: int) -> DataFrame:
    """The largest set of rows that keep a rhythm of ``days`` (two days either way) with one of them; ties: first anchor.

    Rows keep a rhythm when their day numbers modulo ``days`` are near on the circle, so a group is judged by its histogram
    of ``days`` entries: the track is the best window of five of them around one that has rows.
    """
    residue = F.pmod(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(days))
    own = Window.partitionBy(*keys, "_residue")
    placed = rows.withColumn("_residue", residue).withColumns({"_k": F.count(F.lit(1)).over(own), "_first": F.min(F.struct("date", "id")).over(own)})
    # At most ``days`` entries a group.
    entry = F.when(F.col("_residue").isNotNull(), F.struct(F.col("_k").alias("k"), F.col("_first").alias("first"), F.col("_residue").alias("anchor")))
    placed = placed.withColumn("_all", F.collect_set(entry).over(Window.partitionBy(*keys)))
    apart = lambda a, b: F.least(F.pmod(a - b, F.lit(days)), F.pmod(b - a, F.lit(days)))
    size = lambda x: F.aggregate(F.filter("_all", lambda y: apart(x["anchor"], y["anchor"]) <= 2), F.lit(0).cast("long"), lambda n, y: n + y["k"])
    best = F.array_min(F.transform("_all", lambda x: F.struct((-size(x)).alias("k"), x["first"].alias("first"), x["anchor"].alias("anchor"))))
    return placed.withColumn("_best", best["anchor"]).where(apart(F.col("_residue"), F.col("_best")) <= 2).select(*rows.columns)
