"""Cash-flow projection of approved recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZONS = (30, 60, 90)


def next_date(date: Column, frequency: Column) -> Column:
    """One step of a frequency; null for one that is not known. Months keep the day of the date before, clamped."""
    return (
        F.when(frequency == "weekly", F.date_add(date, 7)).when(frequency == "biweekly", F.date_add(date, 14))
        .when(frequency == "monthly", F.add_months(date, 1)).when(frequency == "yearly", F.add_months(date, 12))
    )


def _skip(date: Column, today: Column, frequency: Column) -> tuple[Column, Column]:
    """(first date not before today, steps taken). Weeks are counted; months are walked, since each step clamps the day."""
    days = F.when(frequency == "weekly", 7).when(frequency == "biweekly", 14)
    weeks = F.greatest(F.lit(0), F.ceil(F.datediff(today, date) / days).cast("int"))
    months = F.when(frequency == "yearly", 12).otherwise(1)
    upper = F.greatest(F.lit(0), F.floor(F.months_between(today, date) / months).cast("int") + 2)
    start = F.struct(date.alias("d"), F.lit(0).alias("n"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.greatest(upper, F.lit(1))), start,
        lambda a, _: F.when(a["d"] < today, F.struct(F.add_months(a["d"], months).alias("d"), (a["n"] + 1).alias("n"))).otherwise(a),
    )
    known = frequency.isin("monthly", "yearly")
    first = F.when(days.isNotNull(), F.date_add(date, (weeks * days).cast("int"))).when(known, walked["d"]).when(date >= today, date)
    return first, F.when(days.isNotNull(), weeks).when(known, walked["n"]).otherwise(0)


def projection_dates(recurrences: DataFrame, as_of: Column, horizons=HORIZONS) -> DataFrame:
    """One row per recurrence, horizon and projected date.

    ``recurrences``: company_id, recurrence_id, status, frequency, next_date, start_date, end_date, installment_count,
    observed. Only active ones count. A series rolls forward to ``as_of``; if that takes as many steps as instalments
    are left, nothing is projected, but the steps do not use instalments up. An unknown frequency gives one date at most.
    As many steps are made as the shortest frequency takes to pass the longest horizon.
    """
    today, horizon = as_of.cast("date"), F.col("horizon_days")
    active = recurrences.where("status = 'active'").withColumn("first", F.coalesce("next_date", "start_date"))
    left = F.when(F.col("installment_count").isNotNull(), F.greatest(F.col("installment_count") - F.col("observed"), F.lit(0)))
    first, taken = _skip(F.col("first"), today, F.col("frequency"))
    ready = active.withColumn("remaining", left).withColumn("cursor", first).withColumn("taken", taken)
    ready = ready.where(F.col("cursor").isNotNull() & ~F.coalesce((F.col("taken") > 0) & (F.col("taken") >= F.col("remaining")), F.lit(False)))
    steps = F.aggregate(
        F.sequence(F.lit(2), F.lit(max(horizons) // 7 + 3)), F.array("cursor"),
        lambda a, _: F.when(next_date(F.element_at(a, -1), F.col("frequency")).isNotNull(), F.concat(a, F.array(next_date(F.element_at(a, -1), F.col("frequency"))))).otherwise(a),
    )
    each = ready.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons)))).select("*", F.posexplode(steps).alias("place", "date"))
    within = (F.col("date") <= F.date_add(today, horizon)) & F.coalesce(F.col("date") <= F.col("end_date"), F.lit(True)) & F.coalesce(F.col("place") < F.col("remaining"), F.lit(True))
    return each.where(within).select("company_id", "recurrence_id", "horizon_days", "date")


def projected_items(recurrences: DataFrame, as_of: Column, horizons=HORIZONS) -> DataFrame:
    """Projected items with amount, type and description of their recurrence."""
    facts = recurrences.select("company_id", "recurrence_id", "amount", "type", "description")
    return projection_dates(recurrences, as_of, horizons).join(facts, ["company_id", "recurrence_id"])


#: Fixed value: the name of the scenario that every company has.
BASE_SCENARIO = "Base"


def ensured_scenarios(companies: DataFrame, scenarios: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenarios with a base one for each company of ``wanted``, company_id and error of those that do not exist).

    ``companies``: id; ``scenarios``: company_id, name and further columns, one for a company; ``wanted``: company_id. A
    scenario that is there takes the base name and keeps all else; asking again changes nothing.
    """
    asked = wanted.select("company_id").where("company_id is not null").distinct()
    known = asked.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    kept = scenarios.join(known.withColumn("_asked", F.lit(True)), "company_id", "left").withColumn("name", F.when(F.col("_asked"), BASE_SCENARIO).otherwise(F.col("name"))).select(*scenarios.columns)
    made = known.join(scenarios.select("company_id"), "company_id", "left_anti")
    made = made.select(*[F.col("company_id") if c == "company_id" else F.lit(BASE_SCENARIO).alias(c) if c == "name" else F.lit(None).cast(t).alias(c) for c, t in scenarios.dtypes])
    unknown = asked.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_anti").withColumn("error", F.lit("unknown_company"))
    return kept.unionByName(made), unknown
