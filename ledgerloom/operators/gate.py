"""Acceptance gates: named invariants over tables, each measured as it is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@dataclass(frozen=True)
class Invariant:
    """``measure`` is an aggregate over the rows of one table; ``holds`` judges it; ``wanted`` says what was asked."""

    name: str
    measure: Column
    wanted: str
    holds: Callable[[int | float | None], bool]


def at_most(name: str, measure: Column, most: float) -> Invariant:
    return Invariant(name, measure, f"at most {most:g}", lambda x: (x or 0) <= most)


def exactly(name: str, measure: Column, n: float) -> Invariant:
    return Invariant(name, measure, f"exactly {n:g}", lambda x: (x or 0) == n)


def measured(rows: DataFrame, invariants: list[Invariant]) -> dict[str, int | float | None]:
    """All measures of one table in one pass, as metrics of the job that reads it."""
    watch = Observation()
    rows.observe(watch, *[i.measure.alias(f"m{k}") for k, i in enumerate(invariants)]).write.format("noop").mode("overwrite").save()
    found = watch.get
    return {i.name: found[f"m{k}"] for k, i in enumerate(invariants)}


def gate(spark: SparkSession, checks: list[tuple[DataFrame, list[Invariant]]]) -> DataFrame:
    """A row for each invariant: name, wanted, actual and whether it holds. Only one number of each reaches the driver."""
    out = []
    for rows, invariants in checks:
        actual = measured(rows, invariants)
        out += [(i.name, i.wanted, None if actual[i.name] is None else float(actual[i.name]), bool(i.holds(actual[i.name]))) for i in invariants]
    return spark.createDataFrame(out, "name string, wanted string, actual double, holds boolean")


def must_hold(found: DataFrame) -> None:
    """Raises an error that names the invariants that do not hold."""
    failed = [f"{r.name}={r.actual:g}, {r.wanted}" for r in found.where("not holds").collect()]
    if failed:
        raise ValueError("acceptance gate failed: " + "; ".join(failed))
