"""Rows of a company are shuffled once, before they are spread; texts are normalised once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.operators import recurrence as R
from ledgerloom.plans import catalog, queries_audit, queries_series
from ledgerloom.plans.sample_ledger import ledger

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tokens_are_counted_without_normalising_twice(spark):
    found = plan(catalog.queries()["distinctive_tokens"](spark, SF))
    assert found.count("transform(") and "size(" not in found


def test_identity_groups_meet_in_place(spark):
    def pruned(of):
        return exchanges(R.by_company(ledger(spark, SF), of))

    assert pruned(queries_series._candidates) == 1
    assert pruned(queries_audit._sizes) == 1
    assert pruned(lambda rows: A.shared_rows(A.suggestion_classes(queries_audit._links(rows), ["company_id"]), ["company_id"])) == 1


def test_tracks_meet_in_place(spark):
    tracks = R.income_track_rows(queries_series.rows_of(spark, SF))
    assert exchanges(tracks) <= 2  # both sides of the one join, which may be one shuffle


@pytest.mark.parametrize("name", ["identity_candidates", "pending_integrity", "overlap_pairs", "income_tracks"])
def test_large_companies_give_the_same(spark, monkeypatch, name):
    expected = sorted(catalog.queries()[name](spark, SF).collect())
    monkeypatch.setattr(R, "LARGE_COMPANY", int(ledger(spark, SF).groupBy("company_id").count().agg(F.percentile_approx("count", 0.5)).first()[0]))
    assert sorted(catalog.queries()[name](spark, SF).collect()) == expected
