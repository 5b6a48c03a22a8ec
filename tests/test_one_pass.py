"""Queries that read and normalise the ledger once, where they did so for every fact before."""

import contextlib
import io
import os

import pytest

from ledgerloom.operators import audit as A
from ledgerloom.operators import series as G
from ledgerloom.plans import catalog, queries_series

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


def scans(spark, name):
    """How often the plan of a query reads line items."""
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        catalog.queries()[name](spark, SF).explain()
    return plan.getvalue().count("lineitem.parquet")


@pytest.mark.parametrize("name", ["legacy_score", "pattern_score", "pattern_monthly"])
def test_scores_read_the_ledger_once(spark, name):
    assert scans(spark, name) == 1


def test_facts_side_by_side_equal_those_apart(spark):
    rows = [("a", "2026-01-01", 10.0, "x", "1"), ("a", "2026-01-01", 12.0, "y", "2"), ("a", "2026-02-01", 11.0, "y", "0"), ("a", None, 5.0, None, "3"), ("a", None, 5.0, None, "4"), ("b", "2026-01-31", -3.0, None, "5"), ("c", None, 1.0, "x", "6")]
    frame = spark.createDataFrame(rows, "party string, date string, amount double, category_id string, id string").withColumn("date", G.F.col("date").cast("date"))
    ledger = queries_series.rows_of(spark, SF)
    for own, keys in ((frame, ["party"]), (ledger, ["company_id", "bucket"])):
        apart = G.periodicity(own, keys).join(G.amount_stability(own, keys), keys).join(G.category_consistency(own, keys), keys)
        shown = lambda f: sorted([{c: round(v, 9) if isinstance(v, float) else str(v) for c, v in r.asDict().items()} for r in f.select(*sorted(apart.columns)).collect()], key=str)
        assert shown(G.series_facts(own, keys)) == shown(apart)


def test_the_cadence_track_reads_the_ledger_once(spark):
    assert scans(spark, "cadence_track") == 1


def test_classes_do_not_read_the_ledger_for_every_fact(spark):
    assert scans(spark, "candidate_class") == scans(spark, "actionable_audit") == 0


def test_variants_of_lone_pairs_need_no_group_in_python(spark):
    rows = [("a", "g", 0.5, 1), ("b", "g", 0.5, 2), ("c", "h", 0.0, 1), ("d", "h", 0.0, 1), ("e", "i", 0.5, None), ("f", "i", 0.5, 3), ("x", "j", 0.9, 1), ("y", "j", 0.8, 1), ("z", "j", 0.7, 1)]
    classes = spark.createDataFrame([(*r, "partial_match") for r in rows], "suggestion_id string, group_id string, f1 double, confidence int, class string")
    sets = {"x": "12", "y": "123456", "z": "3456"} | dict.fromkeys("ab", "7") | dict.fromkeys("cd", "8") | dict.fromkeys("ef", "9")
    labelled = spark.createDataFrame([(s, t) for s, ts in sets.items() for t in ts], "suggestion_id string, transaction_id string")
    found = {r.suggestion_id for r in A.mark_variants(classes, labelled).collect() if r["class"] == "duplicate_variant"}
    assert found == {"a", "d", "e", "y"}


def test_records_of_many_blocks_are_linked_without_a_group_each_in_python(spark):
    rows = [("c", f"2026-01-{d:02d}", 100, f"s{d}-{i}", "t" if i else "u", None, None) for d in range(1, 20) for i in range(3)]
    schema = "company_id string, date string, cents int, id string, text string, party string, document string"
    stored = spark.createDataFrame(rows, schema)
    links = A.link_records(stored, stored.where("not id like '%-0'"))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        links.explain()
    assert "FlatMapGroupsInPandas" not in plan.getvalue() and "MapInPandas" in plan.getvalue()
    expected = {(f"s{d}-{i}", f"s{d}-{i}", 11, True) for d in range(1, 20) for i in (1, 2)}
    assert {tuple(r) for r in links.collect()} == expected


def test_similarities_of_groups_share_their_profiles(spark):
    assert scans(spark, "group_similarity") == 0


def test_pairs_read_described_suggestions(spark):
    assert scans(spark, "equivalence_pairs") == 0


def test_reports_read_disposed_lines(spark):
    assert scans(spark, "import_report") == 0


def test_loads_read_canonical_rows(spark):
    assert scans(spark, "idempotent_load") == 0


def test_rules_meet_normalised_rows_once(spark):
    assert scans(spark, "confidence_band") == 1
