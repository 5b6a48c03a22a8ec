"""Audits against labelled truth: values worked out by hand, and a plain version of the greedy steps."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_classes_by_hand(spark):
    truth = [(f"a{i}", "A", "fixed", f"2026-{i % 6 + 1:02d}", "P") for i in range(5)] + [(f"b{i}", "B", "fixed", "2026-01", "Q") for i in range(6)]
    truth += [(f"t{i}", None, "own_transfer", f"2026-{i + 1:02d}", "R") for i in range(4)] + [(f"x{i}", None, "shop", f"2026-{i + 1:02d}", "S") for i in range(4)] + [("y", None, "shop", "2026-01", "")]
    members = {
        "exact": ["a0", "a1", "a2", "a3"], "other-frequency": ["a0", "a1", "a2", "a3"], "low-recall": ["a0", "a1", "a2"], "mixed": ["a0", "a1", "b0", "b1"], "one-of-each": ["a0", "b0", "x0"],
        "transfers": ["t0", "t1", "y"], "plausible": ["x0", "x1", "x2", "x3", "unlabelled"], "few-months": ["x0", "x1", "x2"], "nothing": ["unlabelled"], "biweekly": [f"b{i}" for i in range(6)],
    }
    found = [(s, t) for s, ts in members.items() for t in ts]
    candidates = [(s, "weekly" if s == "other-frequency" else "biweekly" if s == "biweekly" else "monthly", 50) for s in members]
    groups = frame(spark, [("A", "fixed", "monthly"), ("B", "frequent_supplier", "monthly"), ("C", "fixed", "monthly")], "group_id string, kind string, frequency string")
    classes = A.candidate_classes(
        frame(spark, found, "suggestion_id string, transaction_id string"), frame(spark, truth, "transaction_id string, group_id string, kind string, month string, party string"),
        frame(spark, candidates, "suggestion_id string, frequency string, confidence int"), groups,
    )
    told = {r.suggestion_id: r for r in classes.collect()}
    assert {s: r["class"] for s, r in told.items()} == {
        "exact": "exact_match", "other-frequency": "partial_match", "low-recall": "partial_match", "mixed": "merge_error", "one-of-each": "false_positive", "transfers": "false_positive",
        "plausible": "ambiguous", "few-months": "false_positive", "nothing": "false_positive", "biweekly": "exact_match",
    }
    assert (told["exact"].precision, told["exact"].recall, told["mixed"].group_id, told["nothing"].mapped) == (1.0, 0.8, "A", 0)
    assert sorted(map(tuple, A.group_coverage(classes, groups).collect())) == [("A", "exact", True), ("B", "exact", False), ("C", "absent", False)]
    labelled = frame(spark, [(s, t) for s, t in found if t != "unlabelled"], "suggestion_id string, transaction_id string")
    marked = {r.suggestion_id: r["class"] for r in A.mark_variants(classes, labelled).collect()}
    assert {s for s, c in marked.items() if c == "duplicate_variant"} == {"other-frequency", "low-recall"}
    (a,) = A.actionable(classes).collect()
    assert (a.total, a.true_positive, a.fragmented_true_positive, a.ambiguous, a.false_positive, a.duplicate_actionable, a.passes) == (10, 2, 2, 1, 5, 0, False)
    assert A.mark_variants(classes.where("1 = 0"), labelled).count() == 0


def test_variants_equal_the_plain_choice(spark):
    rng = np.random.default_rng(8)
    sets = {f"s{i:02d}": frozenset(f"t{k}" for k in rng.choice(30, rng.integers(2, 12), replace=False)) for i in range(60)}
    ranks = {s: (f"g{i % 5}", float(rng.integers(0, 4)) / 4, int(rng.integers(0, 3))) for i, s in enumerate(sets)}
    classes = frame(spark, [(s, g, f, c, "partial_match") for s, (g, f, c) in ranks.items()], "suggestion_id string, group_id string, f1 double, confidence int, class string")
    labelled = frame(spark, [(s, t) for s, ts in sets.items() for t in ts], "suggestion_id string, transaction_id string")
    expected = set()
    for group in {g for g, _, _ in ranks.values()}:
        taken = []
        for s in sorted((s for s in ranks if ranks[s][0] == group), key=lambda s: (-ranks[s][1], -ranks[s][2], s)):
            if any(len(sets[s] & sets[t]) / min(len(sets[s]), len(sets[t])) > 0.7 for t in taken):
                expected.add(s)
            else:
                taken.append(s)
    found = {r.suggestion_id for r in A.mark_variants(classes, labelled).where("class = 'duplicate_variant'").collect()}
    assert found == expected and found


def test_links_of_records(spark):
    kind = "company_id string, date string, cents long, id string, text string, party string, document string"
    stored = frame(spark, [("c", "d", 1, "s1", "X", "P", None), ("c", "d", 1, "s2", "Y", None, "7"), ("c", "d", 2, "s3", "Z", None, None), ("c", "d", 3, "s4", "Z", None, None)], kind)
    truth = frame(spark, [("c", "d", 1, "t1", "W", "P", "7"), ("c", "d", 1, "t2", "V", "P", None), ("c", "d", 2, "t3", "Z", None, None)], kind)
    found = sorted(map(tuple, A.link_records(stored, truth).collect()))
    assert found == [("s1", "t2", 4, True), ("s2", "t1", 6, False), ("s3", "t3", 11, False)]


def test_rules_bands_and_families(spark):
    rows = [("P", None, "F", -50.0, "cat-a", f"2026-0{m}-01") for m in (1, 2, 3)] + [("P", "9", "F", -700.0, "cat-b", "2026-01-02"), ("Q", "9", "G", 1.0, "cat-uncategorized", "2026-01-02"), ("Q", "9", "G", 1.0, None, "2026-01-02")]
    frame_ = frame(spark, rows, "counterparty_name string, document_number string, family string, amount double, category_id string, d string").withColumn("date", F.to_date("d"))
    found = {(r.rule_type, r.value): (r.category_id, r.n, r.months, r.purity, r.general) for r in A.mine_rules(frame_).collect()}
    assert found == {
        ("counterparty_contains", "P"): ("cat-a", 3, 3, 0.75, False), ("description_contains", "F"): ("cat-a", 3, 3, 0.75, False), ("document_equals", "9"): ("cat-b", 1, 1, 1.0, False),
        ("counterparty_and_amount_range", "P|0-99.99"): ("cat-a", 3, 3, 1.0, True), ("counterparty_and_amount_range", "P|500-999.99"): ("cat-b", 1, 1, 1.0, False),
    }
    bands = spark.createDataFrame([(x,) for x in (-99.99, 100.0, 4999.99, 20000.0)], "a double").select(A.amount_band(F.col("a")).alias("b"), A.description_family(F.lit("Ref. nº 12 Pão/doc 7a")).alias("f"), A.description_family(F.lit("doc 12")).alias("e")).collect()
    assert [r.b for r in bands] == ["0-99.99", "100-499.99", "1000-4999.99", "20000+"] and (bands[0].f, bands[0].e) == ("Nº PAO 7A".replace("º", ""), "SEM DESCRICAO")
