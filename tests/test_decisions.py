"""Change sets of decisions, cascades, gates, truth files, published versions and the greedy cover."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.operators import cascade as X
from ledgerloom.operators import categorize as C
from ledgerloom.operators import changes as H
from ledgerloom.operators import cover as V
from ledgerloom.operators import duplicates as D
from ledgerloom.operators import gate as W
from ledgerloom.operators import ingest as I
from ledgerloom.operators import persist as P
from ledgerloom.operators import projection as R
from ledgerloom.sources import truth as J
from ledgerloom.sources.versions import Versions
from ledgerloom.streaming import incremental as S


def state(spark):
    make = spark.createDataFrame
    return {
        "transactions": make([("c", "t1", "expense", None), ("c", "t2", "expense", "k1"), ("c", "t3", "income", None), ("d", "t1", "expense", None)], "company_id string, id string, type string, category_id string"),
        "categories": make([("c", "k1", "expense", True), ("c", "k2", "both", True), ("c", "old", "both", False), ("d", "k9", "both", True)], "company_id string, category_id string, expected_type string, is_active boolean"),
        "suggestions": make([("c", "s1", "t1", "e1", "generated"), ("c", "s2", "t1", "e1", "generated"), ("c", "s3", "t1", "e0", "generated"), ("c", "s4", "t3", "e2", "accepted"), ("d", "s1", "t1", "e1", "generated")], "company_id string, id string, transaction_id string, evaluation_id string, status string"),
        "pendings": make([("c", "p1", "category_review", "t1", "s1", "open", None), ("c", "p2", "uncategorized", "t1", None, "in_review", None), ("c", "p3", "category_review", "t1", None, "resolved", "x"), ("c", "p4", "possible_duplicate", "t1", None, "open", None), ("d", "p1", "category_review", "t1", None, "open", None)],
                         "company_id string, id string, type string, transaction_id string, suggestion_id string, status string, resolved_by string"),
        "audit": make([], H.AUDIT), "commits": make([("d0", "c", None)], H.COMMITS),
    }


DECISIONS = "decision_id string, company_id string, transaction_id string, suggestion_id string, suggestion_status string, final_category_id string, expected_category_id string, pending_status string, actor string, reason string, rule_id string"


def decisions(spark):
    return spark.createDataFrame([
        ("d0", "c", "t3", None, None, "k2", None, "resolved", "u", None, None),
        ("d1", "c", "t1", "s1", "accepted", "k2", None, "resolved", "u", "ok", "r1"),
        ("d2", "c", "t1", "s2", "accepted", "k1", None, "resolved", "u", None, None),
        ("d3", "c", "t2", None, None, "k2", "other", "resolved", "u", None, None),
        ("d4", "c", "t3", None, None, "old", None, "resolved", "u", None, None),
        ("d5", "c", "t3", None, None, "k1", None, "resolved", "u", None, None),
        ("d6", "c", "t3", "s4", "rejected", None, None, "dismissed", "u", None, None),
        ("d7", "c", "t9", None, None, None, None, "resolved", "u", None, None),
        ("d8", "c", "t3", "s1", "accepted", "k2", None, "resolved", "u", None, None),
        ("d9", "d", "t1", None, None, "k1", None, "resolved", "u", None, None),
    ], DECISIONS)


def test_a_decision_is_one_change_set(spark):
    before = state(spark)
    after = H.decide(before, decisions(spark))
    errors = {r.decision_id: r.error for r in after["commits"].collect()}
    assert errors == {"d1": None, "d2": "category_changed", "d3": "category_changed", "d4": "inactive_category", "d5": "incompatible_category", "d6": "already_decided", "d7": "unknown_transaction", "d8": "foreign_suggestion", "d9": "unknown_category"}
    assert {(r.company_id, r.id): r.category_id for r in after["transactions"].collect()} == {("c", "t1"): "k2", ("c", "t2"): "k1", ("c", "t3"): None, ("d", "t1"): None}
    assert {(r.company_id, r.id): r.status for r in after["suggestions"].collect()} == {("c", "s1"): "accepted", ("c", "s2"): "superseded", ("c", "s3"): "generated", ("c", "s4"): "accepted", ("d", "s1"): "generated"}
    assert {(r.company_id, r.id): (r.status, r.resolved_by) for r in after["pendings"].collect()} == {("c", "p1"): ("resolved", "u"), ("c", "p2"): ("resolved", "u"), ("c", "p3"): ("resolved", "x"), ("c", "p4"): ("open", None), ("d", "p1"): ("open", None)}
    audit = sorted((r.entity_type, r.entity_id, r.action, r.previous_category_id, r.final_category_id, r.pending_type, r.previous_status, r.final_status) for r in after["audit"].collect())
    assert audit == [("PendingItem", "p1", "pending.resolved", None, "k2", "category_review", "open", "resolved"), ("PendingItem", "p2", "pending.resolved", None, "k2", "uncategorized", "in_review", "resolved"), ("Transaction", "t1", "categorization.accepted", None, "k2", None, None, None)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/tables")
    assert store.latest() == 0 and store.read("audit") is None
    store.publish(state(spark))
    names = ("transactions", "suggestions", "pendings", "audit", "commits", "categories")

    def run():
        before = {n: store.read(n) for n in names}
        after = H.decide(before, decisions(spark))
        return store.publish({n: after[n] for n in names[:3]}, {n: after[n] for n in ("audit", "commits")})

    contents = lambda: {n: sorted(map(str, store.read(n).collect())) for n in names}
    assert run() == 2
    first = contents()
    assert run() == 3 and contents() == first and store.read("commits").count() == 10
    assert store.read("commits", 1).count() == 1


def test_versions_are_published_whole_or_not_at_all(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/tables")
    rows = spark.range(3)
    store.publish({"a": rows, "b": rows})
    broken = rows.withColumn("id", F.raise_error(F.lit("dies half-way")).cast("long"))
    with pytest.raises(Exception, match="dies half-way"):
        store.publish({"a": spark.range(9), "b": broken})
    assert store.latest() == 1 and store.read("a").count() == 3
    store.publish(append={"a": spark.range(2)})
    assert store.read("a").count() == 5 and store.read("a", 1).count() == 3 and store.read("b").count() == 3
    with pytest.raises(RuntimeError):
        store.publish({"a": rows}, after=1)


def test_statements_stream_into_versions(spark, tmp_path):
    lines, base = f"file://{tmp_path}/lines", f"file://{tmp_path}/tables"
    make = lambda rows: spark.createDataFrame([("f", i, c, "a", "05/01/2026", text, "-10,00") for i, c, text in rows], S.LINE_SCHEMA)
    make([(1, "c1", "X"), (2, "c1", "Y"), (3, "c2", "X")]).write.parquet(lines)
    S.stream_versions(spark, lines, base, f"file://{tmp_path}/check").awaitTermination()
    store = Versions(spark, base)
    assert store.latest() == 1 and store.read("ledger").count() == store.read("keys").count() == 3
    make([(1, "c1", "X"), (4, "c1", "Z")]).write.mode("append").parquet(lines)
    S.stream_versions(spark, lines, base, f"file://{tmp_path}/check").awaitTermination()
    assert store.latest() == 2 and sorted(r.description for r in store.read("ledger").where("company_id = 'c1'").collect()) == ["X", "Y", "Z"]
    S.publish_batch(base)(make([(9, "c1", "W")]), 1)
    assert store.latest() == 2


def test_cascade_leaves_no_orphans_and_nothing_else_goes(spark):
    make = spark.createDataFrame
    tables = {
        "uploaded_file": make([("f1", "c"), ("f2", "d")], "id string, company_id string"), "bank_import": make([("b1", "f1"), ("b2", "f2"), ("b3", None)], "id string, uploaded_file_id string"),
        "transaction": make([("t1", "b1"), ("t2", "b2"), ("t3", None)], "id string, bank_import_id string"), "duplicate_candidate": make([("t1", "t3"), ("t2", "t3")], "left_id string, right_id string"),
        "pending_item": make([("p1", "t1"), ("p2", None)], "id string, transaction_id string"), "company": make([("c",)], "id string"),
    }
    kept, gone = X.cascade_delete(tables, {"uploaded_file": tables["uploaded_file"].where("company_id = 'c'").select("id")})
    assert X.orphans(kept).count() == 0 and X.orphans({**tables, "uploaded_file": kept["uploaded_file"]}).count() == 1
    assert {n: sorted(r[0] for r in f.collect()) for n, f in kept.items()} == {"uploaded_file": ["f2"], "bank_import": ["b2", "b3"], "transaction": ["t2", "t3"], "duplicate_candidate": ["t2"], "pending_item": ["p2"], "company": ["c"]}
    assert all(kept[n].count() + gone[n].count() == tables[n].count() for n in tables)
    with pytest.raises(ValueError):
        X.dependency_order([("a", "x", "b", "id"), ("b", "y", "a", "id")])


def test_gate_names_what_fails(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0)], "id long, amount double")
    found = W.gate(spark, [(rows, [W.exactly("missing", F.count_if(F.col("amount").isNull()), 0), W.at_most("rows", F.count(F.lit(1)), 2)])])
    assert {r.name: (r.actual, r.holds) for r in found.collect()} == {"missing": (1.0, False), "rows": (2.0, True)}
    with pytest.raises(ValueError, match="missing=1"):
        W.must_hold(found)
    W.must_hold(W.gate(spark, [(rows.limit(0), [W.at_most("rows", F.count(F.lit(1)), 0)])]))


def test_truth_files_and_broken_ones(spark, tmp_path):
    folder = tmp_path / "truth"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"id": "t1", "companyId": "c", "date": "2026-01-05", "amount": -5.5, "expectedImportBehavior": "imported", "expectedRecurrenceGroupId": "g1", "other": 1}, {"id": "t2", "expectedImportBehavior": "skipped"}], indent=2))
    (folder / "b.json").write_text('[{"id": "t3", ')
    good, bad = J.read_truth(spark, str(folder), "transactions")
    assert sorted(r.id for r in good.collect()) == ["t1", "t2"] and [r.file for r in bad.collect()] == ["b.json"]
    (tmp_path / "groups.json").write_text(json.dumps({"groups": [{"id": "g1", "kind": "fixed", "frequency": "monthly", "transactionIds": ["t1"]}]}, indent=1))
    groups, bad = J.read_truth(spark, str(tmp_path / "groups.json"), "recurrences")
    rows, named = J.normalised_truth(good, groups)
    assert bad.count() == 0 and [(r.transaction_id, r.group_id, r.month) for r in rows.collect()] == [("t1", "g1", date(2026, 1, 1))] and named.first().frequency == "monthly"


def test_conditions_have_to_be_of_their_type(spark):
    rules = spark.createDataFrame([(1, '{"description": " Ab ", "minAmount": 3}'), (2, '{"description": 3, "minAmount": "3"}'), (3, '{"description": " ", "maxAmount": 1e2}'), (4, "no"), (5, None), (6, '[{"description": "x"}]')], "id int, conditions string")
    found = {r.id: (r.condition_description, r.condition_minAmount, r.condition_maxAmount) for r in C.guarded_conditions(rules).collect()}
    assert found == {1: (" Ab ", 3.0, None), 2: (None, None, None), 3: (None, None, 100.0), 4: (None,) * 3, 5: (None,) * 3, 6: (None,) * 3}


def plain_cover(covers, targets, goal):
    keys = {}
    for kind, value, purity, i in covers:
        keys.setdefault((-purity, value, V.RULE_ORDER[kind], kind), set()).add(i)
    done, picks = set(), []
    while len(done) < -(-targets * goal // 1):
        key = min(keys, key=lambda k: (-len(keys[k] - done), k), default=None)
        if key is None or not keys[key] - done:
            break
        picks.append((len(picks) + 1, key[3], key[1], -key[0], len(keys[key] - done)))
        done |= keys[key]
    return picks


@pytest.mark.parametrize("seed", range(3))
def test_cover_equals_one_key_a_step(spark, seed):
    r = random.Random(seed)
    covers = {(kind, f"v{r.randint(0, 6 + 12 * seed)}", None, i) for i in range(150) for kind in V.RULE_ORDER if r.random() < 0.7}
    purity = {(k, v): r.choice([1.0, 0.9, 0.75]) for k, v, _, _ in covers}
    rows = sorted((k, v, purity[k, v], i) for k, v, _, i in covers)
    frame = spark.createDataFrame(rows, "rule_type string, value string, purity double, id long")
    found = V.rule_cover(frame, 150, 0.8).orderBy("step").collect()
    assert [tuple(x)[:5] for x in found] == plain_cover(rows, 150, 0.8)
    assert V.rule_cover(frame.limit(0), 0).count() == 0


def test_mined_covers_hold_the_rows_of_the_dominant_category(spark):
    rows = spark.createDataFrame([(str(i), "P", "1" if i < 4 else None, "FAM", -50.0, "k1" if i < 5 else "k2", date(2026, 1 + i % 4, 1)) for i in range(6)], "id string, counterparty_name string, document_number string, family string, amount double, category_id string, date date")
    found = V.mined_covers(rows).groupBy("rule_type").agg(F.count("id").alias("n"), F.max("purity").alias("p")).collect()
    assert {r.rule_type: (r.n, round(r.p, 3)) for r in found} == {"document_equals": (4, 1.0), "counterparty_contains": (5, 0.833), "description_contains": (5, 0.833), "counterparty_and_amount_range": (5, 0.833)}


def test_equal_stored_ones_are_chosen_pair_by_pair(spark):
    """By rows s2 comes before s1, but of s1 and s3 the more confident stays, and of s3 and s2 the one with more rows."""
    fields = "id string, company_id string, type string, accounts string, frequency string, recurrence_type string, pattern_kind string, installment_count int, normalized_description string, description string, average_amount double, variation_percent double, confidence int, transaction_ids array<string>, phase int, span int"
    row = lambda i, ids, confidence: (i, "c", "expense", "a", "monthly", "fixed", "monthly_fixed", None, "aluguel sala", "ALUGUEL SALA", -100.0, 0.0, confidence, ids, 5, 90)
    stored = spark.createDataFrame([(*row("s1", ["1", "2", "3"], 80), "pending", False, "k1"), (*row("s2", ["1", "2", "3", "4", "5"], 77), "pending", False, "k2"), (*row("s3", ["1", "2", "3", "4"], 84), "pending", False, "k3")], fields + ", status string, approved boolean, dedup_key string")
    found = spark.createDataFrame([row("n1", ["1", "2", "3", "6"], 70)], fields)
    after = {r.id: r for r in P.persisted(found, stored).collect()}
    taken = [i for i, r in after.items() if "6" in r.transaction_ids]
    better = lambda a, b: a if len(a[1]) > len(b[1]) and abs(a[2] - b[2]) < 5 else b if abs(a[2] - b[2]) < 5 else max(a, b, key=lambda x: x[2])
    best = None
    for s in sorted([("s1", "123", 80), ("s2", "12345", 77), ("s3", "1234", 84)]):
        best = s if best is None else better(s, best)
    assert taken == [best[0]] == ["s3"] and sorted(i for i, r in after.items() if r.change == "superseded") == ["s1", "s2"]


def test_a_duplicate_is_decided_once(spark):
    make = spark.createDataFrame
    before = {
        "duplicates": make([("c", "d1", "t1", "t2", 95, None, None), ("c", "d2", "t3", "t4", 85, "confirmed", "v")], "company_id string, id string, left_id string, right_id string, score int, decision string, decided_by string"),
        "pendings": make([("c", "p1", "d1", "possible_duplicate", "open", None), ("c", "p2", "d1", "possible_duplicate", "dismissed", None), ("c", "p3", "d2", "possible_duplicate", "open", None)], "company_id string, id string, duplicate_candidate_id string, type string, status string, resolved_by string"),
        "commits": make([], H.COMMITS),
    }
    asked = make([("a", "c", "d1", "rejected", "u", "no"), ("b", "c", "d1", "confirmed", "w", None), ("e", "c", "d2", "rejected", "u", None), ("f", "x", "d1", "rejected", "u", None)], "decision_id string, company_id string, duplicate_id string, decision string, actor string, reason string")
    after = H.decide_duplicates(before, asked)
    assert {r.decision_id: r.error for r in after["commits"].collect()} == {"a": None, "b": "already_decided", "e": "already_decided", "f": "unknown_duplicate"}
    assert {r.id: (r.decision, r.decided_by) for r in after["duplicates"].collect()} == {"d1": ("rejected", "u"), "d2": ("confirmed", "v")}
    assert {r.id: (r.status, r.resolved_by) for r in after["pendings"].collect()} == {"p1": ("resolved", "u"), "p2": ("dismissed", None), "p3": ("open", None)}
    assert [(r.entity_id, r.transaction_id, r.candidate_transaction_id, r.decision, r.pending_ids) for r in after["audit"].collect()] == [("d1", "t1", "t2", "rejected", ["p1"])]
    again = H.decide_duplicates({**before, **{k: after[k] for k in ("duplicates", "pendings", "commits")}}, asked)
    assert again["audit"].count() == again["commits"].count() == 0


def test_evidence_of_duplicates_and_open_keys(spark):
    rows = spark.createDataFrame([("a", "c", "k", date(2026, 1, 5), -10.0, "expense", "Pago X", None, "1", "e1"), ("b", "c", "k", date(2026, 1, 5), -10.0, "expense", "PAGO  x", None, "1", None)], "id string, company_id string, bank_account_id string, date date, amount double, type string, description string, counterparty_name string, document_number string, external_id string")
    (pair,) = D.duplicate_evidence(D.duplicate_pairs(rows, details=True)).collect()
    assert pair.evidence.checks.asDict() == {"sameBankAccount": True, "sameDate": True, "sameAmount": True, "sameType": True, "sameDescription": True, "sameCounterparty": False, "sameDocument": True, "differentExternalId": True}
    assert (pair.evidence.firstExternalId, pair.evidence.secondExternalId, pair.evidence.normalizedDescription) == ("e1", None, "PAGO X")
    items = D.duplicate_pendings(D.duplicate_pairs(rows))
    held = items.select("dedup_key", F.lit("open").alias("status"))
    assert D.new_pendings(items, held).count() == 0 and D.new_pendings(items, held.withColumn("status", F.lit("resolved"))).count() == 1


def test_files_that_are_not_there(spark):
    files = spark.createDataFrame([("a.pdf", 9, b"%PDF-1.4 x")], "path string, length long, content binary")
    found = {r.path: r.error for r in I.requested_files(spark.createDataFrame([("a.pdf",), ("b.pdf",), (None,)], "path string"), files).collect()}
    assert found == {"a.pdf": None, "b.pdf": "FILE_NOT_FOUND", None: "INVALID_FILE"}


def test_every_company_has_a_base_scenario(spark):
    make = spark.createDataFrame
    companies, wanted = make([("a",), ("b",), ("d",)], "id string"), make([("a",), ("b",), ("b",), ("x",), (None,)], "company_id string")
    before = make([("a", "Other", 7), ("d", "Own", 8)], "company_id string, name string, days int")
    after, unknown = R.ensured_scenarios(companies, before, wanted)
    expected = [("a", "Base", 7), ("b", "Base", None), ("d", "Own", 8)]
    assert sorted(map(tuple, after.collect())) == expected and [tuple(r) for r in unknown.collect()] == [("x", "unknown_company")]
    assert sorted(map(tuple, R.ensured_scenarios(companies, after, wanted)[0].collect())) == expected


def test_the_period_of_an_import_is_the_one_that_the_file_tells(spark):
    lines = spark.createDataFrame([("f", "candidate"), ("g", "candidate"), ("h", "invalid")], "file string, disposition string")
    rows = spark.createDataFrame([("f", date(2026, 1, 5), False), ("g", date(2026, 1, 6), True)], "file string, date date, is_duplicate boolean")
    told = spark.createDataFrame([("f", date(2026, 1, 1), date(2026, 1, 31)), ("g", date(2026, 1, 1), None), ("h", date(2026, 2, 1), date(2026, 2, 28))], "file string, period_start date, period_end date")
    found = {r.file: (r.period_start, r.period_end, r.imported_rows, r.duplicate_rows, r.status) for r in I.import_report(lines, rows, told).collect()}
    assert found == {"f": (date(2026, 1, 1), date(2026, 1, 31), 1, 0, "success"), "g": (date(2026, 1, 6), date(2026, 1, 6), 0, 1, "success"), "h": (date(2026, 2, 1), date(2026, 2, 28), 0, 0, "failed")}
