"""Detection, duplicates and consolidation on small statements."""

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import consolidate as K
from ledgerloom.operators import detect as E
from ledgerloom.operators import duplicates as D
from ledgerloom.operators import ingest as I

from .demo import statement

SCHEMA = "id string, company_id string, bank_account_id string, date date, amount double, type string, description string, counterparty_name string, document_number string, category_id string"


def ledger(spark, rows, parties=None):
    frame = spark.createDataFrame([(i, "c", "a", d, a, "income" if a > 0 else "expense", t, parties, None, None) for i, d, t, a in rows], SCHEMA)
    if parties is None:
        frame = I.with_counterparty(frame.drop("counterparty_name", "document_number"), "description").drop("counterparty_rule")
    return frame


def test_demo_statement_has_46_rows():
    assert len(statement()) == 46


def test_one_possible_duplicate(spark):
    found = D.duplicate_pairs(ledger(spark, statement())).collect()
    assert [(r.score, r.same_description, r.same_counterparty, r.same_document) for r in found] == [(95, True, True, False)]


def test_documents_are_compared_as_text(spark):
    rows = [("a", date(2026, 1, 5), "X", -10.0), ("b", date(2026, 1, 5), "X", -10.0)]
    frame = ledger(spark, rows, "ACME").withColumn("document_number", F.when(F.col("id") == "a", "12345678000190").otherwise("12.345.678/0001-90"))
    (pair,) = D.duplicate_pairs(frame).collect()
    assert (pair.score, pair.same_document) == (95, False)


def test_subscription_is_one_linked_suggestion(spark):
    texts = ["NETFLIX.COM", "PAGAMENTO NETFLIX", "NETFLIX SERVICOS DIGITAIS", "COMPRA NETFLIX.COM"]
    rows = [(f"n{m}", date(2026, m, 5), t, -39.9) for m, t in enumerate(texts, 1)]
    (found,) = E.detect_recurrences(ledger(spark, rows, "NETFLIX")).collect()
    assert (found.pattern_kind, found.frequency, found.recurrence_type, found.average_amount, found.confidence) == (None, "monthly", "fixed", -39.9, 91)
    assert found.next_date == date(2026, 5, 5) and found.representative == "NETFLIX.COM" and found.transaction_ids == ["n1", "n2", "n3", "n4"]


def test_demo_series_are_found(spark):
    found = {tuple(r.transaction_ids): r for r in E.detect_recurrences(ledger(spark, statement()), patterns=False).collect()}
    ids = {}
    for i, _, text, _ in statement():
        ids.setdefault(" ".join(text.split()[:4]), []).append(i)
    rent = found[tuple(ids["DEB AUTOR IMOBILIARIA SOLAR"])]
    assert rent.frequency == "monthly" and rent.average_amount == -4500.0 and rent.next_date == date(2026, 5, 5)
    # The dd/mm that ends PIX descriptions counts as an instalment, whose total is the first most frequent month.
    accountant = found[tuple(i for i, _, t, _ in statement() if "CONTABILIDADE" in t)]
    assert accountant.installment_count == 1


def test_families(spark):
    rows = [("installment", "monthly", None, "", "installment"), (None, "monthly", 3, "", "installment"), (None, "monthly", None, "PARCELA 1", "installment"), ("frequent_supplier", "unknown", None, "", "biweekly"), ("weekly_recurring", "weekly", None, "", "weekly"), ("recurring_income", "unknown", None, "", "monthly"), (None, "unknown", None, "", "irregular")]
    frame = spark.createDataFrame(rows, "kind string, frequency string, n int, text string, family string")
    for r in frame.select("family", K.pattern_family(F.col("kind"), F.col("frequency"), F.col("n"), F.col("text")).alias("got")).collect():
        assert r.family == r.got


def suggestion(i, ids, confidence=80, kind="monthly_fixed", text="aluguel sala", amount=-100.0, phase=5):
    return (i, "c", "expense", "a", "monthly", "fixed", kind, None, text, text.upper(), amount, 0.0, confidence, ids, phase, 90)


CONSOLIDATED = "id string, company_id string, type string, accounts string, frequency string, recurrence_type string, pattern_kind string, installment_count int, normalized_description string, description string, average_amount double, variation_percent double, confidence int, transaction_ids array<string>, phase int, span int"


def kept(spark, *rows):
    return sorted(r.id for r in K.consolidate(spark.createDataFrame(list(rows), CONSOLIDATED)).collect())


def test_same_series_merges_into_the_larger_when_confidence_is_near(spark):
    assert kept(spark, suggestion("s1", ["1", "2", "3"], 82), suggestion("s2", ["1", "2", "3", "4"], 80)) == ["s2"]


def test_different_series_stay(spark):
    assert kept(spark, suggestion("s1", ["1", "2", "3"]), suggestion("s2", ["4", "5", "6"], text="internet fibra", amount=-900.0)) == ["s1", "s2"]


def test_phase_keeps_two_series_of_one_payee_apart(spark):
    assert kept(spark, suggestion("s1", ["1", "2", "3"], phase=2), suggestion("s2", ["4", "5", "6"], phase=16)) == ["s1", "s2"]


def test_internal_transfers_go(spark):
    assert kept(spark, suggestion("s1", ["1", "2"], text="transferencia interna entre contas")) == []


def test_covered_suggestion_goes(spark):
    rows = [suggestion("s1", ["1", "2", "3", "4"], 90), suggestion("s2", ["2", "3", "4", "9"], 70, kind="monthly_variable", text="sala comercial centro", amount=-500.0)]
    assert kept(spark, *rows) == ["s1"]


def test_no_rows_give_no_suggestions(spark):
    assert E.detect_recurrences(spark.createDataFrame([], SCHEMA)).count() == 0
