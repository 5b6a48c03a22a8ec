"""Evaluation ids and suggestion keys, worked out with another JSON writer."""

import hashlib
import json
from datetime import date

from ledgerloom.operators import categorize as C


def test_evaluation_ids_by_hand(spark):
    rows = [("c", "t1", date(2026, 1, 5), 'PIX "Ação" \\ x/y', -12.5, "expense", None, "123"), ("c", "t2", date(2026, 1, 6), "b", 1200.0, "income", "P", None), ("d", "t3", date(2026, 1, 6), "b", 0.05, "income", "P", None)]
    txns = spark.createDataFrame(rows, "company_id string, id string, date date, description string, amount double, type string, counterparty_name string, document_number string")
    rules = spark.createDataFrame([("c", "r2", 1, 10, 90.0, "active"), ("c", "r1", 3, 20, 72.5, "active"), ("c", "r0", 1, 1, 1.0, "inactive")], "company_id string, rule_id string, version int, priority int, confidence double, status string")
    found = {r.transaction_id: r.evaluation_id for r in C.evaluation_ids(txns, rules).collect()}
    for company, id_, day, description, amount, kind, party, document in rows:
        own = [{"id": "r1", "version": 3, "priority": 20, "confidence": 72.5}, {"id": "r2", "version": 1, "priority": 10, "confidence": 90}] if company == "c" else []
        record = {
            "engineVersion": "categorization-engine-v1",
            "transaction": {"id": id_, "companyId": company, "date": f"{day}T00:00:00.000Z", "description": description, "amount": int(amount) if amount == int(amount) else amount, "type": kind, "counterpartyName": party, "documentNumber": document},
            "rules": own,
        }
        assert found[id_] == hashlib.sha256(json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    candidates = spark.createDataFrame([("c", "t1", "A", 80, "r1"), ("c", "t1", "A", 90, "r2"), ("c", "t1", "B", 70, "r1")], "company_id string, transaction_id string, category_id string, score int, rule_id string")
    keys = {(r.dedup_key, r.rule_id) for r in C.suggestion_keys(candidates, C.evaluation_ids(txns, rules)).collect()}
    assert keys == {(f"{found['t1']}:A", "r2"), (f"{found['t1']}:B", "r1")}
