"""Lanes are hashed where the rows of a company lie; rows that share an id, and large companies, have those of the definition."""

import hashlib
import random
from collections import defaultdict
from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import in_place as I
from ledgerloom.operators import recurrence as R

SCHEMA = "id string, company_id string, type string, date date, amount double, description string, counterparty_name string, document_number string"


def ledger(spark, seed, n, copies):
    """Rows of two companies; ``copies`` ids stand for two rows each, with dates and amounts of their own."""
    r = random.Random(seed)
    ids = [f"i{i:03d}" for i in range(n)] + [f"i{i:03d}" for i in range(copies)]
    rows = [(f"c{int(i[1:]) % 2}-{i}", f"c{int(i[1:]) % 2}", r.choice(["expense", "income"]), None if r.random() < 0.05 else date(2026, r.randint(1, 9), r.randint(1, 28)), r.choice([0.0, 100.0, 142.0, 143.0, -250.5, 1e-10, None]), r.choice(["AZUL NORTE", "AZUL SUL", "VERDE"]), None, None) for i in ids]
    return R.normalized_rows(spark.createDataFrame(rows, SCHEMA))


def difference(a, b):
    return 0.0 if a + b == 0 else abs(a - b) / ((a + b) / 2)


def plain(rows):
    facts, groups, found = defaultdict(list), defaultdict(list), set()
    for r in rows.select("id", "date", "abs_amount").collect():
        facts[r.id].append((r.date, r.abs_amount))
    for r in R.identity_members(rows).collect():
        groups[r.company_id, r.type, r.key].append(r.id)
    for name, ids in groups.items():
        own = [(i, *f) for i in ids for f in facts[i]] if len(ids) >= 5 else []
        for anchor in {i for i, *_ in own}:
            near = {"day": [], "amount": []}
            for _, d, a in [x for x in own if x[0] == anchor]:
                near["day"] += [i for i, e, _ in own if d and e and abs(d.day - e.day) <= 3]
                near["amount"] += [i for i, _, b in own if a is not None and b is not None and difference(a, b) <= 0.35]
            found |= {(*name, lane, anchor, len(x), hashlib.md5("|".join(sorted(x)).encode()).hexdigest()) for lane, x in near.items() if 3 <= len(x) < len(ids)}
    return found


def shown(frame):
    rows = [tuple(r) for r in frame.select("company_id", "type", "key", "lane", "anchor_id", "n", "signature").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_lanes_by_definition_with_and_without_copied_ids_and_large_companies(spark, monkeypatch):
    for copies in (0, 4):
        rows = ledger(spark, copies, 90, copies).cache()
        expected = plain(rows)
        assert expected and shown(R.lanes(rows)) == expected
        with monkeypatch.context() as m:
            m.setattr(R, "LARGE_COMPANY", 10)
            assert shown(R.lanes(rows)) == expected
    assert R.lanes(rows.where("false")).count() == 0


def test_lists_of_lanes_are_not_shuffled(spark):
    plan = R.lanes(ledger(spark, 1, 20, 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_copied_ids_have_their_lanes_in_place(spark):
    plan = R.lanes(ledger(spark, 3, 30, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Union" not in plan


def test_lanes_in_portions(spark, monkeypatch):
    rows = ledger(spark, 5, 60, 3).cache()
    table = R._lanes_rows(rows).where("company_id = 'c0'").toArrow()
    whole = {tuple(r.values()) for b in I.lanes_of(iter(table.to_batches()), 3, 0.35, 5) for r in b.to_pylist()}
    monkeypatch.setattr(I, "CELLS", 7)
    monkeypatch.setattr(I, "HANDED_ON", 3)
    parts = [b.to_pylist() for b in I.lanes_of(iter(table.to_batches()), 3, 0.35, 5)]
    assert whole == {tuple(r.values()) for p in parts for r in p} == {e for e in plain(rows) if e[0] == "c0"} and len(parts) > 10


def test_few_texts_are_normalised_once_with_the_same_result(spark, monkeypatch):
    texts = [("Pagto Água 12/03", None, None), (None, "Água SA", "12.345.678/0001-95"), ("NF 12345678901", "Água SA", None), ("", "", ""), (None, None, None)]
    txns = spark.createDataFrame([(i, (-1.0) ** i * i * 40, *texts[i % 5]) for i in range(20)], "id int, amount double, description string, counterparty_name string, document_number string")
    plain_rows = R.normalized_rows(txns).withColumn("text_keys", R.text_keys()["key"])
    names = sorted(plain_rows.columns)
    expected = plain_rows.select(names).orderBy("id").collect()
    once = R.normalized_once(txns, text_keys=lambda texts: R.text_keys()["key"])
    assert once.select(names).orderBy("id").collect() == expected and "Join" in once._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(R, "MOST_TEXTS", 2)
    assert R.normalized_once(txns, text_keys=lambda texts: R.text_keys()["key"]).select(names).orderBy("id").collect() == expected
