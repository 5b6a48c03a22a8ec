"""Links and their groups are told where the rows of companies lie, with the results of joins."""

import random
from datetime import date

from ledgerloom.operators import in_place as I
from ledgerloom.operators import recurrence as R

SCHEMA = "id string, company_id string, type string, date date, amount double, description string, counterparty_name string, document_number string"
TEXTS = ["AZUL NORTE", "AZUL SUL 1/3", "AZUL SUL 2/3", "PARCELA 2/6 VERDE", "PARCELA 3/6 VERDE", "ENERGIA", "LUZ ENEL", "ALUGUEL", "LOCACAO", "PAGTO", None]


def ledger(spark, seed, n=150, companies=3):
    r = random.Random(seed)
    some = lambda value, share=0.05: None if r.random() < share else value
    rows = []
    for i in range(n):
        company = i % companies
        last = r.choice([date(2026, 1, 31), date(2026, 2, 28), date(2026, 4, 30), date(2026, 5, 31), date(2025, 11, 30)])
        day = some(last if r.random() < 0.3 else date(2026, r.randint(1, 9), r.randint(1, 28)))
        party, document = r.choice([None, None, "Ana", "Bia"]), r.choice([None, None, None, "11.111.111/0001-11"])
        rows.append((some(f"{company}-{i - (i % 40 == 3) * companies}"), some(f"c{company}", 0.03), some(r.choice(["expense", "income"]), 0.03), day, some(r.choice([0.0, 100.0, 110.0, 142.0, -150.0, 300.0, float("nan")])), r.choice(TEXTS), party, document))
    return R.normalized_rows(spark.createDataFrame(rows, SCHEMA))


def shown(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_links_in_place_and_in_portions_are_those_of_joins(spark, monkeypatch):
    for seed, months in ((1, 3), (2, 1), (3, 11)):
        rows = ledger(spark, seed).cache()
        found = shown(R.link_edges(rows, months))
        table = R._linkable(rows.where("company_id is not null and type is not null and id is not null and date is not null and abs_amount is not null")).sort("company_id").toArrow()
        with monkeypatch.context() as m:
            m.setattr(I, "CELLS", 5)
            m.setattr(I, "TOGETHER", 20)
            parts = [tuple(r.values()) for b in I.links_of(iter(table.to_batches(max_chunksize=7)), months, 0.6, 0.12, R.OTHER_PART, R.NEAR) for r in b.to_pylist()]
            m.setattr(R, "LARGE_LINKED", 10)
            assert found and set(parts) == found == shown(R.link_edges(rows, months)) and len(parts) == len(found)


def test_links_are_not_spread_over_their_grounds(spark, monkeypatch):
    written, materialise = [], R.materialise
    monkeypatch.setattr(R, "materialise", lambda frame, name: written.append(name) or materialise(frame, name))
    edges = R.link_edges(ledger(spark, 4))
    assert "Join" not in edges._jdf.queryExecution().executedPlan().toString() and R.linked_groups(edges).count()
    assert written == ["links"]


def test_groups_of_links(spark, monkeypatch):
    r = random.Random(5)
    edges = [(f"c{c}", f"{c}-{r.randint(0, 60)}", f"{c}-{r.randint(0, 60)}") for c in range(8) for _ in range(45)] + [("c0", None, "0-1")]
    frame = spark.createDataFrame(edges, "company_id string, left_id string, right_id string")
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for _, a, b in edges[:-1]:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    expected = {(x, find(x)) for x in list(top)}
    assert shown(R.linked_groups(frame)) == expected
    monkeypatch.setattr(R, "LARGE_COMPANY", 10)
    assert shown(R.linked_groups(frame)) == expected
    assert R.linked_groups(frame.where("false")).count() == 0
