"""Candidates are made where a company's rows lie; no list of rows is shuffled."""

import hashlib
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import detect as E
from ledgerloom.operators import judge as J
from ledgerloom.operators import recurrence as R
from ledgerloom.plans.scratch import materialise

from .test_patterns import random_ledger
from .test_recurrence import ledger


def incomes(seed):
    r = random.Random(seed)
    return [(f"s{seed}-{k}", date(2025, 1, 4) + timedelta(days=30 * (k // 2) + r.randint(0, 2)), r.choice(["CLIENTE SOL", "CLIENTE SOL NORTE"]), 100.0 + r.randint(0, 60)) for k in range(16)]


def test_candidates_are_groups_lanes_and_tracks(spark):
    rows = J.numbered(E.detection_rows(ledger(spark, random_ledger(7) + incomes(1)))).cache()
    md5 = lambda ids: hashlib.md5("|".join(sorted(ids)).encode()).hexdigest()
    groups = R.identity_groups(rows).groupBy("type", "key", "score").agg(F.collect_list("id").alias("ids")).collect()
    tracks = R.income_tracks(rows).collect()
    score = {(g.type, g.key): g.score for g in groups}
    expected = [(md5(g.ids), -g.score, g.key, g.type) for g in groups] + [(x.signature, -score[x.type, x.key], x.key, x.type) for x in R.lanes(rows).collect()]
    numbers = {r.id: r.row for r in rows.collect()}
    expected += [(md5(t.ids), -0.68, f"track:{numbers[t.anchor_id]}", "income") for t in tracks]
    best = {}
    for mark, *name in expected:
        best[mark] = min(best.get(mark, tuple(name)), tuple(name))
    side = J._sides(rows).toPandas()
    company = J.Company(side)
    found, lists = J.candidate_lists(company)
    told = {md5(company.id[own]): (-c.score, c.key, c.type) for c, own in zip(found.itertuples(), lists)}
    assert tracks and told == best and len(found) == len(best) == found["group_id"].nunique() and all((own[1:] > own[:-1]).all() for own in lists)
    rows.unpersist()


def test_lists_are_not_shuffled(spark):
    rows = E.detection_rows(ledger(spark, random_ledger(5)))
    facts = J.candidate_facts(J.numbered(materialise(rows, "rows")))
    assert facts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = E.detect_recurrences(ledger(spark, random_ledger(5)))
    assert found.count() == found.where(F.col("n") == F.size("transaction_ids")).count() > 0
    lines = found.select("suggestion_id", "n")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(lines) if "Window" in line)
    assert "transaction_ids" not in lines[window + 1]
