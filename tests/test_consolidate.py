"""Consolidation by components against the greedy choice over whole companies."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import consolidate as K

from .test_recurrence import CONSOLIDATED


def suggestions(spark, seed, n, companies=3):
    r = random.Random(seed)
    words = ["aluguel", "sala", "internet", "fibra", "energia", "agua", "limpeza", "contador"]
    rows = []
    for i in range(n):
        company = r.randint(1, companies)
        text = " ".join(r.sample(words, r.randint(0, 4)))
        ids = [f"t{company}-{x}" for x in sorted(r.sample(range(40), r.randint(2, 7)))]
        kind = r.choice(["monthly_fixed", "monthly_variable", "recurring_income", "weekly_recurring", None])
        rows.append((f"s{i:04d}", f"c{company}", "expense", "a", r.choice(["monthly", "weekly", "unknown"]), r.choice(["fixed", "variable"]), kind, None, text, text.upper(), -float(r.choice([100, 105, 120, 400])), 10.0, r.randint(60, 95), ids, r.choice([1, 5, 9, 28, None]), r.randint(30, 200)))
    return spark.createDataFrame(rows, CONSOLIDATED)


def over_whole_companies(frame):
    rows = K.described(frame).where("not internal").cache()
    side = lambda p: rows.select(*K.SCOPE, *[F.col(c).alias(f"{p}{c}") for c in rows.columns if c not in K.SCOPE])
    pairs = side("l_").join(side("r_"), K.SCOPE).where("l_id < r_id").select("company_id", "l_id", "r_id", K.equivalent("l_", "r_").alias("equal"), K.same_identity("l_", "r_").alias("alike")).collect()
    kept = set()
    by = {}
    for r in rows.collect():
        by.setdefault(r.company_id, []).append(r.asDict())
    for company, own in by.items():
        found = [p for p in pairs if p.company_id == company]
        kept |= set(K._Group(own, {(p.l_id, p.r_id) for p in found if p.equal}, {(p.l_id, p.r_id) for p in found if p.alike}).consolidate())
    rows.unpersist()
    return kept, {(p.l_id, p.r_id) for p in pairs if p.equal}


def test_components_give_what_whole_companies_give(spark):
    for seed in range(2):
        frame = suggestions(spark, seed, 120)
        kept, equal = over_whole_companies(frame)
        assert {r.id for r in K.consolidate(frame).collect()} == kept
        assert {(r.left_id, r.right_id) for r in K.equivalence_pairs(frame).collect()} == equal and equal


def test_consolidation_of_nothing(spark):
    assert K.consolidate(suggestions(spark, 1, 0)).count() == 0


def test_thousands_of_suggestions_of_one_company(spark):
    """Five thousand series of their own, each twice: of each two the longer stays."""
    rows = [(f"s{i:05d}{half}", "c", "expense", "a", "monthly", "fixed", "monthly_fixed", None, f"payee{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} servico", "X", -100.0 - i, 0.0, 80, [f"t{i}-{k}" for k in range(3 + half)], 5, 90) for i in range(2500) for half in (0, 1)]
    assert sorted(r.id for r in K.consolidate(spark.createDataFrame(rows, CONSOLIDATED)).collect()) == sorted(r[0] for r in rows if r[0].endswith("1"))


def test_internal_transfers_are_told_after_grouping(spark, monkeypatch):
    plans, write = {}, K.materialise

    def noted(frame, name):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return write(frame, name)

    monkeypatch.setattr(K, "materialise", noted)
    rows = [("a", 1), ("b", 1), ("a", 2), ("c", 3)]
    ledger = spark.createDataFrame(rows, "text string, k int").groupBy("text").agg(F.collect_list(F.col("k").cast("string")).alias("ids"))
    frame = suggestions(spark, 1, 1).drop("id", "normalized_description", "transaction_ids").crossJoin(ledger.select(F.col("text").alias("id"), F.concat("text", F.lit(" interna entre contas")).alias("normalized_description"), F.col("ids").alias("transaction_ids")))
    assert K.consolidate(frame).count() == 0
    below = plans["described"].split("Aggregate", 1)[1]
    assert "array_intersect" in plans["described"] and not any(f in below for f in ("array_intersect", "array_contains"))


def test_words_without_an_identity_make_no_pairs(spark):
    """Each of 40 descriptions shares a word with others, and none has most of its words."""
    rows = [(f"s{i:02d}", "c", "expense", "a", "monthly", "fixed", None, None, f"sala{i % 8} casa{i // 8}", "X", -100.0, 0.0, 80, [f"t{i}", f"u{i // 39}"], 5, 90) for i in range(40)]
    described = K.described(spark.createDataFrame(rows, CONSOLIDATED)).cache()
    found = K.shared_pairs(described, K.shared_rows(described))
    assert found.count() == 39 * 38 / 2  # those of the row u0, by which all but the last meet
    assert K.shared_pairs(described, K.shared_rows(described).where("false")).count() == 0
