"""Detection over identity candidates against a plain version, on the acceptance statement and on random ledgers."""

import itertools
import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import detect as E
from ledgerloom.operators import recurrence as R
from ledgerloom.operators import series as G
from ledgerloom.operators import trimming as T
from ledgerloom.functions.similarity import text_similarity

from .demo import statement
from .test_recurrence import SCHEMA, ledger


def difference(a, b):
    return 0 if a + b == 0 else abs(a - b) / ((a + b) / 2)


def last(d):
    return (d + timedelta(days=1)).month != d.month


def months(a, b):
    return (b.year - a.year) * 12 + b.month - a.month


def monthly(a, b):
    return 25 <= (b - a).days <= 35 or (months(a, b) == 1 and abs(a.day - b.day) <= 5)


def period(dates):
    """(score, share of monthly gaps, consistency) of distinct dates."""
    days = sorted(set(dates))
    if len(days) < 2:
        return 0.0, 0.0, 0.0
    evidence = [1.0 if monthly(a, b) else 0.75 if 2 <= months(a, b) <= 3 and (a.day == b.day or (last(a) and last(b))) else 0.0 for a, b in itertools.pairwise(days)]
    ratio = sum(evidence) / len(evidence)
    middle = sorted(d.day for d in days)[len(days) // 2]
    steady = min(1.0, max(0.0, 1 - sum(abs(d.day - middle) for d in days) / len(days) / 5))
    score = 0.7 * ratio + 0.3 * steady
    if len(days) == 2:
        score = min(score, 0.62 if evidence[0] == 1.0 else 0.2)
    return score, ratio, steady


def candidates(rows):
    keyed = defaultdict(list)
    for r in rows:
        prefix, d = (r.company_id, r.type), r.distinctive
        document = "".join(c for c in r.document_number or "" if c.isdigit())
        names = [("document:" + document, 0.98)] if document else []
        names += [("counterparty:" + r.normalized_counterparty, 0.95)] if r.normalized_counterparty else []
        names += [("description:" + r.normalized_description, 0.92)] if r.normalized_description and d else []
        names += [(f"tokens:{a}+{b}", 0.88) for a, b in itertools.combinations(d, 2)] + [("token:" + t, 0.72) for t in d]
        for name, score in names:
            keyed[(*prefix, name, score)].append(r)
    found = []
    for (company, _, name, score), own in keyed.items():
        if len(own) >= 3:
            found.append((company, score, name, own, False))
        for anchor in own if len(own) >= 5 else ():
            lanes = [x for x in own if abs(x.date.day - anchor.date.day) <= 3], [x for x in own if difference(x.abs_amount, anchor.abs_amount) <= 0.35]
            found += [(company, score, f"{name}", lane, False) for lane in lanes if 3 <= len(lane) < len(own)]
    income = [r for r in rows if r.type == "income"]
    for anchor in income:
        near = [r for r in income if r.company_id == anchor.company_id and abs(r.date.day - anchor.date.day) <= 2 and difference(r.abs_amount, anchor.abs_amount) <= 0.55]
        counts = Counter(r.normalized_description for r in near)
        best = {}
        for r in sorted(near, key=lambda r: (-counts[r.normalized_description], difference(r.abs_amount, anchor.abs_amount), r.date, r.id)):
            best.setdefault((r.date.year, r.date.month), r)
        if len(best) >= 4:
            found.append((anchor.company_id, 0.68, "track:" + anchor.id, list(best.values()), True))
    chosen = {}
    for company, score, name, own, track in sorted(found, key=lambda x: (-x[1], x[2])):
        chosen.setdefault((company, frozenset(r.id for r in own)), (score, name, sorted(own, key=lambda r: (r.date, r.id)), track))
    return chosen.values()


def trim(group, like):
    while len(group) >= 4:
        base, best = period([r.date for r in group])[0], None
        for r in group:
            others = [x for x in group if x.id != r.id]
            gain = period([x.date for x in others])[0] - base
            if sum(like[r.id, x.id] for x in others) / len(others) < 0.35 and gain >= 0.1 and (best is None or gain > best[0]):
                best = gain, r
        if best is None:
            break
        group = [x for x in group if x.id != best[1].id]
    return group


def mean(values):
    return sum(values) / len(values)


def rivals(group):
    if len(group) < 4:
        return False
    cores = defaultdict(list)
    for r in group:
        for t in r.distinctive:
            cores[t].append(r)
    steady = lambda own: (m := mean([r.abs_amount for r in own])) == 0 or math.sqrt(mean([(r.abs_amount - m) ** 2 for r in own])) / m <= 0.25
    for a, b in itertools.combinations([c for c in cores.values() if 2 <= len(c) <= 0.7 * len(group)], 2):
        if {r.id for r in a} & {r.id for r in b} or len(a) + len(b) < 0.7 * len(group):
            continue
        if steady(a) and steady(b) and difference(mean([r.abs_amount for r in a]), mean([r.abs_amount for r in b])) >= 0.25:
            return True
        if abs(mean([r.date.day for r in a]) - mean([r.date.day for r in b])) >= 6:
            return True
    return False


def pattern(group):
    """(kind, frequency, score) of the first pattern that a group fits."""
    dates, income = sorted({r.date for r in group}), group[0].type == "income"
    gaps = [(b - a).days for a, b in itertools.pairwise(dates)]
    totals = [r.total for r in group if r.total is not None]
    if len(totals) >= 2 and len(totals) == len(group):
        total, k = max(Counter(totals).items(), key=lambda x: x[1])
        if total and k >= 2:
            return "installment", "monthly", 0.9
    score = period(dates)[0]
    if score >= 0.55:
        amounts = [r.abs_amount for r in group]
        variation = (max(amounts) - min(amounts)) / mean(amounts) * 100 if mean(amounts) else 0
        return "recurring_income" if income else "monthly_fixed" if variation <= 5 else "monthly_variable", "monthly" if period(dates)[1] >= 0.5 else "unknown", score
    if len(dates) < 4:
        return None
    weekly, biweekly = (sum(a <= g <= b for g in gaps) / len(gaps) for a, b in ((5, 9), (11, 17)))
    if max(weekly, biweekly) >= 0.6:
        name = "weekly" if weekly >= biweekly else "biweekly"
        return "recurring_income" if income else name + "_recurring", name, min(1, 0.5 + max(weekly, biweekly) * 0.45)
    middle = sorted(gaps)[len(gaps) // 2] if len(gaps) % 2 else mean(sorted(gaps)[len(gaps) // 2 - 1 : len(gaps) // 2 + 1])
    regular = sum(middle * 0.55 <= g <= middle * 1.45 for g in gaps) / len(gaps)
    if len({(d.year, d.month) for d in dates}) >= 3 and 5 <= middle <= 60 and regular >= 0.6:
        kind = "recurring_income" if income else "frequent_supplier" if middle <= 35 else "irregular_business_recurring"
        return kind, "unknown", min(1, 0.48 + regular * 0.35 + min(0.12, len(dates) * 0.015))
    return None


def stable(group):
    documents = ["".join(c for c in r.document_number or "" if c.isdigit()) for r in group]
    parties = [r.normalized_counterparty for r in group]
    return any(all(x) and len(set(x)) == 1 for x in (documents, parties))


def contradicted(group, rows, grounds):
    score, ratio, steady = period([r.date for r in group])
    if (len(group) >= 4 and score >= 0.9 and steady >= 0.8) or any(r.marked for r in group) or stable(group):
        return False
    own = {r.id for r in group}
    outside = [x for x in rows if x.id not in own and (x.company_id, x.type) == (group[0].company_id, group[0].type) and any(difference(x.abs_amount, r.abs_amount) <= 0.35 and grounds[x.id] & grounds[r.id] for r in group)]
    if not outside:
        return False
    wider = period([r.date for r in group + outside])
    return len(outside) >= 2 and wider[0] < 0.55 and score - wider[0] >= 0.25


def plain(rows, like, grounds):
    """{ids: (kind, frequency, confidence)} of all candidates that are suggestions."""
    found = {}
    for identity, name, group, track in candidates(rows):
        group = group if track else trim(group, like)
        if len(group) < 3 or rivals(group) or not (got := pattern(group)):
            continue
        if got[0] in ("weekly_recurring", "biweekly_recurring"):
            days = 7 if got[0] == "weekly_recurring" else 14
            near = lambda a, b: (off := abs((a.date - b.date).days) % days) <= 2 or days - off <= 2  # noqa: E731, B023
            best = max(([x for x in group if near(a, x)] for a in group), key=len)
            if 4 <= len(best) < len(group):
                group = best
                if not (got := pattern(group)):
                    continue
        kind, frequency, score = got
        n, is_monthly = len(group), frequency == "monthly"
        if kind != "installment":
            text, shape = (len({r[c] for r in group}) / n for c in ("normalized_description", "shape"))
            if n < 4 if is_monthly else kind not in ("weekly_recurring", "biweekly_recurring") and n < 6:
                continue
            if is_monthly and (len({(r.date.year, r.date.month) for r in group}) < n or (all(r.episodic for r in group) and not stable(group))):
                continue
            if identity <= 0.72 and (text > 0.6 or shape > 0.75 or tainted(group, name)):
                continue
            if identity < 0.95 and text <= 0.25 and shape > 0.6:
                continue
        if is_monthly and contradicted(group, rows, grounds):
            continue
        amounts = [r.abs_amount for r in group]
        variation = (max(amounts) - min(amounts)) / mean(amounts) * 100 if mean(amounts) else 0
        amount = next(s for top, s in ((5, 1), (15, 0.8), (30, 0.55), (50, 0.35), (1e99, 0.1)) if variation <= top)
        categories = Counter(r.category_id for r in group if r.category_id is not None)
        category = max(categories.values()) / n if categories else 0.5
        p, i, a, c, o = (30, 30, 25, 5, 10) if kind in ("monthly_fixed", "installment") else (30, 35, 5, 5, 25) if kind in ("monthly_variable", "recurring_income") else (35, 35, 5, 5, 20)
        total = math.floor(score * p + identity * i + amount * a + category * c + {3: 0.75}.get(n, 1.0) * o + 0.5)
        if total >= 60:
            ids = tuple(sorted(r.id for r in group))
            found[ids] = max(found.get(ids, (0,)), (total, kind, frequency))
    return found


def tainted(group, name):
    if not name.startswith("token:"):
        return False
    core = name.removeprefix("token:")
    counts = Counter(t for r in group for t in r.distinctive if t != core)
    often = sorted((-k, t) for t, k in counts.items() if 0.6 * len(group) <= k < len(group))
    return bool(often) and any((second := [t for t in r.distinctive if t != core]) and often[0][1] not in second for r in group)


def random_ledger(seed):
    r = random.Random(seed)
    names = ["ACME CLOUD", "ACME PAPEL", "SOLAR ALUGUEL", "VIVO FIBRA", "MERCADO SOL", "COMPRA LOJA AZUL", "CURSO PARCELA"]
    rows = []
    for s in range(9):
        name, start, step, amount, sign = r.choice(names), date(2025, 1, r.randint(1, 28)), r.choice([7, 14, 30, 30, 30, 45]), r.choice([100, 130, 480, 2000]), r.choice([-1, -1, 1])
        for k in range(r.randint(3, 9)):
            day = start + timedelta(days=step * k + r.choice([0, 0, 0, 1, -1, 9]))
            text = f"{name} {k + 1}/6" if "PARCELA" in name else f"{r.choice(['', '', 'PAGTO '])}{name}{r.choice(['', '', ' NORTE'])}"
            rows.append((f"t{s}-{k}", day, text, float(sign * amount * r.choice([1, 1, 1, 1.1, 1.5]))))
    return rows


@pytest.mark.parametrize("make", [statement, lambda: random_ledger(1), lambda: random_ledger(2), lambda: random_ledger(3)])
def test_patterns_equal_a_plain_version(spark, make):
    rows = E.detection_rows(ledger(spark, make()).withColumn("category_id", F.when(F.col("id") > "t3", F.lit("k")).otherwise(F.col("category_id")))).cache()
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", *T.TEXT)])
    like = {(r.l_id, r.r_id): r.s for r in side("l_").join(side("r_")).select("l_id", "r_id", text_similarity("l_", "r_").alias("s")).collect()}
    grounds = {r.id: {g["ground"] for g in r.g if g["how"] == R.AT_ONCE and not g["ground"].startswith("v:")} for r in rows.select("id", R.row_grounds(rows).alias("g")).collect()}
    expected = plain(rows.collect(), like, grounds)
    found = {}
    for r in E.pattern_suggestions(rows).collect():
        ids = tuple(sorted(r.transaction_ids))
        found[ids] = max(found.get(ids, (0,)), (r.confidence, r.pattern_kind, r.frequency))
    rows.unpersist()
    assert expected and found == expected


def test_trimming_equals_the_plain_loop(spark):
    r = random.Random(4)
    rows = [(f"t{g}-{k}", date(2025, 1 + k, 5) if k < 6 else date(2025, 1, 1) + timedelta(days=r.randint(0, 300)), r.choice(["ACME CLOUD", "ACME CLOUD", "OUTRO NOME", "TERCEIRO PAGTO"]), -10.0 * (g + 1)) for g in range(12) for k in range(r.randint(3, 9))]
    frame = E.detection_rows(ledger(spark, rows)).cache()
    side = lambda p: frame.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", *T.TEXT)])
    like = {(r.l_id, r.r_id): r.s for r in side("l_").join(side("r_")).select("l_id", "r_id", text_similarity("l_", "r_").alias("s")).collect()}
    groups = defaultdict(list)
    for row in sorted(frame.collect(), key=lambda x: (x.date, x.id)):
        groups[row.id.split("-")[0]].append(row)
    members = frame.select(F.split("id", "-")[0].alias("g"), "id")
    kept = defaultdict(set)
    for row in T.without_outliers(members, frame, ["g"]).collect():
        kept[row.g].add(row.id)
    frame.unpersist()
    expected = {g: {x.id for x in trim(own, like)} for g, own in groups.items()}
    assert dict(kept) == expected and any(len(expected[g]) < len(groups[g]) for g in groups)


def test_a_row_of_many_dates_never_goes():
    r = random.Random(6)
    for _ in range(300):
        days = sorted({date(2020, 1, 1) + timedelta(days=30 * k + r.choice([0, 0, 0, 1, 12])) for k in range(T.MOST_DATES + 1 + r.randint(0, 30))})
        if len(days) > T.MOST_DATES:
            x = T.Days(days)
            assert (x.scores_without() - x.score()).max() < T.LEAST_GAIN
            assert abs(x.score() - period(days)[0]) < 1e-9


def test_cadence_track_has_no_self_join(spark):
    frame = ledger(spark, [(f"t{k}", date(2025, 1, 1) + timedelta(days=d), "X", -1.0) for k, d in enumerate([0, 7, 14, 16, 24, 29, 36, 40])])
    assert {r.id for r in G.cadence_track(frame, ["company_id"], 7).collect()} == {"t0", "t1", "t2", "t3", "t5", "t6", "t7"}


def test_candidates_of_nothing(spark):
    found, members = E.identity_candidates(E.detection_rows(spark.createDataFrame([], SCHEMA)))
    assert found.count() == members.count() == 0
