"""Consolidation of recurrence suggestions: families, equivalence, keys, greedy merging and state changes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import economic_tokens
from ledgerloom.plans.scratch import materialise

from .components import connected_components
from .recurrence import by_company

OVERLAP, SEMANTIC_OVERLAP, MATERIAL = 0.7, 0.5, 5


def economic_description(normalized: Column, description: Column) -> Column:
    return F.array_join(economic_tokens(F.coalesce(F.nullif(normalized, F.lit("")), description)), " ")


def pattern_family(kind: Column, frequency: Column, installments: Column, text: Column) -> Column:
    """installment, weekly, biweekly (with frequent suppliers), monthly (with recurring income) or irregular."""
    marked = F.coalesce(text.rlike(r"(?i)\b(parc|parcela|parcelado|parcelamento)\b"), F.lit(False))
    is_ = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    return (
        F.when(is_("installment") | F.coalesce(installments > 0, F.lit(False)) | marked, "installment").when((frequency == "weekly") | is_("weekly_recurring"), "weekly")
        .when((frequency == "biweekly") | is_("biweekly_recurring", "frequent_supplier"), "biweekly")
        .when((frequency == "monthly") | is_("monthly_fixed", "monthly_variable", "recurring_income"), "monthly").otherwise("irregular")
    )


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def amounts_fit(a: Column, b: Column, variation_a: Column, variation_b: Column) -> Column:
    """Relative to the larger, at most 12 %, or the larger observed variation up to 30 %."""
    a, b = F.abs(a), F.abs(b)
    allowed = F.greatest(F.lit(0.12), F.least(F.greatest(variation_a, variation_b) / 100, F.lit(0.3)))
    return F.when((a == 0) | (b == 0), a == b).otherwise(F.abs(a - b) / F.greatest(a, b) <= allowed)


def phase_distance(a: Column, b: Column) -> Column:
    """Days between two days of the month, round the end of a month of 31 days."""
    return F.least(F.abs(a - b), 31 - F.abs(a - b))


def is_internal_transfer(text: Column) -> Column:
    named = [F.lit(w) for w in ("interna", "entre", "contas")]
    return F.size(F.array_intersect(economic_tokens(text), F.array(*named))) == len(named)


def described(suggestions: DataFrame) -> DataFrame:
    """Adds family, economy (the economic description) and internal to suggestions.

    ``suggestions``: id, company_id, type, accounts, frequency, recurrence_type, pattern_kind, installment_count,
    normalized_description, description, average_amount, variation_percent, confidence, transaction_ids, phase, span.
    """
    text = F.concat_ws(" ", "normalized_description", "description")
    return suggestions.select(
        "*", pattern_family(F.col("pattern_kind"), F.col("frequency"), F.col("installment_count"), text).alias("family"),
        economic_description(F.col("normalized_description"), F.col("description")).alias("economy"), is_internal_transfer(text).alias("internal"),
    )


def side_of(side: str | Callable[[str], Column]) -> Callable[[str], Column]:
    """The columns of one of two suggestions: a prefix of columns, or a function that gives them."""
    return side if callable(side) else lambda c: F.col(f"{side}{c}")


def same_identity(l: str | Callable, r: str | Callable) -> Column:  # noqa: E741
    x, y = side_of(l), side_of(r)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    contained = overlap_coefficient(words(x("economy")), words(y("economy"))) >= 0.8
    return (x("recurrence_type") == y("recurrence_type")) & ((x("economy") == y("economy")) | contained) & amounts_fit(x("average_amount"), y("average_amount"), x("variation_percent"), y("variation_percent"))


def equivalent(l: str, r: str) -> Column:  # noqa: E741
    """Whether two described suggestions of one company, type and account set are the same series."""
    x, y = lambda c: F.col(f"{l}{c}"), lambda c: F.col(f"{r}{c}")
    overlap = overlap_coefficient(x("transaction_ids"), y("transaction_ids"))
    phases = ~x("family").isin("monthly", "installment") | F.coalesce(phase_distance(x("phase"), y("phase")) <= 5, F.lit(True))
    income = F.coalesce((x("pattern_kind") == "recurring_income") & (y("pattern_kind") == "recurring_income"), F.lit(False))
    plain = x("pattern_kind").isNull() | y("pattern_kind").isNull()
    across = (income | plain) & same_identity(l, r) & (overlap >= F.when(plain, SEMANTIC_OVERLAP).otherwise(OVERLAP))
    return F.when(x("family") != y("family"), across).otherwise((same_identity(l, r) & phases) | (overlap > OVERLAP))


SCOPE = ["company_id", "type", "accounts"]
#: Two economic descriptions are one when they share this part of the words of the shorter one.
CONTAINED = 0.8


def shared_rows(rows: DataFrame) -> DataFrame:
    """(SCOPE, key, id): the rows (``key``) that two suggestions or more hold, with each that does. Suggestions are shuffled
    by company before they are spread over their rows."""

    def of(own: DataFrame) -> DataFrame:
        held = own.select(*SCOPE, "id", F.explode(F.array_distinct("transaction_ids")).alias("key")).where("key is not null")
        return held.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SCOPE, "key"))).where("_n > 1").drop("_n")

    return by_company(rows.select(*SCOPE, "id", "transaction_ids"), of)


def shared_pairs(rows: DataFrame, by_row: DataFrame) -> DataFrame:
    """(SCOPE, left_id, right_id): pairs of described suggestions that may be equivalent or alike.

    Such a pair shares a row, or has one identity and so most words of the shorter description. Rows meet in an inverted
    index; words by a prefix filter: of n words, rarest first, the shorter one has to share one of the first
    ``n - 0.8 n + 1``. Descriptions without words may be alike among themselves. Identity is judged where words meet, so
    only pairs that have it are joined with whole suggestions. ``by_row``: ``shared_rows(rows)``.
    """
    identity = ["recurrence_type", "economy", "average_amount", "variation_percent"]
    words = rows.select(*SCOPE, "id", *identity, F.filter(F.split("economy", " "), lambda w: w != "").alias("words"))
    each = words.select(*SCOPE, "id", *identity, F.size("words").alias("n"), F.explode("words").alias("key"))
    common = each.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy(*SCOPE, "key")))
    ranked = common.withColumn("place", F.row_number().over(Window.partitionBy(*SCOPE, "id").orderBy("often", "key")))
    first = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * CONTAINED) + 1)
    side = lambda frame, p, *more: frame.select(*SCOPE, "key", *[F.col(c).alias(p + c) for c in ("id", *more)])
    met = side(by_row, "l_").join(side(by_row, "r_"), [*SCOPE, "key"]).where("l_id < r_id")
    worded = side(first, "l_", "n", *identity).join(side(ranked, "r_", "n", *identity), [*SCOPE, "key"]).where("l_id <> r_id and l_n <= r_n").where(same_identity("l_", "r_"))
    blank = words.where(F.size("words") == 0).withColumn("key", F.lit(""))
    empty = side(blank, "l_", *identity).join(side(blank, "r_", *identity), [*SCOPE, "key"]).where("l_id < r_id").where(same_identity("l_", "r_"))
    pairs = met.select(*SCOPE, "l_id", "r_id").unionByName(worded.select(*SCOPE, "l_id", "r_id")).unionByName(empty.select(*SCOPE, "l_id", "r_id"))
    return pairs.select(*SCOPE, F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id")).distinct()


def judged_pairs(rows: DataFrame, by_row: DataFrame) -> DataFrame:
    """(SCOPE, left_id, right_id, equal, alike) of the pairs of described suggestions that are one or both; ``by_row``: ``shared_rows(rows)``."""
    side = lambda p, name: rows.select(*SCOPE, F.col("id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in rows.columns if c not in SCOPE])
    both = shared_pairs(rows, by_row).join(side("l_", "left_id"), [*SCOPE, "left_id"]).join(side("r_", "right_id"), [*SCOPE, "right_id"])
    return both.select(*SCOPE, "left_id", "right_id", equivalent("l_", "r_").alias("equal"), same_identity("l_", "r_").alias("alike")).where("equal or alike")


def equivalence_pairs(suggestions: DataFrame) -> DataFrame:
    """Pairs of equivalent suggestions of one company, type and account set."""
    rows = materialise(described(suggestions), "described")
    return judged_pairs(rows, materialise(shared_rows(rows), "shared-rows")).where("equal").select("company_id", "left_id", "right_id")


def logical_key(rows: DataFrame) -> Column:
    """The key under which a described suggestion is found again on the next run."""
    parts = F.concat_ws("|", F.lit("recurrence-logical-v3"), "company_id", "accounts", "type", "family", "economy", F.coalesce(F.col("phase").cast("string"), F.lit("no-phase")))
    return F.concat(F.lit("recurrence:v3:"), F.left(F.sha2(parts, 256), F.lit(24)))


class _Group:
    """The suggestions of one component, and what is known about each pair of them."""

    def __init__(self, rows: list[dict], equal: set[tuple[str, str]], like: set[tuple[str, str]]):
        self.rows, self.equal, self.like = {r["id"]: r for r in rows}, equal, like
        self.ids = {r["id"]: set(r["transaction_ids"]) for r in rows}

    def order(self, ids):
        return sorted(ids, key=lambda i: (-self.rows[i]["confidence"], -len(self.rows[i]["transaction_ids"]), i))

    def is_equal(self, a: str, b: str) -> bool:
        return (min(a, b), max(a, b)) in self.equal

    def is_like(self, a: str, b: str) -> bool:
        return (min(a, b), max(a, b)) in self.like

    def better(self, a: str, b: str) -> str:
        """The suggestion of higher quality; which trait decides depends on the pair."""
        x, y = self.rows[a], self.rows[b]
        size, confidence = len(y["transaction_ids"]) - len(x["transaction_ids"]), y["confidence"] - x["confidence"]
        phases = x["phase"] is None or y["phase"] is None or x["family"] not in ("monthly", "installment") or min(abs(x["phase"] - y["phase"]), 31 - abs(x["phase"] - y["phase"])) <= 5
        series = x["family"] == y["family"] and self.is_like(a, b) and phases
        income = "recurring_income" in (x["pattern_kind"], y["pattern_kind"])
        if series and abs(confidence) < MATERIAL and size:
            decision = size
        elif (x["family"] != y["family"] and not income and confidence) or abs(confidence) >= MATERIAL:
            decision = confidence
        else:
            decision = size or confidence or (y["span"] - x["span"]) or (-1 if a < b else 1)
        return a if decision <= 0 else b

    def covered(self, s: str, kept: list[str]) -> bool:
        """Whether kept suggestions leave nothing new in ``s``."""
        own, mine = self.ids[s], self.rows[s]
        scoped = [k for k in kept if own & self.ids[k]]
        words = lambda i: set(self.rows[i]["economy"].split())
        for k in scoped:
            a, b = words(k), words(s)
            contained = len(a & b) / min(len(a), len(b)) if a and b else 0.0
            if self.rows[k]["confidence"] - mine["confidence"] >= MATERIAL and contained >= 0.8 and len(own & self.ids[k]) / min(len(own), len(self.ids[k])) >= SEMANTIC_OVERLAP:
                return True
        cadence = lambda f: "monthly" if f == "installment" else f
        paced = [k for k in scoped if cadence(self.rows[k]["family"]) == cadence(mine["family"])]
        share = lambda ks: len(own & set().union(*[self.ids[k] for k in ks])) / max(len(own), 1) if ks else 0.0
        if not paced:
            return False
        return share([k for k in paced if self.rows[k]["family"] == mine["family"]]) > OVERLAP or (len(paced) > 1 and share(paced) > OVERLAP) or (len(scoped) > 1 and share(scoped) > OVERLAP)

    def consolidate(self) -> list[str]:
        kept: list[str] = []
        for s in self.order(self.rows):
            same = [k for k in kept if self.is_equal(s, k)]
            income = lambda a, b: self.rows[a]["pattern_kind"] == self.rows[b]["pattern_kind"] == "recurring_income" and self.is_like(a, b)
            if any(not (self.is_equal(a, b) or income(a, b)) for i, a in enumerate(same) for b in same[i + 1 :]):
                continue  # it would bridge distinct series
            best = s
            for k in same:
                best = self.better(best, k)
            kept = [k for k in kept if k not in same] + [best]
        final: list[str] = []
        for s in self.order(kept):
            if not self.covered(s, final):
                final.append(s)
        return final


def consolidate(suggestions: DataFrame) -> DataFrame:
    """The ids of the suggestions that stay, by company.

    Merging is greedy and depends on the order. A step looks at suggestions that are equivalent to the one at hand and at
    those that share rows with it, so what is linked by such pairs, a connected component, is worked on by itself; what a
    company, type and account set holds besides plays no part. Pairs come from inverted indexes, families from joins.
    """
    # Filtered after they are written: Spark would ask the question of every row behind a suggestion, before it is grouped.
    rows = materialise(described(suggestions), "described").where("not internal")
    index = materialise(shared_rows(rows), "shared-rows")
    judged = materialise(judged_pairs(rows, index), "equivalences")
    # A row links all its suggestions to the first of them.
    sharing = index.withColumn("left_id", F.min("id").over(Window.partitionBy(*SCOPE, "key"))).where("left_id < id").select("left_id", F.col("id").alias("right_id"))
    edges = judged.where("equal").select("left_id", "right_id").unionByName(sharing).distinct()
    parts = connected_components(edges, "left_id", "right_id").withColumnRenamed("node", "id")
    # A suggestion without links stays; only the others are gathered.
    alone = rows.select("company_id", "id").join(parts, "id", "left_anti")
    named = rows.join(parts, "id")
    own = named.groupBy("component").agg(F.first("company_id").alias("company_id"), F.collect_list(F.struct("id", "confidence", "transaction_ids", "phase", "family", "pattern_kind", "economy", "span")).alias("rows"))
    links = judged.join(parts.select(F.col("id").alias("left_id"), "component"), "left_id").groupBy("component").agg(F.collect_list(F.struct("left_id", "right_id", "equal", "alike")).alias("links"))

    def run(batches):
        for batch in batches:
            out = []
            for company, items, found in zip(batch["company_id"], batch["rows"], batch["links"]):
                found = [] if found is None else list(found)
                equal = {(p["left_id"], p["right_id"]) for p in found if p["equal"]}
                alike = {(p["left_id"], p["right_id"]) for p in found if p["alike"]}
                out += [(company, i) for i in _Group([dict(r) for r in items], equal, alike).consolidate()]
            yield pd.DataFrame(out, columns=["company_id", "id"]).astype("object")

    merged = own.join(links, "component", "left").select("company_id", "rows", "links").mapInPandas(run, "company_id string, id string")
    return alone.select("company_id", "id").unionByName(merged)


def stale(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored suggestions still waiting whose key the whole-company run did not find again: to be superseded."""
    return stored.where("status in ('pending', 'edited')").join(found.select("company_id", "dedup_key"), ["company_id", "dedup_key"], "left_anti")


#: Fixed values: (action, status before, status after).
TRANSITIONS = [("approve", "pending", "approved"), ("approve", "edited", "approved"), ("reject", "pending", "rejected"), ("reject", "edited", "rejected"), ("edit", "pending", "edited"), ("edit", "edited", "edited")]


def transition(suggestions: DataFrame, actions: DataFrame) -> DataFrame:
    """Statuses after actions (suggestion_id, action); an action that the status does not allow leaves it and sets error."""
    allowed = F.create_map(*[x for action, before, after in TRANSITIONS for x in (F.lit(f"{action}:{before}"), F.lit(after))])
    joined = suggestions.join(actions, "suggestion_id", "left")
    new = F.try_element_at(allowed, F.concat_ws(":", "action", "status"))
    asked = F.col("action").isNotNull()
    return joined.withColumn("error", F.when(asked & new.isNull(), "not_allowed")).withColumn("status", F.when(asked, F.coalesce(new, F.col("status"))).otherwise(F.col("status")))
