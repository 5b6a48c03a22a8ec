"""Stored suggestions and what changes them: new runs, approvals and status changes, as joins of state and changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.plans.scratch import materialise

from . import consolidate as K

SCOPE = ["company_id", "type", "accounts"]
#: Columns that a run may refresh.
FIELDS = ["frequency", "recurrence_type", "pattern_kind", "installment_count", "normalized_description", "description", "average_amount", "variation_percent", "confidence", "phase", "span"]
#: From this confidence on a review item is urgent.
URGENT = 85


def is_better(a: str | Callable, b: str | Callable) -> Column:
    """Whether suggestion ``a`` (a prefix, or a function that gives its columns) is of higher quality than ``b``: rows decide between two of
    one series with near confidences, confidence between families or where it differs much, else rows, confidence, span."""
    x, y = K.side_of(a), K.side_of(b)
    rows, confidence = F.size(x("transaction_ids")) - F.size(y("transaction_ids")), x("confidence") - y("confidence")
    phases = ~x("family").isin("monthly", "installment") | F.coalesce(K.phase_distance(x("phase"), y("phase")) <= 5, F.lit(True))
    series = (x("family") == y("family")) & K.same_identity(a, b) & phases
    income = (F.coalesce(x("pattern_kind"), F.lit("")) == "recurring_income") | (F.coalesce(y("pattern_kind"), F.lit("")) == "recurring_income")
    then = F.coalesce(F.nullif(rows, F.lit(0)), F.nullif(confidence, F.lit(0)), F.nullif(x("span") - y("span"), F.lit(0)), F.when(x("id") < y("id"), 1).otherwise(-1))
    decided = F.when(series & (F.abs(confidence) < K.MATERIAL) & (rows != 0), rows).when((F.abs(confidence) >= K.MATERIAL) | ((x("family") != y("family")) & ~income & (confidence != 0)), confidence)
    return decided.otherwise(then) > 0


def persisted(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored suggestions after a run; adds ``change``: created, refreshed, reactivated, superseded, or null.

    ``found``: suggestions as ``consolidate.described`` takes them. ``stored``: the same columns, status, approved and
    dedup_key. A found suggestion meets the stored ones (pending, edited, approved, superseded) of its company, type and
    accounts that are equivalent to it. Of these the approved one stands for it, else an edited one, else one that is not
    superseded; of several in one state the better of two, taken one after the other by id. It gains the found rows; one that was
    superseded waits again; its fields change only while it waits, is not approved and the found one is better. Other
    equivalents that wait are superseded. Without an equivalent the found one is stored under its logical key, with its own
    id added where that key is taken. Of several found ones for one stored or key, the most confident counts, then the
    smallest id; their rows are all added.
    """
    new, old = materialise(K.described(found), "found-suggestions"), materialise(K.described(stored), "stored-suggestions")
    stored = old.select(*stored.columns)
    side = lambda rows, p: rows.select(*SCOPE, *[F.col(c).alias(f"{p}{c}") for c in rows.columns if c not in SCOPE])
    live = old.where(F.col("status").isin("pending", "edited", "approved", "superseded"))
    pairs = side(new, "l_").join(side(live, "r_"), SCOPE).where(K.equivalent("l_", "r_"))
    approved = F.coalesce(F.col("r_approved"), F.lit(False)) | (F.col("r_status") == "approved")
    # Approved ones come first, of several the first by id; then edited ones, then those not superseded. Within a class
    # the better of two stays, one after the other by id: which of two is better depends on the two, so no key sorts them.
    rank = F.when(approved, 0).when(F.col("r_status") == "edited", 1).when(F.col("r_status") != "superseded", 2).otherwise(3)
    pairs = pairs.withColumns({"rank": rank, "least": F.min(rank).over(Window.partitionBy("l_id"))})
    traits = ["id", "transaction_ids", "confidence", "family", "pattern_kind", "phase", "span", "recurrence_type", "economy", "average_amount", "variation_percent"]
    row = F.struct(*[F.col(f"r_{c}").alias(c) for c in traits])
    first = pairs.where("rank = least").groupBy("l_id", "rank").agg(F.array_sort(F.collect_list(row)).alias("equals"))
    of = lambda x: lambda c: x[c]
    folded = F.aggregate(F.expr("slice(equals, 2, size(equals))"), F.col("equals")[0], lambda best, x: F.when(is_better(of(x), of(best)), x).otherwise(best))
    picked = first.select("l_id", F.when(F.col("rank") == 0, F.col("equals")[0]["id"]).otherwise(folded["id"]).alias("picked"))
    pairs = pairs.join(picked, "l_id").withColumn("place", F.when(F.col("r_id") == F.col("picked"), 1).otherwise(2)).drop("rank", "least", "picked")
    chosen = pairs.where("place = 1").withColumn("fresh", F.col("r_status").isin("pending", "superseded") & ~approved & is_better("l_", "r_"))
    chosen = chosen.withColumn("turn", F.row_number().over(Window.partitionBy("r_id").orderBy(F.desc("l_confidence"), "l_id")))
    best = F.max_by(F.struct("fresh", *[F.col(f"l_{c}").alias(c) for c in FIELDS]), -F.col("turn"))
    hits = chosen.groupBy(F.col("r_id").alias("id")).agg(best.alias("run"), F.flatten(F.collect_set("l_transaction_ids")).alias("gained"))
    spare = pairs.where("place > 1 and r_status = 'pending'").select(F.col("r_id").alias("id")).distinct().join(hits.select("id"), "id", "left_anti").withColumn("spare", F.lit(True))
    state = stored.join(hits, "id", "left").join(spare, "id", "left")
    hit, fresh = F.col("run").isNotNull(), F.coalesce(F.col("run.fresh"), F.lit(False))
    change = F.when(hit & (F.col("status") == "superseded"), "reactivated").when(fresh, "refreshed").when(F.col("spare"), "superseded")
    status = F.when(hit & (F.col("status") == "superseded"), "pending").when(F.col("spare"), "superseded").otherwise(F.col("status"))
    values = {c: F.when(fresh, F.col(f"run.{c}")).otherwise(F.col(c)) for c in FIELDS}
    rows = F.array_sort(F.array_union("transaction_ids", F.coalesce("gained", F.array().cast("array<string>"))))
    kept = state.select(*[values.get(c, status if c == "status" else rows if c == "transaction_ids" else F.col(c)).alias(c) for c in stored.columns], change.alias("change"))
    alone = new.join(chosen.select(F.col("l_id").alias("id")), "id", "left_anti").withColumn("base", K.logical_key(None))
    alone = alone.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("confidence"), "id")))
    taken = stored.select(F.col("dedup_key").alias("base")).distinct().withColumn("taken", F.lit(True))
    keyed = alone.where("n = 1").join(taken, "base", "left").withColumn("dedup_key", F.when(F.col("taken"), F.concat_ws(":", "base", "id")).otherwise(F.col("base")))
    made = keyed.withColumns({"status": F.lit("pending"), "approved": F.lit(False)}).select(*stored.columns, F.lit("created").alias("change"))
    return kept.unionByName(made)


def approval_items(state: DataFrame, items: DataFrame) -> DataFrame:
    """The review items after a run: suggestion_id, company_id, severity, status, dedup_key.

    A suggestion that waits or is edited gets an item where none is open; items of approved, rejected or superseded ones
    are dismissed. ``items`` have the same columns.
    """
    about = state.select(F.col("id").alias("suggestion_id"), F.col("status").alias("own"))
    over = F.col("own").isin("approved", "rejected", "superseded") & F.col("status").isin("open", "in_review")
    held = items.join(about, "suggestion_id", "left").withColumn("status", F.when(over, "dismissed").otherwise(F.col("status"))).select(*items.columns)
    waiting = state.where("status in ('pending', 'edited')").select(F.col("id").alias("suggestion_id"), "company_id", F.when(F.col("confidence") >= URGENT, "high").otherwise("medium").alias("severity"))
    opened = waiting.join(items.where("status in ('open', 'in_review')").select("suggestion_id"), "suggestion_id", "left_anti")
    made = opened.withColumns({"status": F.lit("open"), "dedup_key": F.concat_ws(":", "company_id", F.lit("recurrence_approval"), "suggestion_id")})
    return held.unionByName(made.select(*items.columns))


def change_approved(approved: DataFrame, suggestions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(approved recurrences, suggestions, audit rows) after status changes.

    ``approved``: company_id, id, suggestion_id, status; ``suggestions``: company_id, id, status; ``changes``: company_id,
    id, status, actor, reason. A rejected recurrence rejects its suggestion. A change of an unknown recurrence, or of one of
    another company, gives an audit row with an error and nothing else.
    """
    asked = changes.select("company_id", "id", F.col("status").alias("next"), "actor", "reason")
    after = approved.join(asked, ["company_id", "id"], "left")
    audit = asked.join(approved.select("company_id", "id", "suggestion_id", F.col("status").alias("previous")), ["company_id", "id"], "left")
    audit = audit.withColumn("error", F.when(F.col("previous").isNull(), "not_found"))
    rejected = audit.where("next = 'rejected' and error is null and suggestion_id is not null").select("company_id", F.col("suggestion_id").alias("id"), F.lit(True).alias("gone")).distinct()
    told = suggestions.join(rejected, ["company_id", "id"], "left").withColumn("status", F.when(F.col("gone"), "rejected").otherwise(F.col("status"))).select(*suggestions.columns)
    return after.withColumn("status", F.coalesce("next", "status")).select(*approved.columns), told, audit.select("company_id", "id", "suggestion_id", "previous", "next", "actor", "reason", "error")
