"""Decisions of people as change sets: all rows that a decision changes or adds, together, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.plans.scratch import materialise

from .categorize import category_fits

#: Review items that a category decides, and statuses of those that wait.
CATEGORY_PENDINGS = ("category_review", "low_confidence", "rule_conflict", "uncategorized")
WAITING = ("open", "in_review")
AUDIT = "company_id string, actor string, entity_type string, entity_id string, action string, transaction_id string, suggestion_id string, rule_id string, previous_category_id string, final_category_id string, reason string, pending_type string, previous_status string, final_status string"
COMMITS = "decision_id string, company_id string, error string"


def judged(state: dict[str, DataFrame], decisions: DataFrame) -> DataFrame:
    """Decisions that were not committed before, with ``error`` (null where it applies) and the row that it meets.

    Of several decisions on one transaction in one batch the first by id applies; the others find its category changed.
    """
    fresh = decisions.join(state["commits"].select("decision_id"), "decision_id", "left_anti").dropDuplicates(["decision_id"])
    t = state["transactions"].select("company_id", F.col("id").alias("transaction_id"), F.col("type").alias("t_type"), F.col("category_id").alias("previous_category_id"), F.lit(True).alias("t_known"))
    c = state["categories"].select("company_id", F.col("category_id").alias("final_category_id"), "expected_type", "is_active", F.lit(True).alias("c_known"))
    s = state["suggestions"].select("company_id", F.col("id").alias("suggestion_id"), F.col("transaction_id").alias("s_transaction"), "evaluation_id", F.col("status").alias("s_status"))
    rows = fresh.join(t, ["company_id", "transaction_id"], "left").join(c, ["company_id", "final_category_id"], "left").join(s, ["company_id", "suggestion_id"], "left")
    final, own = F.col("final_category_id").isNotNull(), F.col("suggestion_id").isNotNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(F.col("t_known").isNull(), "unknown_transaction").when(~F.col("previous_category_id").eqNullSafe(F.col("expected_category_id")), "category_changed")
        .when(final & F.col("c_known").isNull(), "unknown_category").when(final & no(F.col("is_active")), "inactive_category").when(final & no(category_fits(F.col("expected_type"), F.col("t_type"))), "incompatible_category")
        .when(own & no(F.col("s_transaction") == F.col("transaction_id")), "foreign_suggestion").when(own & F.col("suggestion_status").isNotNull() & no(F.col("s_status") == "generated"), "already_decided")
        .when((F.col("suggestion_status") == "corrected") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "reason_required")
    )
    rows = rows.withColumn("error", error)
    turn = F.row_number().over(Window.partitionBy("company_id", "transaction_id", F.col("error").isNull()).orderBy("decision_id"))
    return rows.withColumn("turn", turn).withColumn("error", F.coalesce("error", F.when(F.col("turn") > 1, "category_changed"))).drop("turn")


def decide(state: dict[str, DataFrame], decisions: DataFrame) -> dict[str, DataFrame]:
    """The tables after decisions: suggestions, transactions, pendings, and rows to add to audit and commits.

    ``state``: transactions (company_id, id, type, category_id, ...), categories (company_id, category_id, expected_type,
    is_active), suggestions (company_id, id, transaction_id, evaluation_id, status, ...), pendings (company_id, id, type,
    transaction_id, suggestion_id, status, resolved_by, ...), commits (``COMMITS``). ``decisions``: decision_id, company_id,
    transaction_id, suggestion_id, suggestion_status (accepted, corrected, rejected, undefined, or null), final_category_id,
    expected_category_id, pending_status (resolved or dismissed), actor, reason, rule_id.

    An applied decision sets its transaction's category and its suggestion's status, supersedes the other generated
    suggestions of the evaluation unless it rejects, closes the waiting review items of the transaction, and leaves an audit
    row for itself and for each item. One that cannot be applied changes nothing but its commit record, which has the
    error. Decisions with a commit record are left out, so running a batch again changes nothing. Published together
    (``sources.versions``), the tables never show half of a decision.
    """
    rows = materialise(judged(state, decisions), "decisions")
    done = rows.where("error is null")
    new = done.select("company_id", F.col("transaction_id").alias("id"), F.col("final_category_id").alias("_final"), F.lit(True).alias("_done"))
    transactions = state["transactions"].join(new, ["company_id", "id"], "left").withColumn("category_id", F.when(F.col("_done"), F.col("_final")).otherwise(F.col("category_id"))).select(*state["transactions"].columns)

    told = done.where("suggestion_id is not null and suggestion_status is not null")
    own = told.select("company_id", F.col("suggestion_id").alias("id"), F.col("suggestion_status").alias("_own"))
    beside = told.where("suggestion_status <> 'rejected'").select("company_id", "transaction_id", "evaluation_id", F.lit(True).alias("_beside")).distinct()
    s = state["suggestions"].join(own, ["company_id", "id"], "left").join(beside, ["company_id", "transaction_id", "evaluation_id"], "left")
    status = F.coalesce("_own", F.when(F.col("_beside") & (F.col("status") == "generated"), F.lit("superseded")), F.col("status"))
    suggestions = s.withColumn("status", status).select(*state["suggestions"].columns)

    closing = done.select("company_id", "transaction_id", "pending_status", "actor", "rule_id", "reason", "previous_category_id", "final_category_id")
    hit = F.col("pending_status").isNotNull() & F.col("type").isin(*CATEGORY_PENDINGS) & F.col("status").isin(*WAITING)
    p = state["pendings"].join(closing, ["company_id", "transaction_id"], "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    pendings = p.withColumns({"status": F.when(F.col("_hit"), F.col("pending_status")).otherwise(F.col("status")), "resolved_by": F.when(F.col("_hit"), F.col("actor")).otherwise(F.col("resolved_by"))}).select(*state["pendings"].columns)

    none = lambda name: F.lit(None).cast("string").alias(name)
    action = F.concat(F.lit("categorization."), F.coalesce("suggestion_status", F.lit("changed")))
    about = ["transaction_id", "suggestion_id", "rule_id", "previous_category_id", "final_category_id", "reason"]
    audit = done.select("company_id", "actor", F.lit("Transaction").alias("entity_type"), F.col("transaction_id").alias("entity_id"), action.alias("action"), *about, none("pending_type"), none("previous_status"), none("final_status"))
    closed = F.when(F.col("pending_status") == "dismissed", "pending.dismissed").otherwise("pending.resolved")
    items = p.where("_hit").select("company_id", "actor", F.lit("PendingItem").alias("entity_type"), F.col("id").alias("entity_id"), closed.alias("action"), *about, F.col("type").alias("pending_type"), F.col("status").alias("previous_status"), F.col("pending_status").alias("final_status"))
    return {"transactions": transactions, "suggestions": suggestions, "pendings": pendings, "audit": audit.unionByName(items), "commits": rows.select("decision_id", "company_id", "error")}


def decide_duplicates(state: dict[str, DataFrame], decisions: DataFrame) -> dict[str, DataFrame]:
    """The tables after decisions on possible duplicates: duplicates, pendings, and rows to add to audit and commits.

    ``state``: duplicates (company_id, id, left_id, right_id, score, decision, decided_by), pendings (company_id, id,
    duplicate_candidate_id, type, status, resolved_by, ...), commits. ``decisions``: decision_id, company_id,
    duplicate_id, decision, actor, reason. A pair is decided once: of several decisions in one batch the first by id
    applies. Its waiting items are resolved, and one audit row names them. Decisions with a commit record are left out.
    """
    fresh = decisions.join(state["commits"].select("decision_id"), "decision_id", "left_anti").dropDuplicates(["decision_id"])
    known = state["duplicates"].select("company_id", F.col("id").alias("duplicate_id"), "left_id", "right_id", "score", F.col("decision").alias("before"), F.lit(True).alias("known"))
    rows = fresh.join(known, ["company_id", "duplicate_id"], "left")
    turn = F.row_number().over(Window.partitionBy("company_id", "duplicate_id").orderBy("decision_id"))
    error = F.when(F.col("known").isNull(), "unknown_duplicate").when(F.col("before").isNotNull() | (F.col("turn") > 1), "already_decided")
    rows = materialise(rows.withColumn("turn", turn).withColumn("error", error).drop("turn"), "duplicate-decisions")
    done = rows.where("error is null")
    new = done.select("company_id", F.col("duplicate_id").alias("id"), F.col("decision").alias("_decision"), F.col("actor").alias("_actor"))
    d = state["duplicates"].join(new, ["company_id", "id"], "left")
    duplicates = d.withColumns({"decision": F.coalesce("decision", "_decision"), "decided_by": F.coalesce("decided_by", "_actor")}).select(*state["duplicates"].columns)
    closing = done.select("company_id", F.col("duplicate_id").alias("duplicate_candidate_id"), F.col("actor").alias("_actor"))
    p = state["pendings"].join(closing, ["company_id", "duplicate_candidate_id"], "left")
    hit = F.coalesce(F.col("_actor").isNotNull() & (F.col("type") == "possible_duplicate") & F.col("status").isin(*WAITING), F.lit(False))
    p = p.withColumn("_hit", hit)
    pendings = p.withColumns({"status": F.when(F.col("_hit"), "resolved").otherwise(F.col("status")), "resolved_by": F.when(F.col("_hit"), F.col("_actor")).otherwise(F.col("resolved_by"))}).select(*state["pendings"].columns)
    closed = p.where("_hit").groupBy("company_id", F.col("duplicate_candidate_id").alias("duplicate_id")).agg(F.array_sort(F.collect_list("id")).alias("pending_ids"))
    audit = done.join(closed, ["company_id", "duplicate_id"], "left").select(
        "company_id", "actor", F.lit("DuplicateCandidate").alias("entity_type"), F.col("duplicate_id").alias("entity_id"), F.lit("duplicate.decision").alias("action"), F.col("left_id").alias("transaction_id"), "reason",
        "decision", F.col("right_id").alias("candidate_transaction_id"), "score", F.coalesce("pending_ids", F.array().cast("array<string>")).alias("pending_ids"),
    )
    return {"duplicates": duplicates, "pendings": pendings, "audit": audit, "commits": rows.select("decision_id", "company_id", "error")}
