"""Rule-based categorisation: transactions joined to their company's rules, ranked candidates, one outcome each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import digits, rule_text

#: Rule types that compare one value for equality; these go through a hash join on the value.
EQUALITY = ("document_equals", "counterparty_equals", "description_equals")


def normalized(txns: DataFrame) -> DataFrame:
    """Adds n_description, n_counterparty, n_document and abs_amount, empty as null."""
    return txns.select(
        "*", F.coalesce(rule_text(F.col("description")), F.lit("")).alias("n_description"), F.nullif(rule_text(F.col("counterparty_name")), F.lit("")).alias("n_counterparty"),
        digits(F.col("document_number")).alias("n_document"), F.abs("amount").alias("abs_amount"),
    )


def active_rules(rules: DataFrame) -> DataFrame:
    """Active rules with their conditions normalised; a blank value or counterparty counts as none."""
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    return rules.where("status = 'active'").select(
        "company_id", "rule_id", "rule_type", F.col("category_id").alias("rule_category"), "priority", "confidence", "source",
        rule_text(given("value")).alias("r_text"), digits(given("value")).alias("r_digits"), rule_text(given("counterparty")).alias("r_counterparty"), "low", "high",
    )


def in_range(amount: Column, low: Column, high: Column) -> Column:
    """Both bounds given, not crossed, and the amount between them."""
    return F.coalesce((low <= high) & amount.between(low, high), F.lit(False))


def match_rules(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per transaction and active rule that matches, with matched_value.

    Equality rules are found by a hash join on company, type and value; all others are compared with the transactions
    of their company, under one key of its own in the same join, so transactions are read and normalised once.
    """
    left, right = normalized(txns), active_rules(rules)
    entry = lambda how, key: F.struct(F.lit(how).alias("how"), key.alias("key"))
    keys = F.array(*[entry(kind, F.col(c)) for kind, c in zip(EQUALITY, ("n_document", "n_counterparty", "n_description"))], entry("", F.lit("")))
    keyed = left.select("*", F.explode(keys).alias("k")).select("*", "k.*").drop("k")
    is_equality = F.col("rule_type").isin(*EQUALITY)
    how = F.when(is_equality, F.col("rule_type")).otherwise("")
    key = F.when(F.col("rule_type") == "document_equals", F.col("r_digits")).when(is_equality, F.col("r_text")).otherwise("")
    met = keyed.join(right.withColumns({"how": how, "key": key}), ["company_id", "how", "key"])
    kind = F.col("rule_type")
    holds = (
        F.when(kind.isin(*EQUALITY), F.lit(True))
        .when(kind == "counterparty_contains", F.col("n_counterparty").contains(F.col("r_text")))
        .when(kind == "description_contains", F.col("n_description").contains(F.col("r_text")))
        .when(kind == "amount_range", in_range(F.col("abs_amount"), F.col("low"), F.col("high")))
        .when(kind == "counterparty_and_amount_range", (F.col("n_counterparty") == F.col("r_counterparty")) & in_range(F.col("abs_amount"), F.col("low"), F.col("high")))
    )
    value = (
        F.when(kind == "document_equals", F.col("n_document"))
        .when(kind.startswith("counterparty"), F.col("n_counterparty"))
        .when(kind.startswith("description"), F.col("n_description"))
        .otherwise(F.regexp_replace(F.col("abs_amount").cast("decimal(18,2)").cast("string"), r"\.?0+$", ""))
    )
    return met.where(holds).withColumn("matched_value", value).drop("how", "key", "r_text", "r_digits", "r_counterparty", "low", "high")


def origin(source: Column, rule_type: Column) -> Column:
    return (
        F.when(source == "manual", "manual_rule").when(source == "correction_history", "correction_history").when(rule_type == "document_equals", "document_rule")
        .when(rule_type.startswith("counterparty"), "counterparty_rule").otherwise("description_rule")
    )


def confidence_band(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 60, "medium").otherwise("low")


def category_fits(expected: Column, txn_type: Column) -> Column:
    return (expected == "both") | (expected == txn_type)


def candidates(matches: DataFrame) -> DataFrame:
    """One row per transaction and category: the rule of highest priority, then confidence, then smallest id, and a score.

    Every further rule of the category adds 2 to the score, at most 5, up to 100.
    """
    best = F.min(F.struct((-F.col("priority")).alias("p"), (-F.col("confidence")).alias("c"), "rule_id", "rule_type", "source", "matched_value"))
    grouped = matches.groupBy("company_id", F.col("id").alias("transaction_id"), F.col("rule_category").alias("category_id")).agg(best.alias("b"), F.count(F.lit(1)).alias("n_rules"))
    bonus = F.least(F.lit(5), 2 * (F.col("n_rules") - 1))
    return grouped.select(
        "company_id", "transaction_id", "category_id", "b.rule_id", (-F.col("b.p")).alias("priority"), F.least(F.lit(100), -F.col("b.c") + bonus).cast("int").alias("score"),
        origin(F.col("b.source"), F.col("b.rule_type")).alias("origin"), "b.matched_value", "n_rules",
    )


def ranked(found: DataFrame) -> DataFrame:
    """Adds place (1 is best: priority, score, then category) and has_conflict (more than one category)."""
    own = Window.partitionBy("company_id", "transaction_id")
    place = F.row_number().over(own.orderBy(F.desc("priority"), F.desc("score"), "category_id"))
    return found.select("*", place.alias("place"), (F.count(F.lit(1)).over(own) > 1).alias("has_conflict"))


#: Fixed value: the version of the decision ladder that evaluation ids carry.
ENGINE_VERSION = "categorization-engine-v1"


def evaluation_ids(txns: DataFrame, rules: DataFrame, engine: str = ENGINE_VERSION) -> DataFrame:
    """company_id, transaction_id, evaluation_id: a digest of the engine, the transaction and its company's active rules.

    The same transaction under the same rules (id, version, priority, confidence, sorted by id) has the same id again, so
    a repeated run adds nothing. The digest is of one JSON record; the list of rules is made once for each company.
    """
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(F.col(c).cast("string"))), r"^\[|\]$", ""))
    number = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(F.regexp_replace(F.col(c).cast("decimal(38,6)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
    record = lambda **fields: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))
    rule = record(id=text("rule_id"), version=number("version"), priority=number("priority"), confidence=number("confidence"))
    listed = rules.where("status = 'active'").groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", rule.alias("json")))), lambda r: r["json"]), ",").alias("listed"))
    day = F.concat(F.lit('"'), F.col("date").cast("string"), F.lit('T00:00:00.000Z"'))
    transaction = record(id=text("id"), companyId=text("company_id"), date=day, description=text("description"), amount=number("amount"), type=text("type"), counterpartyName=text("counterparty_name"), documentNumber=text("document_number"))
    whole = record(engineVersion=F.lit(f'"{engine}"'), transaction=transaction, rules=F.concat(F.lit("["), F.coalesce("listed", F.lit("")), F.lit("]")))
    return txns.join(listed, "company_id", "left").select("company_id", F.col("id").alias("transaction_id"), F.sha2(whole, 256).alias("evaluation_id"))


def suggestion_keys(found: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Adds evaluation_id and dedup_key (evaluation and category) to candidates, and leaves out repeated keys."""
    keyed = found.join(evaluations, ["company_id", "transaction_id"]).withColumn("dedup_key", F.concat_ws(":", "evaluation_id", "category_id"))
    own = Window.partitionBy("dedup_key").orderBy(F.desc("score"), "rule_id")
    return keyed.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def outcomes(txns: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per transaction with the outcome of the decision ladder, in this order: already categorised, no rule,
    conflict, inactive or unknown category, type that does not fit, then high, medium or low confidence."""
    best = ranked(candidates(match_rules(txns, rules))).where("place = 1")
    best = best.select("company_id", F.col("transaction_id").alias("id"), F.col("category_id").alias("suggested"), "rule_id", "score", "origin", "has_conflict")
    joined = txns.join(best, ["company_id", "id"], "left").join(categories.select(F.col("category_id").alias("suggested"), "expected_type", "is_active"), "suggested", "left")
    outcome = (
        F.when(F.col("category_id").isNotNull(), "already_categorized").when(F.col("suggested").isNull(), "uncategorized").when(F.col("has_conflict"), "conflict")
        .when(~F.coalesce("is_active", F.lit(False)), "invalid_category").when(~category_fits(F.col("expected_type"), F.col("type")), "incompatible_category")
        .when(F.col("score") >= 90, "auto_applied").when(F.col("score") >= 60, "medium_review").otherwise("low_confidence")
    )
    return joined.select("company_id", "id", "type", "category_id", "suggested", "rule_id", "score", "origin", outcome.alias("outcome"))


def pending_items(decided: DataFrame) -> DataFrame:
    """The review queue: one item per transaction whose outcome asks for a person."""
    kind = (
        F.when(F.col("outcome") == "medium_review", "category_review").when(F.col("outcome") == "low_confidence", "low_confidence").when(F.col("outcome") == "conflict", "rule_conflict")
        .when(F.col("outcome") == "uncategorized", "uncategorized").when(F.col("outcome").isin("invalid_category", "incompatible_category"), "category_review")
    )
    severity = F.when(F.col("outcome").isin("medium_review", "uncategorized"), "medium").otherwise("high")
    items = decided.select("company_id", F.col("id").alias("transaction_id"), kind.alias("pending_type"), severity.alias("severity"), F.lit("open").alias("status")).where("pending_type is not null")
    return items.withColumn("dedup_key", F.concat_ws(":", "company_id", "transaction_id", "pending_type"))


def without_open(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items whose key no open or reviewed item holds yet."""
    return items.join(existing.where("status in ('open', 'in_review')").select("dedup_key"), "dedup_key", "left_anti")


def auto_applicable(decided: DataFrame) -> DataFrame:
    """Transactions that get their category at once."""
    return decided.where("outcome = 'auto_applied'").select("company_id", F.col("id").alias("transaction_id"), F.col("suggested").alias("category_id"), "rule_id", "score")


def summary(decided: DataFrame) -> DataFrame:
    """Counts of each company by outcome."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return decided.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("processed"), count("auto_applied").alias("auto_applied"), count("medium_review").alias("medium_review"), count("low_confidence").alias("low_confidence"),
        count("conflict").alias("conflicts"), count("uncategorized").alias("uncategorized"), count("invalid_category", "incompatible_category").alias("invalid"),
        count("already_categorized").alias("already_categorized"),
    )


#: Names of the conditions of a rule.
TEXT_CONDITIONS, NUMBER_CONDITIONS = ("description", "counterparty", "document"), ("minAmount", "maxAmount")


def guarded_conditions(rules: DataFrame, conditions: str = "conditions") -> DataFrame:
    """``rules`` with a column for each condition of their JSON object: a text counts only where it is a string that is not
    blank, as it is; a number only where it is a number. Anything else, and text that is no JSON object, is null."""
    root = F.try_parse_json(F.col(conditions))
    kind = lambda x: F.schema_of_variant(x)
    at = lambda name: F.try_variant_get(root, f"$.{name}", "variant")
    blank = lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) == ""
    text = lambda name: F.try_variant_get(root, f"$.{name}", "string")
    texts = {name: F.when((kind(at(name)) == "STRING") & ~blank(text(name)), text(name)) for name in TEXT_CONDITIONS}
    numbers = {name: F.when(kind(at(name)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(root, f"$.{name}", "double")) for name in NUMBER_CONDITIONS}
    return rules.select("*", *[c.alias(f"condition_{name}") for name, c in {**texts, **numbers}.items()])


def exploded_rules(rules: DataFrame) -> DataFrame:
    """A rule whose value lists alternatives with ``|`` as one rule for each."""
    return rules.select(*[c for c in rules.columns if c != "value"], F.posexplode(F.split("value", r"\|")).alias("alternative", "value")).where(F.trim("value") != "")


def apply_decisions(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next state of suggestions after people's decisions.

    ``state``: suggestion_id, transaction_id, evaluation_id, category_id, status, current_category. ``decisions``:
    suggestion_id, action (accept, correct, reject, undefined), category_id, reason, expected_category. A decision
    counts only if its suggestion is still ``generated``, the transaction's category is the one that the person saw, and
    a correction has a reason; otherwise ``error`` says why not. After a decision other than a rejection, the other
    generated suggestions of the evaluation are superseded.
    """
    d = decisions.select("suggestion_id", "action", F.col("category_id").alias("chosen"), "reason", "expected_category")
    own = state.join(d, "suggestion_id", "left")
    error = (
        F.when(F.col("action").isNull(), None).when(F.col("status") != "generated", "not_generated").when(~F.col("current_category").eqNullSafe(F.col("expected_category")), "category_changed")
        .when((F.col("action") == "correct") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "reason_required")
    )
    own = own.withColumn("error", error).withColumn("done", F.col("action").isNotNull() & error.isNull())
    settled = F.max(F.when(F.col("done") & (F.col("action") != "reject"), 1).otherwise(0)).over(Window.partitionBy("evaluation_id")) == 1
    new = F.when(F.col("done"), F.create_map(*[F.lit(x) for x in ("accept", "accepted", "correct", "corrected", "reject", "rejected", "undefined", "undefined")])[F.col("action")])
    status = F.coalesce(new, F.when(settled & (F.col("status") == "generated"), F.lit("superseded")), F.col("status"))
    category = F.when(F.col("done") & (F.col("action") == "accept"), F.col("category_id")).when(F.col("done") & (F.col("action") == "correct"), F.col("chosen")).when(F.col("done") & (F.col("action") == "undefined"), None).otherwise(F.col("current_category"))
    return own.select("suggestion_id", "transaction_id", "evaluation_id", "category_id", status.alias("status"), category.alias("current_category"), "error")
