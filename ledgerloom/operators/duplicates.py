"""Possible duplicates: scored pairs of transactions of one account, date, amount and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import pair_text

THRESHOLD = 80
#: Points for what every pair shares (account 15, date 20, amount 20, type 10) and for what it may share.
BASE, DESCRIPTION, COUNTERPARTY, DOCUMENT = 65, 20, 10, 15


def duplicate_pairs(txns: DataFrame, threshold: int = THRESHOLD, details: bool = False) -> DataFrame:
    """Pairs (left_id < right_id) that score ``threshold`` or more, with what they share; ``details`` adds the external ids
    and normalised texts that ``duplicate_evidence`` asks for.

    A hash join on company, account, date, whole cents and type; a pair also needs an equal description, counterparty
    or document. Texts are normalised only where a key occurs twice. Rows with one external id are one transaction and
    never a pair.
    """
    cols = ["company_id", "bank_account_id", "date", "type"]
    external = F.col("external_id") if "external_id" in txns.columns else F.lit(None).cast("string")
    keys = [*cols, "cents"]
    keyed = txns.select(*cols, F.floor(F.col("amount") * 100 + 0.5).alias("cents"), "id", external.alias("x"), "description", "counterparty_name", "document_number")
    several = keyed.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("rows > 1")
    texts = {"d": "description", "c": "counterparty_name", "n": "document_number"}
    rows = several.select(*keys, "id", "x", *[pair_text(F.col(c)).alias(k) for k, c in texts.items()])
    other = rows.select(*keys, *[F.col(k).alias(f"r_{k}") for k in ("id", "x", "d", "c", "n")])
    same = lambda k: (F.col(k) != "") & (F.col(k) == F.col(f"r_{k}"))
    pairs = rows.join(other, keys).where((F.col("id") < F.col("r_id")) & ~F.coalesce(F.col("x") == F.col("r_x"), F.lit(False)))
    points = lambda k, n: F.when(same(k), n).otherwise(0)
    score = F.least(F.lit(100), BASE + points("d", DESCRIPTION) + points("c", COUNTERPARTY) + points("n", DOCUMENT))
    more = [F.col("x").alias("left_external"), F.col("r_x").alias("right_external"), F.col("d").alias("normalized_description"), F.col("c").alias("normalized_counterparty"), F.col("n").alias("normalized_document")]
    scored = pairs.where(same("d") | same("c") | same("n")).select(
        "company_id", F.col("id").alias("left_id"), F.col("r_id").alias("right_id"), score.alias("score"),
        same("d").alias("same_description"), same("c").alias("same_counterparty"), same("n").alias("same_document"),
        *(more if details else []),
    )
    return scored.where(F.col("score") >= threshold)


def duplicate_evidence(pairs: DataFrame) -> DataFrame:
    """Adds ``evidence`` to scored pairs with details: eight checks, of which account, date, amount and type hold for every pair, both
    external ids, and the normalised texts of the left one."""
    yes = F.lit(True)
    checks = F.struct(
        yes.alias("sameBankAccount"), yes.alias("sameDate"), yes.alias("sameAmount"), yes.alias("sameType"), F.col("same_description").alias("sameDescription"), F.col("same_counterparty").alias("sameCounterparty"),
        F.col("same_document").alias("sameDocument"), (~F.col("left_external").eqNullSafe(F.col("right_external"))).alias("differentExternalId"),
    )
    texts = [F.col(f"normalized_{c}").alias(f"normalized{c.capitalize()}") for c in ("description", "counterparty", "document")]
    return pairs.withColumn("evidence", F.struct(checks.alias("checks"), F.col("left_external").alias("firstExternalId"), F.col("right_external").alias("secondExternalId"), *texts))


def new_pendings(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Review items of pairs whose key no waiting item holds yet. ``existing``: dedup_key, status."""
    return items.join(existing.where("status in ('open', 'in_review')").select("dedup_key").distinct(), "dedup_key", "left_anti").select(*items.columns)


def duplicate_pendings(pairs: DataFrame) -> DataFrame:
    """One review item per pair; severity is high from 90 points on."""
    return pairs.select(
        "company_id", "left_id", "right_id", "score", F.when(F.col("score") >= 90, "high").otherwise("medium").alias("severity"),
        F.concat_ws(":", "company_id", F.lit("possible_duplicate"), "left_id", "right_id").alias("dedup_key"),
    )


def decide_duplicates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """State after decisions (left_id, right_id, decision): a pair is decided once, a second decision is an error."""
    joined = candidates.join(decisions.withColumnRenamed("decision", "new"), ["left_id", "right_id"], "left")
    late = F.col("decision").isNotNull() & F.col("new").isNotNull()
    return joined.withColumn("error", F.when(late, "already_decided")).withColumn("decision", F.coalesce("decision", "new")).withColumn("pending_open", F.col("decision").isNull()).drop("new")
