"""Labelled truth from JSON files: declared schemas, and broken records set apart instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import materialise

#: Names and types of the fields that each kind of file has. Lists may be under a name of their own.
SCHEMAS = {
    "transactions": "id string, companyId string, bankAccountId string, date string, amount double, type string, originalDescription string, normalizedDescription string, counterpartyName string, documentNumber string, "
    "expectedCategoryId string, expectedRecurrenceGroupId string, expectedImportBehavior string",
    "recurrences": "id string, companyId string, type string, kind string, frequency string, descriptionBase string, transactionIds array<string>",
    "categories": "id string, companyId string, name string, expectedTransactionType string, isActive boolean",
    "rules": "id string, companyId string, categoryId string, ruleType string, conditions string, priority int, confidence int, status string",
    "pending": "id string, companyId string, type string, severity string, transactionId string",
}
#: Where the list is inside its file; other files are a list.
INSIDE = {"recurrences": "groups", "pending": "items"}
BROKEN = "_broken"


def read_truth(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(records of one kind of truth, broken records as text with their file).

    A file is one JSON value over many lines: a list of records, or an object that holds the list. A value that is no JSON,
    or of another type than declared, is broken as a whole; fields that are not declared are ignored, missing ones null.
    """
    fields = SCHEMAS[kind]
    inside = INSIDE.get(kind)
    schema = f"{inside} array<struct<{', '.join(_typed(fields))}>>, {BROKEN} string" if inside else f"{fields}, {BROKEN} string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path).withColumn("_file", F.input_file_name())
    # Once parsed: broken records are looked for without their fields.
    rows = materialise(rows, "truth")
    bad = rows.where(F.col(BROKEN).isNotNull()).select(F.element_at(F.split("_file", "/"), -1).alias("file"), F.col(BROKEN).alias("text"))
    good = rows.where(F.col(BROKEN).isNull()).drop(BROKEN, "_file")
    return (good.select(F.explode(inside).alias("r")).select("r.*") if inside else good), bad


def _typed(fields: str) -> list[str]:
    return [f.replace(" ", ":", 1) for f in fields.split(", ")]


def imported(transactions: DataFrame) -> DataFrame:
    """Labelled transactions that an import is expected to keep."""
    return transactions.where("expectedImportBehavior = 'imported'")


def normalised_truth(transactions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns that the audits ask for: (transaction_id, group_id, kind, month, party), (group_id, kind, frequency)."""
    rows = imported(transactions).select(
        F.col("id").alias("transaction_id"), F.col("expectedRecurrenceGroupId").alias("group_id"), F.col("expectedCategoryId").alias("kind"), F.trunc(F.to_date("date"), "MM").alias("month"), F.coalesce("counterpartyName", "normalizedDescription").alias("party")
    )
    return rows, groups.select(F.col("id").alias("group_id"), "kind", "frequency")
