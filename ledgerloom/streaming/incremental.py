"""Incremental import as a stream: new statement rows are made canonical and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.ingest import canonical, dispositions, new_rows
from ledgerloom.plans.scratch import materialise
from ledgerloom.sources.versions import Versions

#: What tells a row of the ledger from others.
KEY_COLUMNS = ["company_id", "bank_account_id", "external_id"]

LINE_SCHEMA = "file string, row_no int, company_id string, bank_account_id string, raw_date string, raw_description string, raw_amount string"


def append_batch(ledger_path: str):
    """A ``foreachBatch`` function: appends the rows of a batch that the ledger does not have. Running a batch again,
    after a lost driver, adds nothing."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = canonical(dispositions(batch).where("disposition = 'candidate'"))
        try:
            ledger = spark.read.parquet(ledger_path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            ledger = rows.limit(0)
        new_rows(rows, ledger).write.mode("append").partitionBy("company_id").parquet(ledger_path)

    return append


def publish_batch(base: str):
    """A ``foreachBatch`` function: publishes the new rows of a batch and their keys as one version of ``sources.versions``.

    Keys lie apart from the rows, in folders by company, and only those of the batch's companies are read, so the cost of
    a batch does not grow with the ledger. A batch that dies before its manifest is written leaves the version before it;
    one that was published is known by its mark and adds nothing when it runs again.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Versions(spark, base)
        before = store.manifest()
        if before["marks"].get("batch", -1) >= batch_id:
            return
        rows = materialise(canonical(dispositions(batch).where("disposition = 'candidate'")), "batch-rows")
        keys = store.read("keys", before["version"])
        if keys is not None:
            known = keys.join(F.broadcast(rows.select("company_id").distinct()), "company_id", "left_semi")
            rows = materialise(new_rows(rows, known), "batch-new")
        else:
            rows = materialise(new_rows(rows, rows.limit(0)), "batch-new")
        store.publish(append={"ledger": rows, "keys": rows.select(*KEY_COLUMNS)}, marks={"batch": batch_id}, after=before["version"], by={"keys": "company_id", "ledger": "company_id"})

    return publish


def stream_versions(spark: SparkSession, lines_path: str, base: str, checkpoint: str) -> StreamingQuery:
    """As ``stream_statements``, into versions that are published all at once."""
    lines = spark.readStream.schema(LINE_SCHEMA).parquet(lines_path)
    return lines.writeStream.foreachBatch(publish_batch(base)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_statements(spark: SparkSession, lines_path: str, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Imports all statement rows that have arrived under ``lines_path`` as Parquet, then stops."""
    lines = spark.readStream.schema(LINE_SCHEMA).parquet(lines_path)
    return lines.writeStream.foreachBatch(append_batch(ledger_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream of events (ts, event_type) by window and type; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")
