"""From the cells of workbooks to statement rows: sheet and header choice, column binding, metadata, errors and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import parse_date, parse_money
from ledgerloom.functions.text import control_text, statement_text

from .ingest import dispositions, is_header, layout_score

#: Rows of a sheet in which a header is looked for, and rows that may hold metadata.
HEADER_ROWS, METADATA_ROWS = 30, 15


def headers(cells: DataFrame) -> DataFrame:
    """file, sheet, header_no, header: the sheet of each file that holds its entries and its first header row.

    ``cells``: file, sheet_no, sheet, row_no, cells. A sheet named for entries comes before all others, whether it has a
    header or not; else the first sheet with one counts. Without a header header_no and header are null.
    """
    seen = cells.where("sheet is not null").withColumn("named", control_text(F.col("sheet")) == "LANCAMENTOS")
    header = F.min(F.when((F.col("row_no") <= HEADER_ROWS) & is_header(F.col("cells")), F.struct("row_no", "cells")))
    sheets = seen.groupBy("file", "sheet_no", "sheet", "named").agg(header.alias("h"))
    order = Window.partitionBy("file").orderBy(F.desc("named"), F.col("h").isNull(), "sheet_no")
    chosen = sheets.withColumn("place", F.row_number().over(order)).where("place = 1")
    return chosen.select("file", "sheet", F.col("h.row_no").alias("header_no"), F.col("h.cells").alias("header"))


def bound_columns(header: Column) -> dict[str, Column]:
    """The place (from 1) of each column in a header; null where it is missing."""
    names = F.transform(header, lambda c: F.coalesce(control_text(c), F.lit("")))
    first = lambda test: F.nullif(F.array_position(F.transform(names, test), F.lit(True)), F.lit(0)).cast("int")
    return {
        "date": first(lambda c: c == "DATA"),
        "description": first(lambda c: c.startswith("LANCAMENTO")),
        "amount": first(lambda c: c.startswith("VALOR")),
        "balance": first(lambda c: c.startswith("SALDO")),
        "origin": first(lambda c: c.contains("ORIGEM")),
    }


def file_errors(cells: DataFrame) -> DataFrame:
    """file, error: why a workbook cannot be imported, or null. ``cells`` may hold rows with an error of the reader."""
    broken = cells.groupBy("file").agg(F.max("error").alias("broken"))
    layout = layout_score(cells.where("sheet is not null"))
    columns = bound_columns(F.col("header"))
    bound = headers(cells).select("file", (columns["date"].isNotNull() & columns["description"].isNotNull() & columns["amount"].isNotNull()).alias("bound"))
    joined = broken.join(layout, "file", "left").join(bound, "file", "left")
    error = (
        F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.coalesce("score", F.lit(0.0)) == 0, "BANK_NOT_DETECTED")
        .when(~F.coalesce("supported", F.lit(False)), "LAYOUT_NOT_SUPPORTED").when(~F.coalesce("bound", F.lit(False)), "HEADER_NOT_FOUND")
    )
    return joined.select("file", error.alias("error"))


def statement_rows(cells: DataFrame) -> DataFrame:
    """file, row_no, raw_date, raw_description, raw_amount, raw_balance, raw_origin, row_text: the rows after the header."""
    columns = bound_columns(F.col("header"))
    bound = headers(cells).where("header_no is not null").select("file", "sheet", "header_no", *[c.alias(f"at_{n}") for n, c in columns.items()])
    bound = bound.where("at_date is not null and at_description is not null and at_amount is not null")
    rows = cells.select("file", "sheet", "row_no", "cells").join(bound, ["file", "sheet"]).where("row_no > header_no")
    cell = lambda name: F.get("cells", F.col(f"at_{name}") - 1).alias(f"raw_{name}")
    words = F.array_join(F.filter(F.transform("cells", statement_text), lambda c: c != ""), " ")
    return rows.select("file", "row_no", *map(cell, columns), words.alias("row_text"))


def statement_lines(rows: DataFrame) -> DataFrame:
    """The lines of a statement (rows of ``statement_rows``) with disposition and reason.

    As ``dispositions``, with marks looked for in the whole row; a row whose origin says so is ``future``.
    """
    marked = dispositions(rows, text="row_text", own_text="raw_description")
    future = control_text(F.coalesce("raw_origin", F.lit(""))).isin("FUTURO", "FUTURE")
    kind = F.when(future & (F.col("disposition") != "future"), "future").otherwise(F.col("disposition"))
    reason = F.when(kind == "future", "FUTURE_TRANSACTION_SKIPPED").when(kind == "ignored", "IGNORED_BALANCE_ROW")
    return marked.withColumn("disposition", kind).withColumn("reason", reason.when(kind == "invalid", line_reason()))


def line_reason() -> Column:
    """Why an invalid line cannot be read."""
    amount = parse_money(F.col("raw_amount"))
    return F.when(parse_date(F.col("raw_date")).isNull(), "INVALID_DATE").when(amount.isNull(), "INVALID_AMOUNT").when(amount == 0, "ZERO_AMOUNT")


def workbook_metadata(cells: DataFrame) -> DataFrame:
    """file, holder_name, agency, account_number: from labels in the first rows of the chosen sheet; the last one counts."""
    rows = cells.join(headers(cells).select("file", "sheet"), ["file", "sheet"]).where(F.col("row_no") <= METADATA_ROWS)
    label, value = control_text(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))), statement_text(F.coalesce(F.get("cells", F.lit(1)), F.lit("")))
    told = rows.select("file", "row_no", label.alias("label"), value.alias("value")).where("value <> ''")
    last = lambda text, name: F.max_by(F.when(F.col("label") == text, F.col("value")), F.when(F.col("label") == text, F.col("row_no"))).alias(name)
    return told.groupBy("file").agg(last("NOME:", "holder_name"), last("AGENCIA:", "agency"), last("CONTA:", "account_number"))


def text_metadata(lines: DataFrame) -> DataFrame:
    """file, holder_name, agency, account_number, period_start, period_end: from the text lines (file, line_no, text) of pages."""
    t = statement_text(F.col("text"))
    part = lambda pattern, group: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    period = r"(?iu)per[ií]odo de visualiza[cç][aã]o:\s*de\s*(\d{2}/\d{2}/\d{4})\s*at[eé]\s*(\d{2}/\d{2}/\d{4})"
    read = lines.select(
        "file", "line_no", F.trim(part(r"(?i)^(.+?)\s+CPF:", 1)).alias("holder_name"), part(r"(?iu)ag[eê]ncia:\s*([0-9-]+)", 1).alias("agency"),
        part(r"(?i)conta:\s*([0-9-]+)", 1).alias("account_number"), part(period, 1).alias("period_start"), part(period, 2).alias("period_end"),
    )
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)
    found = read.groupBy("file").agg(*map(last, ("holder_name", "agency", "account_number", "period_start", "period_end")))
    return found.withColumns({c: parse_date(F.col(c)) for c in ("period_start", "period_end")})


def issues(lines: DataFrame, rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """file, row_no, severity, code: errors and warnings of each import.

    ``lines`` have disposition and reason (null: none known), ``rows`` are the canonical ones with raw_balance and
    is_duplicate; ``metadata`` may tell the period of a file.
    """
    wrong = lines.where("disposition = 'invalid'").select("file", "row_no", F.lit("error").alias("severity"), F.coalesce("reason", F.lit("INVALID_ROW")).alias("code"))
    balance = (F.coalesce("raw_balance", F.lit("")) != "") & parse_money(F.col("raw_balance")).isNull()
    none = F.lit(None).cast("int").alias("row_no")
    told = rows.where(balance).select("file", "row_no", F.lit("warning").alias("severity"), F.lit("INVALID_BALANCE").alias("code"))
    future = lines.where("disposition = 'future'").select("file").distinct().select("file", none, F.lit("warning").alias("severity"), F.lit("FUTURE_TRANSACTION_SKIPPED").alias("code"))
    kept = rows.where("not is_duplicate").select("file").distinct()
    known = metadata.where("period_start is not null and period_end is not null").select("file") if metadata is not None else None
    derived = (kept.join(known, "file", "left_anti") if known is not None else kept).select("file", none, F.lit("warning").alias("severity"), F.lit("STATEMENT_PERIOD_DERIVED").alias("code"))
    empty = lines.select("file").distinct().join(kept, "file", "left_anti").select("file", none, F.lit("error").alias("severity"), F.lit("NO_TRANSACTIONS_FOUND").alias("code"))
    return wrong.unionByName(told).unionByName(future).unionByName(derived).unionByName(empty)


def envelope(errors: DataFrame, report: DataFrame, found: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per file: its error, report, account and lists of issues, as one record to hand on."""
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("severity") == kind, F.struct("row_no", "code"))))
    told = found.groupBy("file").agg(listed("error").alias("errors"), listed("warning").alias("warnings"))
    return errors.join(report, "file", "left").join(metadata, "file", "left").join(told, "file", "left")
