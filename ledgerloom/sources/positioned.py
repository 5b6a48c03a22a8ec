"""Statement lines from positioned text, as page readers give it: (file, page, x, y, text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import control_text

#: Items whose y differs by at most this from the first of a row belong to the row.
ROW_TOLERANCE = 1.5
MAX_PAGES = 50


def grouped_rows(items: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Adds row_no to items: down the page, then from the left. Rows are gathered greedily, so a page is one group."""

    def number(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x"], ascending=[False, True])
        rows, first = [], None
        for y in page["y"]:
            if first is None or abs(first - y) > tolerance:
                first = y
                rows.append((rows[-1] if rows else 0) + 1)
            else:
                rows.append(rows[-1])
        return page.assign(row_no=rows)[["file", "page", "row_no", "x", "y", "text"]]

    return items.groupBy("file", "page").applyInPandas(number, "file string, page int, row_no int, x double, y double, text string")


#: Fixed value: how a statement's dates are written.
DATE = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"


def statement_lines(items: DataFrame) -> DataFrame:
    """Rows by column band: date under 75, description to 400, amount to 500 (joined without a space), then balance.

    Of the texts in the band of dates the first one that is written as ``dd/mm/yyyy`` counts; others there are no dates.
    """
    rows = grouped_rows(items)
    x = F.col("x")
    band = lambda low, high, joint: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((x >= low) & (x < high), F.struct("x", "text")))), lambda i: i["text"]), joint)
    lines = rows.groupBy("file", "page", "row_no").agg(F.coalesce(F.min(F.when((x < 75) & F.trim("text").rlike(DATE), F.struct("x", F.trim("text").alias("text")))).getField("text"), F.lit("")).alias("raw_date"), band(75, 400, " ").alias("raw_description"), band(400, 500, "").alias("raw_amount"), band(500, float("inf"), "").alias("raw_balance"))
    return lines.withColumn("line_no", F.col("page") * 10000 + F.col("row_no"))


def document_status(items: DataFrame) -> DataFrame:
    """(file, error): too many pages, no text, or a layout that is not a statement; null when the file can be read."""
    text = control_text(F.col("text"))
    has = lambda part: F.bool_or(text.contains(part))
    facts = items.groupBy("file").agg(F.max("page").alias("pages"), F.count_if(F.trim("text") != "").alias("filled"), (has("ITAU") & has("EXTRATO CONTA CORRENTE") & has("LANCAMENTOS") & has("DATA") & has("VALOR (R$)")).alias("layout"))
    error = F.when(F.col("pages") > MAX_PAGES, "FILE_TOO_LARGE").when(F.col("filled") == 0, "SCANNED_PDF_NOT_SUPPORTED").when(~F.col("layout"), "UNSUPPORTED_LAYOUT")
    return facts.select("file", error.alias("error"))
