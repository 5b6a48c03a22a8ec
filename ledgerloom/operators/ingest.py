"""From statement rows to the ledger: dispositions, canonical rows, identities, issues, reports and idempotent loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import minor_units, parse_date, parse_money
from ledgerloom.functions.text import control_text, statement_text

EXTERNAL_ID_VERSION = "hash-v1"
MAX_FILE_BYTES = 10 * 1024 * 1024
EXTENSIONS = ("xls", "xlsx", "pdf")

#: Fixed values: (pattern, name of the rule, group of the counterparty, group of the document, constant counterparty), first match wins.
COUNTERPARTY_RULES = [
    (r"(?i)^PIX\s+TRANSF\s+(.+?)\s*([0-9]{2}/[0-9]{2})$", "pix-transf-v1", 1, None, None),
    (r"(?i)^PIX\s+QRS\s+(.+?)\s*([0-9]{2}/[0-9]{2})$", "pix-qrs-v1", 1, None, None),
    (r"(?i)^DA\s+(.+?)\s+([0-9][0-9A-Z./-]*)$", "direct-debit-v1", 1, 2, None),
    (r"(?i)^DEB\s+AUTOR\s+([0-9]{4,})\s+(.+)$", "authorized-debit-v1", 2, 1, None),
    (r"(?i)^DEB\s+AUTOR\s+(.+)$", "authorized-debit-v1", 1, None, None),
    (r"(?i)^SISPAG\s+(.+)$", "sispag-v1", 1, None, None),
    (r"(?i)^ITAU\s+BLACK\s+([0-9-]+)$", "itau-black-v1", None, 1, "ITAU BLACK"),
    (r"(?i)^CREDIARIO\s+ITAU\s+([0-9]+)$", "crediario-itau-v1", None, 1, "ITAU"),
    (r"(?i)^PAG\s+TIT\s+INT\s+([0-9A-Z./-]+)$", "internal-title-v1", None, 1, None),
    (r"(?i)^SAQUE\s+DIN\s+ATM\s+CART\s+([0-9A-Z./-]+)$", "atm-withdrawal-v1", None, 1, None),
    (r"(?i)^IOF$", "itau-bank-charge-v1", None, None, "ITAU"),
    (r"(?i)^JUROS\s+LIMITE\s+DA\s+CONTA$", "itau-overdraft-interest-v1", None, None, "ITAU"),
]


def file_type(content: Column) -> Column:
    """``pdf``, ``xls``, ``xlsx`` or ``unknown`` by the first bytes; a zip is a workbook only with its two main parts."""
    head = F.hex(F.substring(content, 1, 8))
    raw = F.decode(content, "ISO-8859-1")
    workbook = raw.contains("[Content_Types].xml") & raw.contains("xl/workbook.xml")
    return F.when(head.startswith("255044462D"), "pdf").when(head == "D0CF11E0A1B11AE1", "xls").when(head.startswith("504B") & workbook, "xlsx").otherwise("unknown")


def validated_files(files: DataFrame) -> DataFrame:
    """Files (path, length, content) with detected_type and error: the first rule that a file breaks, or null."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = file_type(F.col("content"))
    error = (
        F.when(~extension.isin(*EXTENSIONS), "UNSUPPORTED_EXTENSION").when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > MAX_FILE_BYTES, "FILE_TOO_LARGE")
        .when((found == "unknown") | (found != extension), "INVALID_MIME_TYPE")
    )
    return files.select("path", "length", found.alias("detected_type"), F.sha2("content", 256).alias("sha256"), error.alias("error"))


def requested_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``validated_files`` of the paths of ``wanted``; FILE_NOT_FOUND where there is no file at a path, INVALID_FILE where
    there is no path. ``files`` are those that a reader found (path, length, content)."""
    asked = wanted.select("path").distinct()
    found = asked.where("path is not null").join(validated_files(files), "path", "left")
    found = found.withColumn("error", F.when(F.col("length").isNull(), "FILE_NOT_FOUND").otherwise(F.col("error")))
    none = asked.where("path is null").select("path", *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c not in ("path", "error")], F.lit("INVALID_FILE").alias("error"))
    return found.unionByName(none)


def safe_name(name: Column) -> Column:
    """A file name of safe characters, at most 180 of them; ``bank-statement`` for an empty one."""
    cleaned = F.trim(F.left(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9._ -]", "_"), F.lit(180)))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("bank-statement"))


def is_noise(t: Column) -> Column:
    """Of a text in control form (as all marks below): a balance or total that is no entry."""
    return t.isin("SALDO ANTERIOR", "POSICAO CONSOLIDADA", "LIMITES", "LIMITE DA CONTA") | (t.startswith("SALDO TOTAL DISPON") & t.endswith("VEL DIA")) | t.startswith("TOTAL ") | t.startswith("RESUMO ")


def opens_future(t: Column) -> Column:
    return t.isin("LANCAMENTOS FUTUROS", "SAIDAS FUTURAS")


def opens_summary(t: Column) -> Column:
    return t.isin("POSICAO CONSOLIDADA", "LIMITES", "AVISO!") | t.startswith("INFORMACOES ADICIONAIS")


def is_header(cells: Column) -> Column:
    t = control_text(F.array_join(cells, " "))
    return t.contains("DATA") & t.contains("LANCAMENTO") & t.contains("VALOR")


def layout_score(cells: DataFrame) -> DataFrame:
    """How much a workbook (file, sheet, row_no, cells) looks like a statement, 0 to 1, and whether that is enough."""
    sheet, text = control_text(F.col("sheet")), control_text(F.array_join("cells", " "))
    grouped = cells.groupBy("file").agg(
        F.bool_or(sheet == "LANCAMENTOS").alias("sheet"), F.bool_or(sheet == "POSICAO CONSOLIDADA").alias("summary"),
        F.bool_or((F.col("row_no") <= 15) & is_header(F.col("cells"))).alias("header"), F.bool_or(text.contains("ITAU")).alias("marker"),
    )
    points = lambda c, n: F.when(F.col(c), n).otherwise(0.0)
    score = points("sheet", 0.25) + points("summary", 0.10) + points("header", 0.45) + points("marker", 0.20)
    return grouped.select("file", score.alias("score"), (F.col("header") & F.col("marker") & (score >= 0.75)).alias("supported"))


def dispositions(rows: DataFrame, stops_at_summary: bool = True, text: str = "raw_description", own_text: str | None = None) -> DataFrame:
    """Rows (file, row_no, raw_date, raw_description, raw_amount) of a statement with their disposition.

    Rows before the first summary mark count (a workbook stops there; with ``stops_at_summary`` false the mark only ends
    the section); after a mark for future entries rows are ``future``. A row without a date or description is dropped;
    noise is ``ignored``; a date or amount that cannot be read, or a zero amount, is ``invalid``; the rest are
    ``candidate``. Marks are looked for in ``text``, noise in ``own_text`` or, without it, in ``text`` too.
    """
    order = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows, control = rows.withColumn("_control", control_text(F.col(text))), F.col("_control")
    own = control_text(F.col(own_text)) if own_text else control
    seen = lambda c: F.max(F.when(c, 1).otherwise(0)).over(order) == 1
    marked = rows.withColumn("_future", seen(opens_future(control))).withColumn("_done", seen(opens_summary(control)))
    kept = marked.where(~F.col("_done") | F.lit(not stops_at_summary)).where(~opens_future(control) & ~opens_summary(control) & F.col("raw_date").rlike("[0-9]") & (own != ""))
    amount = parse_money(F.col("raw_amount"))
    rule = (
        F.when(F.col("_done"), "ignored").when(F.col("_future"), "future").when(is_noise(own), "ignored")
        .when(parse_date(F.col("raw_date")).isNull() | amount.isNull() | (amount == 0), "invalid").otherwise("candidate")
    )
    return kept.withColumn("disposition", rule).drop("_future", "_done", "_control")


def with_counterparty(rows: DataFrame, text: str) -> DataFrame:
    """Adds counterparty_name, document_number and counterparty_rule, read from a column of cleaned descriptions; all
    null when no rule matches. The first rule that matches is found once, its parts are then read by its number."""
    number = F.coalesce(*[F.when(F.col(text).rlike(pattern), i) for i, (pattern, *_) in enumerate(COUNTERPARTY_RULES)])
    rows = rows.withColumn("_rule", number)

    def by_rule(values: list[Column | None]) -> Column:
        chosen = F.lit(None).cast("string")
        for i, value in enumerate(values):
            if value is not None:
                chosen = F.when(F.col("_rule") == i, value).otherwise(chosen)
        return chosen

    part = lambda pattern, group: F.trim(F.regexp_extract(text, pattern, group))
    names = [F.lit(constant) if constant else part(pattern, name) if name else None for pattern, _, name, _, constant in COUNTERPARTY_RULES]
    documents = [part(pattern, document) if document else None for pattern, _, _, document, _ in COUNTERPARTY_RULES]
    party = by_rule(names)
    # A payee of a PIX payment needs a letter.
    rows = rows.withColumn("counterparty_name", party).withColumn("counterparty_name", F.when((F.col("_rule") > 1) | F.col("counterparty_name").rlike("(?iu)[A-ZÀ-ÖØ-Ý]"), F.col("counterparty_name")))
    rule = F.get(F.array(*[F.lit(name) for _, name, *_ in COUNTERPARTY_RULES]), F.col("_rule"))
    return rows.withColumn("document_number", by_rule(documents)).withColumn("counterparty_rule", rule).drop("_rule")


def serialised(fields: dict[str, Column]) -> Column:
    """Every field with the length of its name and of its value in UTF-16 units, so that no two records run together."""
    units = lambda v: (F.octet_length(F.encode(v, "UTF-16BE")) / 2).cast("int").cast("string")
    return F.concat(*[F.concat(F.lit(f"{len(name)}:{name}"), units(value), F.lit(":"), value) for name, value in fields.items()])


def identity_key(bank: Column, company: Column, account: Column, date: Column, cents: Column, description: Column, document: Column) -> Column:
    """What makes a transaction the same one. ``description`` is cleaned already."""
    #: The names of the fields and their order.
    fields = {
        "externalIdVersion": F.lit(EXTERNAL_ID_VERSION), "bank": bank, "companyId": company, "bankAccountId": account, "date": date.cast("string"),
        "amountMinorUnits": cents.cast("string"), "normalizedDescription": F.upper(description), "documentComponent": F.upper(F.trim(F.coalesce(document, F.lit("")))),
    }
    return serialised(fields)


def external_id(base_key: Column, occurrence: Column) -> Column:
    """The id of the n-th transaction with a base key in a file."""
    return F.concat(F.lit(f"{EXTERNAL_ID_VERSION}:"), F.sha2(serialised({"base": base_key, "occurrenceIndex": occurrence.cast("string")}), 256))


def canonical(lines: DataFrame, bank: str = "itau") -> DataFrame:
    """Candidate lines (file, row_no, company_id, bank_account_id, raw_date, raw_description, raw_amount) as transactions.

    Adds base_key, occurrence (of the key, in file order), external_id and balance_after (of a raw_balance, null where
    that cannot be read). A zero amount is left out; ``dispositions`` has called it invalid.
    """
    lines = lines.withColumn("_text", statement_text(F.col("raw_description")))
    balance = F.col("raw_balance") if "raw_balance" in lines.columns else F.lit(None).cast("string")
    rows = lines.select(
        "file", "row_no", "company_id", "bank_account_id", parse_date(F.col("raw_date")).alias("date"), parse_money(F.col("raw_amount")).alias("amount"),
        F.col("_text").alias("description"), balance.alias("raw_balance"), parse_money(balance).alias("balance_after"),
    )
    rows = with_counterparty(rows, "description").where(F.col("date").isNotNull() & F.col("amount").isNotNull() & (F.col("amount") != 0))
    rows = rows.withColumn("type", F.when(F.col("amount") > 0, "income").otherwise("expense"))
    key = identity_key(F.lit(bank), F.col("company_id"), F.col("bank_account_id"), F.col("date"), minor_units(F.col("amount")), F.col("description"), F.col("document_number"))
    rows = rows.withColumn("base_key", key)
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("file", "base_key").orderBy("row_no")))
    return rows.withColumn("external_id", external_id(F.col("base_key"), F.col("occurrence")))


def fingerprint(source: Column, file_id: Column, row_no: Column, page: Column, date: Column, description: Column, amount: Column) -> Column:
    """A digest of where a row stands and of its raw values; null counts as empty."""
    #: The names of the fields and their order.
    names = ("source", "sourceFileId", "sourceRowNumber", "pageNumber", "rawDate", "rawDescription", "rawAmount")
    values = (source, file_id, row_no, page, date, description, amount)
    return F.sha2(serialised({n: F.coalesce(v.cast("string"), F.lit("")) for n, v in zip(names, values)}), 256)


def first_of_each(rows: DataFrame) -> DataFrame:
    """Adds is_duplicate: false for the first row of each identity in a file."""
    return rows.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("file", "base_key").orderBy("row_no")) > 1)


def row_issues(rows: DataFrame) -> DataFrame:
    """One row per broken rule of a transaction: id columns, code."""
    amount, income, expense = F.col("amount"), F.col("type").eqNullSafe("income"), F.col("type").eqNullSafe("expense")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    #: The codes.
    checks = {
        "MISSING_COMPANY_ID": blank("company_id"), "MISSING_BANK_ACCOUNT_ID": blank("bank_account_id"), "INVALID_DATE": F.col("date").isNull(),
        "INVALID_AMOUNT": amount.isNull() | F.isnan("amount"), "ZERO_AMOUNT": amount == 0, "MISSING_DESCRIPTION": blank("description"),
        "INVALID_TRANSACTION_TYPE": ((amount > 0) & ~income) | ((amount < 0) & ~expense),
        "INVALID_EXTERNAL_ID": ~F.coalesce(F.col("external_id"), F.lit("")).startswith(f"{EXTERNAL_ID_VERSION}:"),
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()]))
    return rows.select("file", "row_no", F.explode(codes).alias("code"))


def import_report(lines: DataFrame, rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Counts and period of each file. ``lines`` have dispositions, ``rows`` is_duplicate; parsed rows include ignored ones.

    The period is the one that ``metadata`` (file, period_start, period_end) tells, where it tells both ends, else that of
    the rows' dates.
    """
    counted = lines.groupBy("file").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("disposition").isin("ignored", "future")).alias("ignored_rows"), F.count_if(F.col("disposition") == "invalid").alias("invalid_rows"))
    found = rows.groupBy("file").agg(F.count_if("is_duplicate").alias("duplicate_rows"), F.count_if(~F.col("is_duplicate")).alias("imported_rows"), F.min("date").alias("period_start"), F.max("date").alias("period_end"))
    if metadata is not None:
        told = metadata.where("period_start is not null and period_end is not null").groupBy("file").agg(F.max(F.struct("period_start", "period_end")).alias("told"))
        found = found.join(told, "file", "full").withColumns({c: F.coalesce(f"told.{c}", c) for c in ("period_start", "period_end")}).drop("told")
    joined = counted.join(found, "file", "left").fillna(0, ["duplicate_rows", "imported_rows"]).withColumn("parsed_rows", F.col("total_rows") - F.col("invalid_rows"))
    return joined.withColumn("status", import_status(F.col("invalid_rows"), F.col("imported_rows"), F.col("duplicate_rows")))


def import_status(errors: Column, created: Column, skipped: Column) -> Column:
    return F.when(errors == 0, "success").when((created > 0) | (skipped > 0), "partial_success").otherwise("failed")


def new_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows to append: not in the ledger by company, account and external id, each once. Loading a file twice adds nothing."""
    keys = ["company_id", "bank_account_id", "external_id"]
    fresh = rows.join(ledger.select(*keys), keys, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "row_no"))).where("_n = 1").drop("_n")
