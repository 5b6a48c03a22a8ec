"""Queries of the import operators, over line items written out as statement rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import money as M
from ledgerloom.functions.text import control_text
from ledgerloom.operators import ingest as I

from .registering import registry
from .sample_ledger import table
from .scratch import materialise

QUERIES, ORACLES, query = registry()

TEXTS = [
    "PIX TRANSF {p} {d}", "DA COPEL {k}778170", "DEB AUTOR {k}0000 {p}", "SISPAG  {p}", "ITAU BLACK 3111-{k}", "CREDIARIO ITAU {k}", "PAG TIT INT {k}/9", "SAQUE DIN ATM CART {k}", "iof", "Juros Limite da Conta",
    "SALDO ANTERIOR", "Total  {p}", "compra {p}", "PIX QRS 123 {d}", "DEB AUTOR {p}", "saldo total disponível dia",
]


def statement_lines(spark, sf_dir):
    """Line items as rows of a statement for each supplier, in the notations that banks use; some cannot be read."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = lines.join(parts, "l_partkey").withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")))
    n, day, cents = F.col("n"), F.to_date("l_shipdate"), F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    date = (
        F.when(n % 41 == 0, "31/02/1998").when(n % 53 == 0, "").when(n % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(n % 3 == 1, day.cast("string"))
        .otherwise(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    )
    whole, part = F.expr("cast(floor(l_extendedprice + 0.5) as bigint) div 100").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    money = (
        F.when(n % 43 == 0, "x").when(n % 47 == 0, "0,00").when(n % 5 == 0, F.concat(F.lit("R$ "), whole, F.lit(","), part)).when(n % 5 == 1, F.concat(F.lit("("), whole, F.lit(","), part, F.lit(")")))
        .when(n % 5 == 2, F.concat(F.lit("-"), whole, F.lit("."), part)).when(n % 5 == 3, F.concat(whole, F.lit(".000,"), part)).otherwise(F.concat(whole, F.lit(","), part))
    )
    text = None
    for i, t in enumerate(TEXTS):
        made = F.lit(t)
        for mark, value in (("{p}", F.upper("p_name")), ("{d}", F.date_format(day, "dd/MM")), ("{k}", F.col("l_partkey").cast("string"))):
            made = F.replace(made, F.lit(mark), value)
        text = F.when(n % len(TEXTS) == i, made) if text is None else text.when(n % len(TEXTS) == i, made)
    late = F.when(n == 200, "Lançamentos futuros").when(n == 260, "Informações adicionais").otherwise(text)
    return rows.select(
        F.concat(F.lit("statement-"), F.col("l_suppkey").cast("string")).alias("file"), n.alias("row_no"), F.concat(F.lit("company-"), (F.col("l_suppkey") % 7).cast("string")).alias("company_id"),
        F.concat(F.lit("acct-"), "l_linestatus").alias("bank_account_id"), date.alias("raw_date"), late.alias("raw_description"), money.alias("raw_amount"),
    )


def _text_sql() -> str:
    show = lambda t: "'" + t.replace("{p}", "' || upper(p_name) || '").replace("{d}", "' || strftime(l_shipdate, '%d/%m') || '").replace("{k}", "' || l_partkey || '") + "'"
    return "case n % 16 " + " ".join(f"when {i} then {show(t)}" for i, t in enumerate(TEXTS)) + " end"


CONTROL = "upper(strip_accents(trim(regexp_replace({}, '\\s+', ' ', 'g'))))"
LINES_SQL = f"""
numbered as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as n, floor(l_extendedprice + 0.5)::bigint as c from lineitem join part on l_partkey = p_partkey),
lines as (
  select 'statement-' || l_suppkey as file, n as row_no, 'company-' || (l_suppkey % 7) as company_id, 'acct-' || l_linestatus as bank_account_id,
    case when n % 41 = 0 then '31/02/1998' when n % 53 = 0 then '' when n % 3 = 0 then strftime(l_shipdate, '%d/%m/%Y') when n % 3 = 1 then strftime(l_shipdate, '%Y-%m-%d') else date_diff('day', date '1899-12-30', l_shipdate::date)::varchar end as raw_date,
    case when n = 200 then 'Lançamentos futuros' when n = 260 then 'Informações adicionais' else {_text_sql()} end as raw_description,
    case when n % 43 = 0 then 'x' when n % 47 = 0 then '0,00' when n % 5 = 0 then 'R$ ' || (c // 100) || ',' || lpad((c % 100)::varchar, 2, '0') when n % 5 = 1 then '(' || (c // 100) || ',' || lpad((c % 100)::varchar, 2, '0') || ')'
      when n % 5 = 2 then '-' || (c // 100) || '.' || lpad((c % 100)::varchar, 2, '0') when n % 5 = 3 then (c // 100) || '.000,' || lpad((c % 100)::varchar, 2, '0') else (c // 100) || ',' || lpad((c % 100)::varchar, 2, '0') end as raw_amount
  from numbered),
read as (
  select *, case when regexp_matches(raw_date, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') then try_strptime(raw_date, '%d/%m/%Y')::date when regexp_matches(raw_date, '^[0-9]{{4}}-') then try_strptime(raw_date, '%Y-%m-%d')::date
      when regexp_matches(raw_date, '^[0-9]{{1,6}}$') then date '1899-12-30' + raw_date::int end as date,
    case when raw_amount = 'x' then null when starts_with(raw_amount, 'R$ ') then replace(raw_amount[4:], ',', '.')::double when starts_with(raw_amount, '(') then -replace(raw_amount[2:-2], ',', '.')::double
      when contains(raw_amount, ',') then replace(replace(raw_amount, '.', ''), ',', '.')::double else raw_amount::double end as plain, {CONTROL.format('raw_description')} as control
  from lines),
amounts as (select *, floor((plain + 2.220446049250313e-16) * 100 + 0.5) / 100.0::double as amount from read)"""
LINES_SQL = LINES_SQL.replace("raw_amount[2:-2]", "raw_amount[2:length(raw_amount) - 1]")
#: A group of thousands longer than three digits is no pt-BR amount, as in 12345.000,67.
LINES_SQL = LINES_SQL.replace("when contains(raw_amount, ',') then replace(replace", "when contains(raw_amount, '.000,') and strpos(raw_amount, '.') > 4 then null when contains(raw_amount, ',') then replace(replace")
DISPOSED_SQL = LINES_SQL + """,
marks as (select *, bool_or(control in ('LANCAMENTOS FUTUROS', 'SAIDAS FUTURAS')) over w as is_future, bool_or(control in ('POSICAO CONSOLIDADA', 'LIMITES', 'AVISO!') or starts_with(control, 'INFORMACOES ADICIONAIS')) over w as done
  from amounts window w as (partition by file order by row_no)),
disposed as (
  select *, case when is_future then 'future' when control in ('SALDO ANTERIOR', 'LIMITE DA CONTA') or (starts_with(control, 'SALDO TOTAL DISPON') and ends_with(control, 'VEL DIA'))
        or starts_with(control, 'TOTAL ') or starts_with(control, 'RESUMO ') then 'ignored'
      when date is null or amount is null or amount = 0 then 'invalid' else 'candidate' end as disposition
  from marks where not done and control not in ('LANCAMENTOS FUTUROS', 'SAIDAS FUTURAS') and regexp_matches(raw_date, '[0-9]'))"""


def _party_sql() -> str:
    arms = []
    for pattern, rule, name, document, constant in I.COUNTERPARTY_RULES:
        party = f"'{constant}'" if constant else "null" if name is None else f"trim(regexp_extract(t, '{pattern}', {name}))"
        if rule.startswith("pix"):
            party = f"case when regexp_matches({party}, '(?i)[A-ZÀ-ÖØ-Ý]') then {party} end"
        number = "null" if document is None else f"regexp_extract(t, '{pattern}', {document})"
        arms.append(f"when regexp_matches(t, '{pattern}') then {{'p': {party}, 'd': {number}, 'r': '{rule}'}}")
    return "case " + " ".join(arms) + " else {'p': null, 'd': null, 'r': null} end"


def _fields_sql(fields: dict[str, str]) -> str:
    """A record: name and value of each field, each after its length. The data hold no astral characters."""
    return " || ".join(f"'{len(n)}:{n}' || length({v}) || ':' || {v}" for n, v in fields.items())


KEY_SQL = _fields_sql({
    "externalIdVersion": "'hash-v1'", "bank": "'itau'", "companyId": "company_id", "bankAccountId": "bank_account_id", "date": "date::varchar",
    "amountMinorUnits": "(floor((amount + 2.220446049250313e-16) * 100 + 0.5)::bigint)::varchar", "normalizedDescription": "upper(description)",
    "documentComponent": "upper(trim(coalesce(document_number, '')))",
})
ID_SQL = "'hash-v1:' || sha256(" + _fields_sql({"base": "base_key", "occurrenceIndex": "(row_number() over (partition by file, base_key order by row_no))::varchar"}) + ")"
PRINT_SQL = "sha256(" + _fields_sql({
    "source": "'xlsx'", "sourceFileId": "file", "sourceRowNumber": "row_no::varchar", "pageNumber": "''", "rawDate": "coalesce(raw_date, '')",
    "rawDescription": "coalesce(raw_description, '')", "rawAmount": "coalesce(raw_amount, '')",
}) + ")"


CANONICAL_SQL = DISPOSED_SQL + f""",
told as (select *, trim(regexp_replace(raw_description, '\\s+', ' ', 'g')) as t from disposed where disposition = 'candidate' and amount <> 0),
party as (select *, t as description, {_party_sql()} as c from told),
parted as (select *, c.p as counterparty_name, c.d as document_number, c.r as counterparty_rule, case when amount > 0 then 'income' else 'expense' end as type from party),
keyed as (select *, {KEY_SQL} as base_key from parted),
canonical as (select *, row_number() over (partition by file, base_key order by row_no)::int as occurrence, {ID_SQL} as external_id from keyed)"""


def _disposed(spark, sf_dir):
    return I.dispositions(statement_lines(spark, sf_dir))


def _canonical(spark, sf_dir, disposed=None):
    return I.canonical((disposed or _disposed(spark, sf_dir)).where("disposition = 'candidate'"))


@query("select page_id, coalesce(nullif(trim(left(regexp_replace(coalesce(url, ''), '[^a-zA-Z0-9._ -]', '_', 'g'), 180)), ''), 'bank-statement') as name from pages")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.safe_name(F.col("url")).alias("name"))


@query(f"with {LINES_SQL} select file, row_no, control in ('SALDO ANTERIOR', 'POSICAO CONSOLIDADA', 'LIMITES', 'LIMITE DA CONTA') or (starts_with(control, 'SALDO TOTAL DISPON') and ends_with(control, 'VEL DIA')) or starts_with(control, 'TOTAL ') or starts_with(control, 'RESUMO ') as noise from amounts")
def noise_filter(spark, sf_dir):
    return statement_lines(spark, sf_dir).select("file", "row_no", I.is_noise(control_text(F.col("raw_description"))).alias("noise"))


@query(f"with {LINES_SQL} select file, row_no, raw_date, date::varchar as date from amounts")
def parse_dates(spark, sf_dir):
    return statement_lines(spark, sf_dir).select("file", "row_no", "raw_date", M.parse_date(F.col("raw_date")).cast("string").alias("date"))


@query(f"with {LINES_SQL} select file, row_no, raw_amount, amount from amounts")
def parse_money(spark, sf_dir):
    return statement_lines(spark, sf_dir).select("file", "row_no", "raw_amount", M.parse_money(F.col("raw_amount")).alias("amount"))


@query(f"with {DISPOSED_SQL} select file, row_no, disposition from disposed")
def stmt_disposition(spark, sf_dir):
    return _disposed(spark, sf_dir).select("file", "row_no", "disposition")


@query(f"with {CANONICAL_SQL} select file, row_no, counterparty_name, document_number, counterparty_rule from canonical")
def counterparty_extract(spark, sf_dir):
    return _canonical(spark, sf_dir).select("file", "row_no", "counterparty_name", "document_number", "counterparty_rule")


@query(f"with {CANONICAL_SQL} select file, row_no, date::varchar as date, amount, type, description from canonical")
def canonical_txn(spark, sf_dir):
    return _canonical(spark, sf_dir).select("file", "row_no", F.col("date").cast("string").alias("date"), "amount", "type", "description")


@query(f"with {CANONICAL_SQL} select file, row_no, base_key from canonical")
def identity_key(spark, sf_dir):
    return _canonical(spark, sf_dir).select("file", "row_no", "base_key")


@query(f"with {CANONICAL_SQL} select file, row_no, occurrence from canonical")
def occurrence_index(spark, sf_dir):
    return _canonical(spark, sf_dir).select("file", "row_no", "occurrence")


@query(f"with {CANONICAL_SQL} select file, row_no, external_id from canonical")
def external_id(spark, sf_dir):
    return _canonical(spark, sf_dir).select("file", "row_no", "external_id")


@query(f"with {LINES_SQL} select file, row_no, {PRINT_SQL} as fingerprint from lines")
def row_fingerprint(spark, sf_dir):
    c, none = F.col, F.lit(None).cast("string")
    made = I.fingerprint(F.lit("xlsx"), c("file"), c("row_no"), none, c("raw_date"), c("raw_description"), c("raw_amount"))
    return statement_lines(spark, sf_dir).select("file", "row_no", made.alias("fingerprint"))


@query(f"with {CANONICAL_SQL} select file, row_no, row_number() over (partition by file, base_key order by row_no) > 1 as is_duplicate from canonical")
def dedupe_exact(spark, sf_dir):
    return I.first_of_each(_canonical(spark, sf_dir)).select("file", "row_no", "is_duplicate")


@query(f"""with {DISPOSED_SQL}, r as (select file, row_no, company_id, case when row_no % 10 = 0 then '' else bank_account_id end as bank_account_id, date, amount, case when row_no % 9 = 0 then '' else raw_description end as description, 'income' as type from disposed)
  select file, row_no, unnest(list_filter([case when trim(bank_account_id) = '' then 'MISSING_BANK_ACCOUNT_ID' end, case when date is null then 'INVALID_DATE' end,
    case when amount is null then 'INVALID_AMOUNT' end, case when amount = 0 then 'ZERO_AMOUNT' end, case when trim(description) = '' then 'MISSING_DESCRIPTION' end,
    case when amount < 0 then 'INVALID_TRANSACTION_TYPE' end, case when row_no % 8 = 0 then 'INVALID_EXTERNAL_ID' end], lambda x: x is not null)) as code from r""")
def validate_rows(spark, sf_dir):
    n = F.col("row_no")
    rows = _disposed(spark, sf_dir).select(
        "file", "row_no", "company_id", F.when(n % 10 == 0, "").otherwise(F.col("bank_account_id")).alias("bank_account_id"), M.parse_date(F.col("raw_date")).alias("date"), M.parse_money(F.col("raw_amount")).alias("amount"),
        F.when(n % 9 == 0, "").otherwise(F.col("raw_description")).alias("description"), F.lit("income").alias("type"), F.when(n % 8 == 0, "v0:").otherwise("hash-v1:").alias("external_id"),
    )
    return I.row_issues(rows)


@query(f"""with {CANONICAL_SQL}, c as (select file, count(*) as total_rows, count(*) filter (disposition in ('ignored', 'future')) as ignored_rows, count(*) filter (disposition = 'invalid') as invalid_rows from disposed group by file),
  f as (select file, count(*) filter (occurrence > 1) as duplicate_rows, count(*) filter (occurrence = 1) as imported_rows, min(date)::varchar as period_start, max(date)::varchar as period_end from canonical group by file)
  select c.*, coalesce(duplicate_rows, 0) as duplicate_rows, coalesce(imported_rows, 0) as imported_rows, period_start, period_end, total_rows - invalid_rows as parsed_rows,
    case when invalid_rows = 0 then 'success' when coalesce(imported_rows, 0) > 0 or coalesce(duplicate_rows, 0) > 0 then 'partial_success' else 'failed' end as status from c left join f using (file)""")
def import_report(spark, sf_dir):
    disposed = materialise(_disposed(spark, sf_dir), "disposed")
    report = I.import_report(disposed, I.first_of_each(_canonical(spark, sf_dir, disposed)))
    return report.withColumn("period_start", F.col("period_start").cast("string")).withColumn("period_end", F.col("period_end").cast("string"))


@query("select l_returnflag, l_linestatus, l_linenumber, case when l_linenumber % 3 = 0 then 'success' when l_quantity > 25 or l_linenumber = 1 then 'partial_success' else 'failed' end as status, count(*) as n from lineitem group by all")
def import_status(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    status = I.import_status(F.col("l_linenumber") % 3, F.when(F.col("l_quantity") > 25, 1).otherwise(0), F.when(F.col("l_linenumber") == 1, 1).otherwise(0))
    return x.withColumn("status", status).groupBy("l_returnflag", "l_linestatus", "l_linenumber", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CANONICAL_SQL}, ledger as (select distinct company_id, bank_account_id, external_id from canonical where row_no % 2 = 0) select file, row_no, external_id from canonical c anti join ledger using (company_id, bank_account_id, external_id) qualify row_number() over (partition by company_id, bank_account_id, external_id order by file, row_no) = 1")
def idempotent_load(spark, sf_dir):
    rows = materialise(_canonical(spark, sf_dir).select("file", "row_no", "company_id", "bank_account_id", "external_id"), "canonical")
    return I.new_rows(rows, rows.where("row_no % 2 = 0")).select("file", "row_no", "external_id")
