"""A bank ledger over the sample star schema, with its rules and categories, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (number, rule type, value, counterparty, low, high, category, priority, confidence, status, source)
RULES = [
    (1, "description_contains", "ring", None, None, None, "cat-rings", 50, 95, "active", "manual"),
    (2, "description_contains", "Bolt", None, None, None, "cat-hardware", 50, 95, "active", "seed"),
    (3, "description_contains", "hot  gear", None, None, None, "cat-gear", 60, 75, "active", "seed"),
    (4, "counterparty_equals", "Réd Widget", None, None, None, "cat-widgets", 80, 92, "active", "seed"),
    (5, "counterparty_contains", "gear", None, None, None, "cat-gear", 70, 88, "active", "correction_history"),
    (6, "document_equals", "000.000.000-00049", None, None, None, "cat-documents", 90, 99, "active", "seed"),
    (7, "amount_range", None, None, 900.0, 905.0, "cat-large", 10, 45, "active", "seed"),
    (8, "counterparty_and_amount_range", None, "blue bolt", 500.0, 1000.0, "cat-hardware", 75, 91, "active", "seed"),
    (9, "description_contains", "small", None, None, None, "cat-old", 40, 90, "active", "seed"),
    (10, "description_contains", "--", None, None, None, "cat-rings", 5, 20, "inactive", "manual"),
]
#: (category, expected type, active)
CATEGORIES = [
    ("cat-rings", "both", True), ("cat-hardware", "expense", True), ("cat-gear", "both", True), ("cat-widgets", "income", True),
    ("cat-documents", "both", True), ("cat-large", "both", True), ("cat-old", "both", False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item; the supplier is the company, amounts are whole cents."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_extendedprice", F.to_date("l_shipdate").alias("date")).join(
        parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey"
    )
    income = F.col("l_returnflag") == "R"
    amount = F.floor(F.col("l_extendedprice") + 0.5) / F.lit(100.0)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("company-"), F.col("l_suppkey").cast("string")).alias("company_id"),
        F.concat(F.lit("acct-"), "l_linestatus").alias("bank_account_id"),
        "date",
        F.when(income, amount).otherwise(-amount).alias("amount"),
        F.when(income, "income").otherwise("expense").alias("type"),
        F.concat(F.lit("PIX TRANSF "), F.upper("p_name"), F.lit(" "), F.date_format("date", "dd/MM")).alias("description"),
        F.when(F.col("l_partkey") % 5 == 0, F.upper("p_name")).alias("counterparty_name"),
        F.when(F.col("l_partkey") % 7 == 0, F.lpad(F.col("l_partkey").cast("string"), 14, "0")).alias("document_number"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("p_type")).alias("category_id"),
    )


def ledger_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger and a near copy of every row of each fiftieth part, as a bank might send it again."""
    rows = ledger(spark, sf_dir)
    part = F.element_at(F.split("id", "-"), 3).cast("long")
    copies = rows.where(part % 50 == 0).withColumn("id", F.concat("id", F.lit("-dup"))).withColumn("description", F.regexp_replace("description", r" ([0-9]{2}/[0-9]{2})$", " - $1"))
    return rows.unionByName(copies)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's copy of the sample rules."""
    kinds = "number int, rule_type string, value string, counterparty string, low double, high double, category_id string, priority int, confidence int, status string, source string"
    fields = [f.split() for f in kinds.split(", ")]
    listed = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(rule, fields)]) for rule in RULES])
    companies = table(spark, sf_dir, "supplier").select(F.concat(F.lit("company-"), F.col("s_suppkey").cast("string")).alias("company_id"))
    return companies.select("company_id", F.inline(listed)).withColumn("rule_id", F.concat_ws(":", "company_id", F.format_string("rule-%02d", "number")))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category_id string, expected_type string, is_active boolean")


def _values(rows) -> str:
    show = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::double" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


#: Common table expressions for the oracles.
LEDGER_SQL = """
ledger as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, 'company-' || l_suppkey as company_id, 'acct-' || l_linestatus as bank_account_id,
    cast(l_shipdate as date) as date, (case when l_returnflag = 'R' then 1 else -1 end) * (floor(l_extendedprice + 0.5) / 100.0::double) as amount,
    case when l_returnflag = 'R' then 'income' else 'expense' end as type, 'PIX TRANSF ' || upper(p_name) || ' ' || strftime(l_shipdate, '%d/%m') as description,
    case when l_partkey % 5 = 0 then upper(p_name) end as counterparty_name, case when l_partkey % 7 = 0 then lpad(l_partkey::varchar, 14, '0') end as document_number,
    case when l_partkey % 3 = 0 then p_type end as category_id
  from lineitem join part on l_partkey = p_partkey)"""
COPIES_SQL = LEDGER_SQL + r""",
copies as (
  select * from ledger union all
  select id || '-dup', company_id, bank_account_id, date, amount, type, regexp_replace(description, ' ([0-9]{2}/[0-9]{2})$', ' - \1'), counterparty_name, document_number, category_id
  from ledger where split_part(id, '-', 3)::bigint % 50 = 0)"""
RULES_SQL = f"""
listed(number, rule_type, value, counterparty, low, high, category_id, priority, confidence, status, source) as (values {_values(RULES)}),
rules as (select 'company-' || s_suppkey as company_id, listed.*, 'company-' || s_suppkey || ':' || format('rule-{{:02d}}', number) as rule_id from supplier, listed),
categories(category_id, expected_type, is_active) as (values {_values(CATEGORIES)})"""
