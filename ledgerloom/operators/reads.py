"""The read surface: filters, lookups, semi- and anti-joins, nested rows, top-N, dashboard counts and access rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What each role may do. A role also has the rights of the roles before it.
ROLE_RIGHTS = {
    "viewer": ["dashboard:view", "transactions:view", "recurrences:view", "projection:view"],
    "accountant": ["import:create", "pending:review", "categories:manage", "rules:manage", "duplicates:review", "recurrences:manage"],
    "admin": ["bankAccounts:manage", "company:manage", "users:manage"],
}
DEFAULT_LIMIT, MAX_LIMIT = 50, 200


def transactions_where(txns: DataFrame, company_id: str | None = None, account: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Transactions of a company, an account or a list of ids; a filter that is not given does not apply."""
    for condition in (company_id and F.col("company_id") == company_id, account and F.col("bank_account_id") == account, ids is not None and F.col("id").isin(ids or [""])):
        if not isinstance(condition, (bool, type(None))):
            txns = txns.where(condition)
    return txns


def recent(txns: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest transactions, by date and id descending; the limit is held between 1 and 200."""
    return txns.orderBy(F.desc("date"), F.desc("id")).limit(max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit)))


def having(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents with at least one child."""
    return parents.join(children.select(*keys), keys, "left_semi")


def lacking(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents without any child."""
    return parents.join(children.select(*keys), keys, "left_anti")


def nested(parents: DataFrame, children: DataFrame, keys: list[str], order: list[Column], fields: list[str], most: int, name: str) -> DataFrame:
    """Parents with their first ``most`` children as an array of structs; an empty array without any."""
    first = children.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)
    packed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias(name))
    packed = packed.withColumn(name, F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    joined = parents.join(packed, keys, "left")
    empty = F.filter(F.array(F.lit(None).cast(packed.schema[name].dataType.elementType)), lambda x: F.lit(False))
    return joined.withColumn(name, F.coalesce(name, empty))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dashboard(txns: DataFrame, pending: DataFrame) -> DataFrame:
    """Counts and sums of each company, in one pass over each table; zero where there is nothing."""
    t = txns.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("transactions"), F.count("category_id").alias("categorized"), F.count_if(F.col("type") == "income").alias("income_rows"),
        F.count_if(F.col("type") == "expense").alias("expense_rows"), F.coalesce(F.sum(F.floor(F.col("amount") * 100 + 0.5)), F.lit(0)).alias("balance_cents"),
    )
    p = pending.where(F.col("status").isin("open", "in_review")).groupBy("company_id").agg(F.count(F.lit(1)).alias("open_items"), F.count_if(F.col("severity") == "high").alias("high_items"))
    return t.join(p, "company_id", "left").fillna(0, ["open_items", "high_items"])


def deltas(before: DataFrame, after: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """How far each counter grew; never below zero."""
    b = before.select(*keys, *[F.col(c).alias(f"_{c}") for c in counters])
    return after.join(b, keys, "left").select(*keys, *[F.greatest(F.col(c) - F.coalesce(f"_{c}", F.lit(0)), F.lit(0)).alias(f"{c}_delta") for c in counters])


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent is missing, composite keys compared as a whole; children without a key are not orphans."""
    filled = children.where(" and ".join(f"{k} is not null" for k in keys))
    return filled.join(parents.select(*keys), keys, "left_anti")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: rows of ``changes`` replace rows of ``state`` with their key."""
    return state.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def replace_partition(state: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: every partition (``keys``) that ``fresh`` has is replaced by it as a whole."""
    return state.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def rights(memberships: DataFrame) -> DataFrame:
    """(user_id, company_id, right): what each membership's role allows."""
    granted, so_far = [], []
    for role, own in ROLE_RIGHTS.items():
        so_far = so_far + own
        granted.append((role, list(so_far)))
    table = F.create_map(*[x for role, names in granted for x in (F.lit(role), F.array(*map(F.lit, names)))])
    return memberships.select("user_id", "company_id", F.explode(F.element_at(table, F.col("role"))).alias("right"))


def permitted(rows: DataFrame, memberships: DataFrame, right: str) -> DataFrame:
    """(user_id, row): the rows of companies in which a user has ``right``."""
    return rows.join(rights(memberships).where(F.col("right") == right).select("user_id", "company_id"), "company_id")
