"""Queries of the read surface and of the projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import categorize as C
from ledgerloom.operators import projection as P
from ledgerloom.operators import reads as B

from .queries_categories import CANDIDATES_SQL, OUTCOMES_SQL
from .registering import registry
from .sample_ledger import LEDGER_SQL, RULES_SQL, categories, ledger, rules, table

QUERIES, ORACLES, query = registry()
L = f"with {LEDGER_SQL}"


def _count(name="n"):
    return F.count(F.lit(1)).alias(name)


def _candidates(spark, sf_dir):
    return C.ranked(C.candidates(C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir))))


def _pending(spark, sf_dir):
    return C.pending_items(C.outcomes(ledger(spark, sf_dir), rules(spark, sf_dir), categories(spark)))


@query(L + " select id, date::varchar as date, amount from ledger where company_id = 'company-3' and bank_account_id = 'acct-O'")
def txn_filter(spark, sf_dir):
    return B.transactions_where(ledger(spark, sf_dir), "company-3", "acct-O").select("id", F.col("date").cast("string").alias("date"), "amount")


@query(OUTCOMES_SQL + " select pending_type, severity, count(*) as n from pending where status in ('open', 'in_review') group by all")
def pending_open(spark, sf_dir):
    return _pending(spark, sf_dir).where(F.col("status").isin("open", "in_review")).groupBy("pending_type", "severity").agg(_count())


@query(L + " select company_id, count(*) as n from ledger where category_id is not null group by company_id")
def categorized_count(spark, sf_dir):
    return ledger(spark, sf_dir).where(F.col("category_id").isNotNull()).groupBy("company_id").agg(_count())


@query(L + " select id, category_id from ledger where category_id not in ('ECONOMY', 'SMALL')")
def not_in_filter(spark, sf_dir):
    return ledger(spark, sf_dir).where(~F.col("category_id").isin("ECONOMY", "SMALL")).select("id", "category_id")


@query(OUTCOMES_SQL + " select company_id, transaction_id, category_id from ranked r where exists (select 1 from pending p where p.company_id = r.company_id and p.transaction_id = r.transaction_id)")
def suggestions_pending_semi(spark, sf_dir):
    return B.having(_candidates(spark, sf_dir), _pending(spark, sf_dir), ["company_id", "transaction_id"]).select("company_id", "transaction_id", "category_id")


@query(OUTCOMES_SQL + " select company_id, transaction_id, category_id from ranked r where not exists (select 1 from pending p where p.company_id = r.company_id and p.transaction_id = r.transaction_id)")
def suggestions_pending_anti(spark, sf_dir):
    return B.lacking(_candidates(spark, sf_dir), _pending(spark, sf_dir), ["company_id", "transaction_id"]).select("company_id", "transaction_id", "category_id")


@query(CANDIDATES_SQL + " select transaction_id, category_id, c.expected_type, c.is_active from ranked left join categories c using (category_id)")
def txn_with_category(spark, sf_dir):
    return _candidates(spark, sf_dir).join(categories(spark), "category_id", "left").select("transaction_id", "category_id", "expected_type", "is_active")


@query("with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) select c_custkey, coalesce(array_to_string(list(o_orderkey order by n) filter (n <= 10), ','), '') as latest from customer left join o on c_custkey = o_custkey group by c_custkey")
def suggestion_nested(spark, sf_dir):
    """Customers with their ten latest orders."""
    orders = table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    found = B.nested(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], ["o_orderkey"], 10, "orders")
    return found.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("latest"))


@query(L + " select company_id, id, row_number() over (partition by company_id order by type, date desc, amount, id) as place from ledger")
def multi_key_sort(spark, sf_dir):
    from pyspark.sql.window import Window

    order = Window.partitionBy("company_id").orderBy("type", F.desc("date"), "amount", "id")
    return ledger(spark, sf_dir).select("company_id", "id", F.row_number().over(order).cast("long").alias("place"))


@query(L + " select id, date::varchar as date, amount, description from ledger order by ledger.date desc, id desc limit 200")
def recent_transactions(spark, sf_dir):
    return B.recent(ledger(spark, sf_dir), 500).select("id", F.col("date").cast("string").alias("date"), "amount", "description")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_import(spark, sf_dir):
    return B.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(OUTCOMES_SQL + """, t as (select company_id, count(*) as transactions, count(category_id) as categorized, count(*) filter (type = 'income') as income_rows, count(*) filter (type = 'expense') as expense_rows, sum(floor(amount * 100 + 0.5))::bigint as balance_cents from ledger group by 1),
  q as (select company_id, count(*) as open_items, count(*) filter (severity = 'high') as high_items from pending group by 1)
  select t.*, coalesce(open_items, 0) as open_items, coalesce(high_items, 0) as high_items from t left join q using (company_id)""")
def dashboard_summary(spark, sf_dir):
    return B.dashboard(ledger(spark, sf_dir), _pending(spark, sf_dir))


@query(L + " select type, count(*) as n from ledger group by type")
def count_by_type(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("type").agg(_count())


@query(L + " select company_id, category_id, count(*) as n from ledger where category_id is not null group by all")
def count_by_company_category(spark, sf_dir):
    return ledger(spark, sf_dir).where("category_id is not null").groupBy("company_id", "category_id").agg(_count())


@query(L + " select count(distinct (company_id, type, counterparty_name)) as n_keys from ledger where counterparty_name is not null")
def distinct_recurrence_keys(spark, sf_dir):
    return ledger(spark, sf_dir).agg(F.count_distinct("company_id", "type", "counterparty_name").alias("n_keys"))


@query(L + " select company_id, bank_account_id, type from ledger group by all")
def distinct_list(spark, sf_dir):
    return ledger(spark, sf_dir).select("company_id", "bank_account_id", "type").dropDuplicates()


@query(L + """, b as (select company_id, count(*) as n, count(category_id) as k from ledger where date < date '1998-07-01' group by 1), a as (select company_id, count(*) as n, count(category_id) as k from ledger group by 1)
  select a.company_id, greatest(a.n - coalesce(b.n, 0), 0) as transactions_delta, greatest(a.k - coalesce(b.k, 0), 0) as categorized_delta from a left join b using (company_id)""")
def post_import_delta(spark, sf_dir):
    counted = lambda rows: rows.groupBy("company_id").agg(_count("transactions"), F.count("category_id").alias("categorized"))
    rows = ledger(spark, sf_dir)
    return B.deltas(counted(rows.where("date < date '1998-07-01'")), counted(rows), ["company_id"], ["transactions", "categorized"])


@query("select l_orderkey, count(*) as n from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P') group by 1")
def orphan_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return B.orphans(table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"]).groupBy("l_orderkey").agg(_count())


@query("select c_custkey, case when c_acctbal < 0 then 0.0 else c_acctbal end as balance from customer")
def upsert_rows(spark, sf_dir):
    state = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return B.upsert(state, state.where("balance < 0").withColumn("balance", F.lit(0.0)), ["c_custkey"])


@query(L + " select company_id, type, case when company_id = 'company-1' then -1 else n end as n from (select company_id, type, count(*) as n from ledger group by all) where company_id <> 'company-1' or type = 'income'")
def replaced_partition(spark, sf_dir):
    state = ledger(spark, sf_dir).groupBy("company_id", "type").agg(_count())
    fresh = state.where("company_id = 'company-1' and type = 'income'").withColumn("n", F.lit(-1).cast("long"))
    return B.replace_partition(state, fresh, ["company_id"])


MEMBERS = "select c_custkey as user_id, 'company-' || (c_custkey % 10) as company_id, case c_nationkey % 4 when 0 then 'viewer' when 1 then 'accountant' when 2 then 'admin' end as role from customer"


def _members(spark, sf_dir):
    role = F.when(F.col("c_nationkey") % 4 == 0, "viewer").when(F.col("c_nationkey") % 4 == 1, "accountant").when(F.col("c_nationkey") % 4 == 2, "admin")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("company-"), (F.col("c_custkey") % 10).cast("string")).alias("company_id"), role.alias("role"))


@query(f"with m as ({MEMBERS}), {LEDGER_SQL} select user_id, company_id, count(*) as n from m join ledger using (company_id) where role in ('accountant', 'admin') group by all")
def rbac_filter(spark, sf_dir):
    """How many transactions each user may review."""
    per_company = ledger(spark, sf_dir).groupBy("company_id").agg(_count())
    return B.permitted(per_company, _members(spark, sf_dir), "pending:review").select("user_id", "company_id", "n")


@query(f"with m as ({MEMBERS}), r(role, k) as (values ('viewer', 4), ('accountant', 10), ('admin', 13)) select user_id, k::bigint as n_rights from m join r using (role)")
def role_rights(spark, sf_dir):
    return B.rights(_members(spark, sf_dir)).groupBy("user_id").agg(_count("n_rights"))


RECURRENCES = """
recurrences as (
  select 'company-' || (o_custkey % 10) as company_id, o_orderkey as recurrence_id, case when o_orderkey % 11 = 0 then 'paused' else 'active' end as status,
    ['weekly', 'biweekly', 'monthly', 'yearly', 'unknown'][o_orderkey % 5 + 1] as frequency, case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) + 20 end as next_date,
    cast(o_orderdate as date) as start_date, case when o_orderkey % 7 = 0 then date '2001-08-20' end as end_date, case when o_orderkey % 4 = 0 then (o_orderkey % 97)::int end as installment_count, (o_orderkey % 5)::int as observed
  from orders)"""


def recurrences(spark, sf_dir):
    """Orders as approved recurrences."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return o.select(
        F.concat(F.lit("company-"), (F.col("o_custkey") % 10).cast("string")).alias("company_id"), key.alias("recurrence_id"), F.when(key % 11 == 0, "paused").otherwise("active").alias("status"),
        F.get(F.array(*map(F.lit, ("weekly", "biweekly", "monthly", "yearly", "unknown"))), (key % 5).cast("int")).alias("frequency"), F.when(key % 3 != 0, F.date_add(day, 20)).alias("next_date"),
        day.alias("start_date"), F.when(key % 7 == 0, F.lit("2001-08-20").cast("date")).alias("end_date"), F.when(key % 4 == 0, (key % 97).cast("int")).alias("installment_count"), (key % 5).cast("int").alias("observed"),
        F.col("o_totalprice").alias("amount"), F.lit("expense").alias("type"), F.col("o_orderpriority").alias("description"),
    )


DATES_SQL = f"""with recursive {RECURRENCES},
ready as (select *, coalesce(next_date, start_date) as first, case when installment_count is not null then greatest(installment_count - observed, 0) end as remaining from recurrences where status = 'active'),
walk(recurrence_id, frequency, cursor, taken) as (
  select recurrence_id, frequency, first, 0 from ready union all
  select recurrence_id, frequency, (case frequency when 'weekly' then cursor + 7 when 'biweekly' then cursor + 14 when 'monthly' then cursor + interval 1 month else cursor + interval 12 month end)::date, taken + 1
  from walk where cursor < date '2001-07-15' and frequency <> 'unknown'),
started as (select r.*, w.cursor from ready r join walk w using (recurrence_id) where w.cursor >= date '2001-07-15' and not coalesce(w.taken > 0 and w.taken >= remaining, false)),
emit(recurrence_id, frequency, date, place) as (
  select recurrence_id, frequency, cursor, 0 from started union all
  select recurrence_id, frequency, (case frequency when 'weekly' then date + 7 when 'biweekly' then date + 14 when 'monthly' then date + interval 1 month else date + interval 12 month end)::date, place + 1
  from emit where frequency <> 'unknown' and date <= date '2001-10-13'),
dated as (select s.company_id, recurrence_id, h.h as horizon_days, e.date from started s join emit e using (recurrence_id), (values (30), (60), (90)) h(h)
  where e.date <= date '2001-07-15' + h.h and coalesce(e.date <= s.end_date, true) and coalesce(e.place < remaining, true))"""


def _dates(found):
    return P.projection_dates(found, F.lit("2001-07-15")).withColumn("date", F.col("date").cast("string"))


def _items(found):
    items = P.projected_items(found, F.lit("2001-07-15"))
    return items.groupBy("company_id", "horizon_days").agg(_count("items"), F.count_distinct("recurrence_id").alias("series"), F.min("date").cast("string").alias("first_date"))


def _horizons(found):
    return P.projection_dates(found, F.lit("2001-07-15")).groupBy("company_id").pivot("horizon_days", list(P.HORIZONS)).agg(_count()).fillna(0)


_DATES_SQL = DATES_SQL + " select company_id, recurrence_id, horizon_days, date::varchar as date from dated"
_ITEMS_SQL = DATES_SQL + " select company_id, horizon_days, count(*) as items, count(distinct recurrence_id) as series, min(date)::varchar as first_date from dated group by all"
_HORIZONS_SQL = DATES_SQL + """ select company_id, count(*) filter (horizon_days = 30) as "30", count(*) filter (horizon_days = 60) as "60", count(*) filter (horizon_days = 90) as "90"
  from dated group by company_id"""


@query(_DATES_SQL)
def projection_dates(spark, sf_dir):
    return _dates(recurrences(spark, sf_dir))


@query(_ITEMS_SQL)
def projection(spark, sf_dir):
    return _items(recurrences(spark, sf_dir))


@query(_HORIZONS_SQL)
def projection_horizons(spark, sf_dir):
    return _horizons(recurrences(spark, sf_dir))


# Earlier names of the same queries, from when those above held a slice.
@query(_DATES_SQL)
def projection_dates_whole(spark, sf_dir):
    return projection_dates(spark, sf_dir)


@query(_ITEMS_SQL)
def projection_whole(spark, sf_dir):
    return projection(spark, sf_dir)


@query(_HORIZONS_SQL)
def projection_horizons_whole(spark, sf_dir):
    return projection_horizons(spark, sf_dir)
