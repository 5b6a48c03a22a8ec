"""Queries of the categorisation and duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import categorize as C
from ledgerloom.operators import duplicates as D

from .registering import registry
from .sample_ledger import COPIES_SQL, LEDGER_SQL, RULES_SQL, categories, ledger, ledger_with_copies, rules, table

QUERIES, ORACLES, query = registry()

RULE_TEXT = "trim(regexp_replace(upper(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def n2(column: str) -> str:
    return RULE_TEXT.format(column)


NORMAL_SQL = f"""
norm as (
  select *, coalesce({n2('description')}, '') as n_description, nullif({n2('counterparty_name')}, '') as n_counterparty,
    nullif(regexp_replace(document_number, '[^0-9]', '', 'g'), '') as n_document, abs(amount) as abs_amount
  from ledger)"""
MATCH_SQL = f"""with {LEDGER_SQL}, {NORMAL_SQL}, {RULES_SQL},
active as (
  select company_id, rule_id, rule_type, category_id as rule_category, priority, confidence, source, {n2("nullif(trim(value), '')")} as r_text,
    nullif(regexp_replace(value, '[^0-9]', '', 'g'), '') as r_digits, {n2("nullif(trim(counterparty), '')")} as r_counterparty, low, high
  from rules where status = 'active'),
matches as (
  select n.*, r.rule_id, r.rule_type, r.rule_category, r.priority, r.confidence, r.source,
    case when rule_type = 'document_equals' then n_document when starts_with(rule_type, 'counterparty') then n_counterparty when starts_with(rule_type, 'description') then n_description
      else regexp_replace(abs_amount::decimal(18,2)::varchar, '\\.?0+$', '') end as matched_value
  from norm n join active r using (company_id)
  where case rule_type
    when 'document_equals' then n_document = r_digits
    when 'counterparty_equals' then n_counterparty = r_text
    when 'counterparty_contains' then contains(n_counterparty, r_text)
    when 'description_equals' then n_description = r_text
    when 'description_contains' then contains(n_description, r_text)
    when 'amount_range' then low <= high and abs_amount between low and high
    when 'counterparty_and_amount_range' then n_counterparty = r_counterparty and low <= high and abs_amount between low and high end)"""
CANDIDATES_SQL = MATCH_SQL + """,
placed as (
  select *, row_number() over (partition by company_id, id, rule_category order by priority desc, confidence desc, rule_id) as p, count(*) over (partition by company_id, id, rule_category) as n_rules from matches),
candidates as (
  select company_id, id as transaction_id, rule_category as category_id, rule_id, priority, least(100, confidence + least(5, 2 * (n_rules - 1)))::int as score,
    case when source = 'manual' then 'manual_rule' when source = 'correction_history' then 'correction_history' when rule_type = 'document_equals' then 'document_rule'
      when starts_with(rule_type, 'counterparty') then 'counterparty_rule' else 'description_rule' end as origin, matched_value, n_rules
  from placed where p = 1),
ranked as (
  select *, row_number() over (partition by company_id, transaction_id order by priority desc, score desc, category_id) as place,
    count(*) over (partition by company_id, transaction_id) > 1 as has_conflict from candidates)"""
OUTCOMES_SQL = CANDIDATES_SQL + """,
decided as (
  select l.company_id, l.id, l.type, l.category_id, r.category_id as suggested, r.rule_id, r.score, r.origin,
    case when l.category_id is not null then 'already_categorized' when r.category_id is null then 'uncategorized' when r.has_conflict then 'conflict'
      when not coalesce(c.is_active, false) then 'invalid_category' when not (c.expected_type = 'both' or c.expected_type = l.type) then 'incompatible_category'
      when r.score >= 90 then 'auto_applied' when r.score >= 60 then 'medium_review' else 'low_confidence' end as outcome
  from ledger l left join (select * from ranked where place = 1) r on r.company_id = l.company_id and r.transaction_id = l.id left join categories c on c.category_id = r.category_id),
pending as (
  select company_id, id as transaction_id,
    case outcome when 'medium_review' then 'category_review' when 'low_confidence' then 'low_confidence' when 'conflict' then 'rule_conflict' when 'uncategorized' then 'uncategorized'
      when 'invalid_category' then 'category_review' when 'incompatible_category' then 'category_review' end as pending_type,
    case when outcome in ('medium_review', 'uncategorized') then 'medium' else 'high' end as severity, 'open' as status
  from decided where outcome not in ('already_categorized', 'auto_applied'))"""


def _decided(spark, sf_dir):
    return C.outcomes(ledger(spark, sf_dir), rules(spark, sf_dir), categories(spark))


@query(f"with {LEDGER_SQL}, {NORMAL_SQL} select id, n_description, n_counterparty, n_document, abs_amount from norm")
def cat_normalize(spark, sf_dir):
    return C.normalized(ledger(spark, sf_dir)).select("id", "n_description", "n_counterparty", "n_document", "abs_amount")


@query(f"with {RULES_SQL} select company_id, rule_id, rule_type, priority, confidence, row_number() over (partition by company_id order by priority desc, confidence desc, rule_id) as place from rules where status = 'active'")
def active_rules(spark, sf_dir):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("priority"), F.desc("confidence"), "rule_id"))
    return C.active_rules(rules(spark, sf_dir)).select("company_id", "rule_id", "rule_type", "priority", "confidence", place.alias("place"))


@query(MATCH_SQL + " select id, rule_id, rule_type, rule_category, matched_value from matches")
def rule_match(spark, sf_dir):
    return C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir)).select("id", "rule_id", "rule_type", "rule_category", "matched_value")


@query(CANDIDATES_SQL + " select * from candidates")
def rule_candidates(spark, sf_dir):
    return C.candidates(C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir)))


@query(CANDIDATES_SQL + " select transaction_id, category_id, priority, score, place, has_conflict from ranked")
def rule_conflict(spark, sf_dir):
    return C.ranked(C.candidates(C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir)))).select("transaction_id", "category_id", "priority", "score", "place", "has_conflict")


@query(CANDIDATES_SQL + " select origin, count(*) as n from candidates group by origin")
def rule_origin(spark, sf_dir):
    return C.candidates(C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query(CANDIDATES_SQL + " select transaction_id, score, case when score >= 90 then 'high' when score >= 60 then 'medium' else 'low' end as band from candidates")
def confidence_band(spark, sf_dir):
    return C.candidates(C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir))).select("transaction_id", "score", C.confidence_band(F.col("score")).alias("band"))


@query(f"with {LEDGER_SQL}, {RULES_SQL} select c.category_id, l.type, count(*) as n, (c.expected_type = 'both' or c.expected_type = l.type) as fits from categories c, ledger l group by c.category_id, l.type, c.expected_type")
def category_compatibility(spark, sf_dir):
    types = ledger(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    joined = categories(spark).join(F.broadcast(types), F.lit(True))
    return joined.select("category_id", "type", "n", C.category_fits(F.col("expected_type"), F.col("type")).alias("fits"))


@query(OUTCOMES_SQL + " select id, suggested, rule_id, score, origin, outcome from decided")
def categorization_outcome(spark, sf_dir):
    return _decided(spark, sf_dir).select("id", "suggested", "rule_id", "score", "origin", "outcome")


@query(OUTCOMES_SQL + " select *, concat_ws(':', company_id, transaction_id, pending_type) as dedup_key from pending")
def pending_items(spark, sf_dir):
    return C.pending_items(_decided(spark, sf_dir))


@query(OUTCOMES_SQL + ", keyed as (select *, concat_ws(':', company_id, transaction_id, pending_type) as dedup_key from pending) select dedup_key, severity from keyed where not (pending_type = 'rule_conflict' and ends_with(transaction_id, '7'))")
def pending_without_open(spark, sf_dir):
    """Items that a rerun adds when the conflicts of some transactions are in review already."""
    items = C.pending_items(_decided(spark, sf_dir))
    held = items.where("pending_type = 'rule_conflict' and transaction_id like '%7'").withColumn("status", F.lit("in_review"))
    return C.without_open(items, held).select("dedup_key", "severity")


@query(OUTCOMES_SQL + " select company_id, id as transaction_id, suggested as category_id, rule_id, score from decided where outcome = 'auto_applied'")
def auto_applied(spark, sf_dir):
    return C.auto_applicable(_decided(spark, sf_dir))


@query(OUTCOMES_SQL + """ select company_id, count(*) as processed, count(*) filter (outcome = 'auto_applied') as auto_applied, count(*) filter (outcome = 'medium_review') as medium_review,
  count(*) filter (outcome = 'low_confidence') as low_confidence, count(*) filter (outcome = 'conflict') as conflicts, count(*) filter (outcome = 'uncategorized') as uncategorized,
  count(*) filter (outcome in ('invalid_category', 'incompatible_category')) as invalid, count(*) filter (outcome = 'already_categorized') as already_categorized from decided group by company_id""")
def categorization_summary(spark, sf_dir):
    return C.summary(_decided(spark, sf_dir))


@query("with p as (select p_partkey, p_brand, p_name || '|' || p_type || '|' as value from part) select p_partkey, p_brand, i - 1 as alternative, string_split(value, '|')[i] as value from p, unnest([1, 2, 3]) as g(i) where trim(string_split(value, '|')[i]) <> ''")
def rule_explode(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.concat("p_name", F.lit("|"), "p_type", F.lit("|")).alias("value"))
    return C.exploded_rules(parts).withColumn("alternative", F.col("alternative").cast("long"))


@query(OUTCOMES_SQL + """, state as (
  select transaction_id || '/' || category_id as suggestion_id, transaction_id, transaction_id as evaluation_id, category_id, 'generated' as status, null::varchar as current_category, place from ranked),
d as (select suggestion_id, case place when 1 then 'accept' else 'reject' end as action from state where place <= 2 and transaction_id like '%1')
select s.suggestion_id, case when d.action = 'accept' then 'accepted' when d.action = 'reject' then 'rejected' when exists (select 1 from d e join state t using (suggestion_id) where t.evaluation_id = s.evaluation_id and e.action = 'accept') then 'superseded' else 'generated' end as status,
  case when d.action = 'accept' then s.category_id end as current_category from state s left join d using (suggestion_id)""")
def apply_decisions(spark, sf_dir):
    """The best suggestion of some transactions accepted and the second one rejected: the others are superseded."""
    found = C.ranked(C.candidates(C.match_rules(ledger(spark, sf_dir), rules(spark, sf_dir))))
    state = found.select(F.concat_ws("/", "transaction_id", "category_id").alias("suggestion_id"), "transaction_id", F.col("transaction_id").alias("evaluation_id"), "category_id", F.lit("generated").alias("status"), F.lit(None).cast("string").alias("current_category"), "place")
    decisions = state.where("place <= 2 and transaction_id like '%1'").select("suggestion_id", F.when(F.col("place") == 1, "accept").otherwise("reject").alias("action"), F.lit(None).cast("string").alias("category_id"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("expected_category"))
    return C.apply_decisions(state.drop("place"), decisions).select("suggestion_id", "status", "current_category")


PAIRS_SQL = f"""with {COPIES_SQL},
keyed as (select company_id, bank_account_id, date, type, floor(amount * 100 + 0.5) as cents, id, description, counterparty_name, document_number from copies),
several as materialized (select * from keyed qualify count(*) over (partition by company_id, bank_account_id, date, type, cents) > 1),
k as materialized (select company_id, bank_account_id, date, type, cents, id, coalesce({n2('description')}, '') as d, coalesce({n2('counterparty_name')}, '') as c, coalesce({n2('document_number')}, '') as n from several),
pairs as (
  select a.company_id, a.id as left_id, b.id as right_id, a.d <> '' and a.d = b.d as same_description, a.c <> '' and a.c = b.c as same_counterparty, a.n <> '' and a.n = b.n as same_document
  from k a join k b using (company_id, bank_account_id, date, type, cents) where a.id < b.id),
scored as (select *, least(100, 65 + 20 * same_description::int + 10 * same_counterparty::int + 15 * same_document::int)::int as score from pairs)"""


@query(PAIRS_SQL + " select company_id, left_id, right_id, score, same_description, same_counterparty, same_document from scored where score >= 80")
def dup_pairs(spark, sf_dir):
    return D.duplicate_pairs(ledger_with_copies(spark, sf_dir))


@query(PAIRS_SQL + " select score, same_description, same_counterparty, same_document, count(*) as n from scored where score >= 80 group by all")
def dup_score(spark, sf_dir):
    return D.duplicate_pairs(ledger_with_copies(spark, sf_dir)).groupBy("score", "same_description", "same_counterparty", "same_document").agg(F.count(F.lit(1)).alias("n"))


@query(PAIRS_SQL + " select company_id, left_id, right_id, score, case when score >= 90 then 'high' else 'medium' end as severity, concat_ws(':', company_id, 'possible_duplicate', left_id, right_id) as dedup_key from scored where score >= 80")
def dup_pending(spark, sf_dir):
    return D.duplicate_pendings(D.duplicate_pairs(ledger_with_copies(spark, sf_dir)))


@query(PAIRS_SQL + " select left_id, right_id, case when score = 85 then 'confirmed' when score < 90 then 'dismissed' end as decision, score >= 90 as pending_open from scored where score >= 80")
def dup_decision(spark, sf_dir):
    pairs = D.duplicate_pairs(ledger_with_copies(spark, sf_dir))
    decisions = pairs.where("score < 90").select("left_id", "right_id", F.when(F.col("score") == 85, "confirmed").otherwise("dismissed").alias("decision"))
    decided = D.decide_duplicates(pairs.select("left_id", "right_id", F.lit(None).cast("string").alias("decision")), decisions)
    return decided.select("left_id", "right_id", "decision", "pending_open")


#: Conditions of rules as JSON, of which many have wrong types, are blank or are no JSON at all.
CONDITIONS_SQL = """with r as (select p_partkey as id, case p_partkey % 8 when 0 then '{"description": "' || p_name || '", "minAmount": ' || p_size || '}' when 1 then '{"description": ' || p_size || ', "minAmount": "5"}'
    when 2 then '{"description": "  ", "counterparty": "' || p_type || '"}' when 3 then 'not json' when 4 then '[1, 2]' when 5 then '{"minAmount": 1.5, "maxAmount": null, "document": true}' when 6 then null else '{"document": "  00123 ", "maxAmount": 2e3}' end as conditions from part),
  j as (select *, try_cast(conditions as json) as c from r)
  select id, case when json_type(c, '$.description') = 'VARCHAR' and trim(c ->> '$.description') <> '' then c ->> '$.description' end as condition_description,
    case when json_type(c, '$.counterparty') = 'VARCHAR' and trim(c ->> '$.counterparty') <> '' then c ->> '$.counterparty' end as condition_counterparty,
    case when json_type(c, '$.document') = 'VARCHAR' and trim(c ->> '$.document') <> '' then c ->> '$.document' end as condition_document,
    case when json_type(c, '$.minAmount') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (c ->> '$.minAmount')::double end as "condition_minAmount",
    case when json_type(c, '$.maxAmount') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (c ->> '$.maxAmount')::double end as "condition_maxAmount" from j"""


@query(CONDITIONS_SQL)
def guarded_conditions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    made = [
        F.concat(F.lit('{"description": "'), name, F.lit('", "minAmount": '), size, F.lit("}")), F.concat(F.lit('{"description": '), size, F.lit(', "minAmount": "5"}')), F.concat(F.lit('{"description": "  ", "counterparty": "'), kind, F.lit('"}')),
        F.lit("not json"), F.lit("[1, 2]"), F.lit('{"minAmount": 1.5, "maxAmount": null, "document": true}'), F.lit(None).cast("string"), F.lit('{"document": "  00123 ", "maxAmount": 2e3}'),
    ]
    rules = part.select(F.col("p_partkey").alias("id"), F.get(F.array(*made), (F.col("p_partkey") % 8).cast("int")).alias("conditions"))
    return C.guarded_conditions(rules).drop("conditions")
