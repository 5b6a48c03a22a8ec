"""Detection of recurring series: linked groups and identity candidates, trimmed, judged and scored."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import relative_difference
from ledgerloom.functions.similarity import text_similarity
from ledgerloom.functions.text import context_shape, installment
from ledgerloom.plans.scratch import materialise

from . import judge as J
from . import recurrence as R
from . import series as G
from .trimming import WEAK_TEXT, on_monthly_track, without_outliers

MIN_PERIOD, MIN_SCORE = 0.55, 60
#: Words of descriptions of single purchases: fixed values.
EPISODIC = r"(?i)\b(compra|pedido|comanda|turma|reserva|acessorio|avulso|avulsos)\b"
#: Columns of a row that groups carry; what is longer is joined where it is needed.
ROW = ["company_id", "type", "id", "date", "amount", "abs_amount", "normalized_description", "normalized_counterparty", "document_number", "distinctive", "category_id", "total", "shape", "marked", "episodic"]
KEYS = ["company_id", "type", "group_id"]


def detection_rows(txns: DataFrame) -> DataFrame:
    """Normalised rows without copies, with what groups ask of each description: ``total`` of its instalments, a hash of its
    ``shape``, whether it is ``marked`` with n/m and names a single purchase (``episodic``)."""
    rows = without_near_copies(R.normalized_rows(txns))
    text = F.col("description")
    return rows.withColumns({"total": installment(text)["total"], "shape": F.xxhash64(context_shape(text)), "marked": text.rlike(r"[0-9]{1,2}\s*/\s*[0-9]{1,2}"), "episodic": text.rlike(EPISODIC)})


def without_external_copies(rows: DataFrame) -> DataFrame:
    """Keeps the first row, by date and id, of each company, account, source and external id; rows without one all stay."""
    if "external_id" not in rows.columns:
        return rows
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in rows.columns else F.lit("")
    own = Window.partitionBy("company_id", F.coalesce("bank_account_id", F.lit("")), source, "external_id").orderBy("date", "id")
    known = rows.where("external_id <> ''").withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return known.unionByName(rows.where("external_id is null or external_id = ''"))


def without_near_copies(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Leaves out rows with an external id seen before, exact copies, and rows whose text is nearly that of an earlier row
    of one account, date and cents."""
    rows = R.without_exact_copies(without_external_copies(rows)).withColumn("_cents", F.floor(F.col("amount") * 100 + 0.5))
    keys = ["company_id", "bank_account_id", "date", "_cents"]
    side = lambda p: rows.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in ("id", "tokens", "document_number", "normalized_counterparty")])
    near = side("l_").join(side("r_"), keys).where("l_id < r_id").where(text_similarity("l_", "r_") >= threshold).select(*keys, F.col("l_id").alias("first"), F.col("r_id").alias("second"))

    def greedy(block: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        for second, firsts in block.sort_values("second").groupby("second")["first"]:
            if any(f not in gone for f in firsts):
                gone.add(second)
        return pd.DataFrame({"id": sorted(gone)})

    return rows.join(near.groupBy(*keys).applyInPandas(greedy, "id string"), "id", "left_anti").drop("_cents")


def context_dates(groups: DataFrame, rows: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """(keys, id, date) of rows outside a group that look like its payee and amount.

    Such rows share a ground with a member (a document, a counterparty, a specific token with another or an alias group)
    and are in its amount band or a neighbouring one, so the join is by hash on ground and band.
    """
    ratio = (2 + tolerance) / (2 - tolerance)
    band = F.floor(F.log(F.greatest("abs_amount", F.lit(1e-9))) / F.lit(math.log(ratio) + 1e-9)).cast("long")
    grounds = lambda frame: F.filter(R.row_grounds(frame), lambda g: (g["how"] == R.AT_ONCE) & ~g["ground"].startswith("v:"))["ground"]
    members = groups.select(*KEYS, F.col("id").alias("l_id"), F.col("abs_amount").alias("l_amount"), band.alias("band"), F.explode(grounds(groups)).alias("ground"))
    others = rows.select("company_id", "type", "id", "date", F.col("abs_amount").alias("r_amount"), F.explode(F.array(band - 1, band, band + 1)).alias("band"), grounds(rows).alias("all"))
    others = others.select("company_id", "type", "id", "date", "r_amount", "band", F.explode("all").alias("ground"))
    near = members.join(others, ["company_id", "type", "ground", "band"]).where(relative_difference(F.col("l_amount"), F.col("r_amount")) <= tolerance)
    found = near.where("l_id <> id").select(*KEYS, "id", "date").distinct()
    return found.join(groups.select(*KEYS, "id"), [*KEYS, "id"], "left_anti")


def contradicted(groups: DataFrame, rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Keys of groups whose rhythm falls apart once look-alike rows outside them are added.

    Strong groups (four rows or more, score 0.9, day 0.8), groups with ``n/m`` in a description and groups with one
    document or counterparty are never contradicted.
    """
    sizes = groups.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.bool_or("marked").alias("marked"))
    facts = sizes.join(periods.select(*KEYS, "score", "ratio", "consistency"), KEYS).join(G.stable_identity(groups, KEYS), KEYS)
    open_ = facts.where(~((F.col("n") >= 4) & (F.col("score") >= 0.9) & (F.col("consistency") >= 0.8)) & ~F.col("marked") & ~F.col("stable"))
    doubtful = groups.select(*KEYS, "id").join(open_.select(*KEYS), KEYS).join(rows, ["company_id", "type", "id"])
    outside = context_dates(doubtful, rows)
    expanded = G.periodicity(doubtful.select(*KEYS, "date").unionByName(outside.select(*KEYS, "date")), KEYS).select(*KEYS, F.col("score").alias("x_score"), F.col("ratio").alias("x_ratio"))
    counted = outside.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("outside"))
    drop = F.col("score") - F.col("x_score")
    judged = open_.join(counted, KEYS).join(expanded, KEYS)
    return judged.where(F.when(F.col("n") == 2, (drop >= 0.04) & (F.col("x_ratio") < F.col("ratio"))).otherwise((F.col("outside") >= 2) & (F.col("x_score") < MIN_PERIOD) & (drop >= 0.25))).select(*KEYS)


def group_similarity(members: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Mean, least and greatest text similarity over all pairs of rows of a group (KEYS, id); 0 for a single row. Without
    ``rows`` the members have their tokens, document and counterparty.

    Rows of equal tokens, document and counterparty are one profile: pairs are made of profiles and weighed by how many
    pairs of rows they stand for, so a group of copies costs as much as one row.
    """
    profile = ["tokens", "document_number", "normalized_counterparty"]
    own = (members if rows is None else members.join(rows.select("id", *profile), "id")).groupBy(*KEYS, *profile).agg(F.count(F.lit(1)).alias("k"))
    own = materialise(own.withColumn("mark", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in profile])), "profiles")
    side = lambda p: own.select(*KEYS, *[F.col(c).alias(f"{p}{c}") for c in (*profile, "k", "mark")])
    across = side("l_").join(side("r_"), KEYS).where("l_mark < r_mark").select(*KEYS, (F.col("l_k") * F.col("r_k")).alias("w"), text_similarity("l_", "r_").alias("s"))
    twin = own.select(*KEYS, *[F.col(c).alias(f"{p}{c}") for p in ("l_", "r_") for c in (*profile, "k")]).where("l_k > 1")
    within = twin.select(*KEYS, F.expr("l_k * (l_k - 1) div 2").alias("w"), text_similarity("l_", "r_").alias("s"))
    grouped = across.unionByName(within).groupBy(*KEYS).agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("text"), F.min("s").alias("least_text"), F.max("s").alias("most_text"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return own.select(*KEYS).distinct().join(grouped, KEYS, "left").select(*KEYS, zero("text"), zero("least_text"), zero("most_text"))


def modal_installments(groups: DataFrame) -> DataFrame:
    """The most frequent m of ``n/m`` in a group's descriptions; ties go to the one that comes first."""
    marked = groups.where("total is not null")
    each = marked.groupBy(*KEYS, "total").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("date", "id")).alias("first"))
    best = each.groupBy(*KEYS).agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "total")).alias("b"))
    return best.select(*KEYS, F.col("b.total").alias("installments")).where("installments > 0")


def merged(*frames: DataFrame) -> DataFrame:
    """One row for each group (KEYS) with the columns of all ``frames``, which have a row for a group at most; null where one
    has none. A union and one aggregation: a chain of joins would sort every frame at once in one task."""
    types = {c: t for f in frames for c, t in f.dtypes if c not in KEYS}
    parts = [f.select(*KEYS, *[F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]) for f in frames]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*KEYS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in types])


def _facts(groups: DataFrame, rows: DataFrame) -> list[DataFrame]:
    ids = groups.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "id"))), lambda x: x["id"]).alias("transaction_ids"), F.min("date").alias("start_date"), F.max("date").alias("last_date"))
    named = G.representative(groups, KEYS).join(rows.select("id", F.col("description").alias("representative")), "id").drop("id")
    return [G.amount_stability(groups, KEYS), G.category_consistency(groups, KEYS), G.several_in_a_month(groups, KEYS), modal_installments(groups), ids, named]


def _suggested(facts: DataFrame) -> DataFrame:
    end = F.when(F.col("installments").isNotNull(), F.add_months("start_date", F.col("installments") - 1))
    return facts.select(
        "company_id", "type", "group_id", "pattern_kind", "frequency", "recurrence_type", "confidence", "average_amount", "variation_percent", "category_id", "representative", "normalized_description",
        "transaction_ids", "start_date", "next_date", F.col("installments").alias("installment_count"), end.alias("end_date"), *(["rolled"] if "rolled" in facts.columns else []),
    )


def linked_suggestions(rows: DataFrame) -> DataFrame:
    """Suggestions from groups of linked rows (``rows`` are normalised and without copies)."""
    parts = R.linked_groups(R.link_edges(rows)).join(rows.select("company_id", "type", "id", "document_number", "normalized_counterparty"), "id")
    split = R.split_by_identity(parts).withColumn("group_id", F.concat_ws("#", "component", "part"))
    # Each step of the trimming reads them several times.
    linked = materialise(split.select(*KEYS, "id"), "linked-members")
    kept = on_monthly_track(without_outliers(linked, rows, KEYS), rows, KEYS)
    groups = materialise(kept.join(rows.select(*ROW), ["company_id", "type", "id"]).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).where("_n >= 2").drop("_n"), "linked-groups")
    periods = materialise(G.periodicity(groups, KEYS).where(F.col("score") >= MIN_PERIOD), "periods")
    alive = groups.join(periods.select(*KEYS), KEYS, "left_semi")
    facts = materialise(merged(*_facts(alive, rows), periods.select(*KEYS, F.col("score").alias("period"), "frequency", "next_date"), group_similarity(alive.select(*KEYS, "id"), rows)).where("n is not null"), "linked-facts")
    facts = facts.where(~F.col("several_in_a_month") | F.col("installments").isNotNull()).where(~((F.col("variation_percent") > 100) & (F.col("text") < WEAK_TEXT)))
    facts = facts.join(contradicted(alive, rows, periods), KEYS, "left_anti")
    score = G.legacy_score(F.col("period"), F.col("text"), F.col("amount_score"), F.col("category_score"), F.col("n"))
    return _suggested(facts.withColumn("confidence", score).withColumn("pattern_kind", F.lit(None).cast("string")).where(F.col("confidence") >= MIN_SCORE))


def competing_cores(groups: DataFrame) -> DataFrame:
    """Keys of groups of four rows or more that hold two series: two tokens on disjoint rows, on 70 % of them together,
    apart in amount (each steady) or by six days of the month.

    One of two such tokens is on 35 % of the rows or more, and a group has few of those; only they meet the others.
    """
    sized = groups.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size")).where("size >= 4")
    each = groups.select(*KEYS, "id", "abs_amount", F.day("date").alias("day"), F.explode("distinctive").alias("token"))
    cores = each.groupBy(*KEYS, "token").agg(F.count(F.lit(1)).alias("k"), F.avg("abs_amount").alias("mean"), F.stddev_pop("abs_amount").alias("deviation"), F.avg("day").alias("day"))
    cores = materialise(cores.join(sized, KEYS).where((F.col("k") >= 2) & (F.col("k") <= 0.7 * F.col("size"))), "cores")
    side = lambda p: cores.select(*KEYS, *[F.col(c).alias(f"{p}{c}") for c in ("token", "k", "mean", "deviation", "day", "size")])
    pairs = side("l_").where("l_k >= 0.35 * l_size").join(side("r_"), KEYS).where("l_token <> r_token and l_k + r_k >= 0.7 * l_size and l_k >= r_k")
    steady = lambda p: F.when(F.col(f"{p}mean") == 0, 0.0).otherwise(F.col(f"{p}deviation") / F.col(f"{p}mean")) <= 0.25
    apart = steady("l_") & steady("r_") & (relative_difference(F.col("l_mean"), F.col("r_mean")) >= 0.25)
    rivals = materialise(pairs.where(apart | (F.abs(F.col("l_day") - F.col("r_day")) >= 6)).select(*KEYS, "l_token", "r_token"), "rival-cores")
    # Rivals that some row has both of are no rivals.
    met = groups.select(*KEYS, "distinctive").join(rivals, KEYS).where(F.array_contains("distinctive", F.col("l_token")) & F.array_contains("distinctive", F.col("r_token")))
    return rivals.join(met.select(*KEYS, "l_token", "r_token").distinct(), [*KEYS, "l_token", "r_token"], "left_anti").select(*KEYS).distinct()


def identity_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates: KEYS, key and score; members: KEYS, id) of identity groups, their lanes and income tracks.

    A candidate is told by sums of its rows' hashes, so equal sets are found, and one of each chosen (highest score, then
    smallest key), before any list of rows is made. A day has one lane in a group, and so has an amount, whatever the
    number of rows that have it.
    """
    keys = ["company_id", "type", "key"]
    named = R.identity_groups(rows)
    sizes = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sized = materialise(named.join(sizes, keys).join(rows.select("id", "date", "abs_amount"), "id"), "identity-rows")
    large = sized.where(F.col("n") >= R.LEAST_LANE)
    by_lane = {"day": R.day_lanes(large, keys), "amount": R.amount_lanes(large, keys)}
    by_lane = {lane: frame.withColumn("anchor", F.col("anchor").cast("double")) for lane, frame in by_lane.items()}
    tracks = materialise(R.income_track_rows(rows), "income-tracks")
    none = F.lit(None).cast("double").alias("anchor")
    found = sized.groupBy(*keys, "score", F.lit("").alias("lane"), none).agg(F.count(F.lit(1)).alias("m"), *R.set_hash(F.col("id")))
    for lane, frame in by_lane.items():
        each = frame.groupBy(*keys, "score", "n", F.lit(lane).alias("lane"), "anchor").agg(F.count(F.lit(1)).alias("m"), *R.set_hash(F.col("id")))
        found = found.unionByName(each.where((F.col("m") >= 3) & (F.col("m") < F.col("n"))).drop("n"))
    each = tracks.groupBy("company_id", F.lit("income").alias("type"), F.concat(F.lit("track:"), "anchor_id").alias("key"), F.lit(0.68).alias("score"), F.lit("track").alias("lane"), none)
    found = found.unionByName(each.agg(F.count(F.lit(1)).alias("m"), *R.set_hash(F.col("id"))))
    best = found.groupBy("company_id", "h1", "h2", "m").agg(F.min(F.struct((-F.col("score")).alias("worse"), "key", "lane", "anchor", "type")).alias("b"))
    chosen = materialise(best.select("company_id", "b.type", F.concat_ws("-", "h1", "h2", "m").alias("group_id"), "b.key", (-F.col("b.worse")).alias("score"), "b.lane", "b.anchor"), "candidates")
    of = lambda lane: chosen.where(F.col("lane") == lane).select(*keys, "anchor", "group_id")
    members = sized.select(*keys, "id").join(of("").drop("anchor"), keys)
    for lane, frame in by_lane.items():
        members = members.unionByName(frame.select(*keys, "anchor", "id").join(of(lane), [*keys, "anchor"]).drop("anchor"))
    track = tracks.select("company_id", F.lit("income").alias("type"), F.concat(F.lit("track:"), "anchor_id").alias("key"), "id")
    members = members.unionByName(track.join(of("track").drop("anchor"), keys))
    return chosen.select(*KEYS, "key", "score"), members.select(*KEYS, "id")


def contaminated(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of single-token groups (``keys``: KEYS, key) with a second token on 60 % of their rows or more but not on all,
    while some other row has second tokens without that one. Of such tokens the most frequent counts, then the first."""
    core = F.regexp_extract("key", r"^token:([^|]+)(\||$)", 1)
    cores = keys.select(*KEYS, core.alias("core")).where("core <> ''")
    rows = groups.select(*KEYS, "id", "distinctive").join(cores, KEYS).select(*KEYS, "id", F.filter("distinctive", lambda t: t != F.col("core")).alias("second"))
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select(*KEYS, F.explode("second").alias("token")).groupBy(*KEYS, "token").agg(F.count(F.lit(1)).alias("k")).join(sizes, KEYS)
    dominant = counts.where((F.col("k") >= 0.6 * F.col("n")) & (F.col("k") < F.col("n"))).groupBy(*KEYS).agg(F.min(F.struct((-F.col("k")).alias("k"), "token")).getField("token").alias("dominant"))
    return rows.join(dominant, KEYS).where((F.size("second") > 0) & ~F.array_contains("second", F.col("dominant"))).select(*KEYS).distinct()


def monthly_kind(type_: Column, steady: Column) -> Column:
    """The kind of a monthly group: income, or an expense of fixed or variable amounts."""
    return F.when(type_ == "income", "recurring_income").when(steady == "fixed", "monthly_fixed").otherwise("monthly_variable")


def best_patterns(groups: DataFrame, periods: DataFrame) -> DataFrame:
    """KEYS, pattern_kind, frequency, pattern, next_date of each group that fits one: the first of instalments, monthly,
    weekly or biweekly, and frequent business. ``periods`` are the groups' periodicities."""
    plan = G.installments(groups, KEYS, F.col("total")).select(*KEYS, F.col("score").alias("plan"))
    monthly = periods.where(F.col("score") >= MIN_PERIOD).select(*KEYS, F.col("score").alias("monthly"), F.col("next_date").alias("m_next"), F.col("frequency").alias("m_frequency"))
    short = G.short_cadence(groups, KEYS).select(*KEYS, F.col("score").alias("short"), F.col("frequency").alias("short_frequency"))
    often = G.frequent_business(groups, KEYS).select(*KEYS, F.col("score").alias("often"), F.col("kind").alias("often_kind"))
    facts = merged(G.amount_stability(groups, KEYS).select(*KEYS, "recurrence_type"), plan, monthly, short, often)
    return with_pattern(facts).select(*KEYS, "pattern_kind", "frequency", "pattern", "m_next")


def with_pattern(facts: DataFrame) -> DataFrame:
    """Adds pattern_kind, frequency and pattern by the scores plan, monthly, short and often; groups without any are left out."""
    income = F.col("type") == "income"
    kind = (
        F.when(F.col("plan").isNotNull(), "installment").when(F.col("monthly").isNotNull(), monthly_kind(F.col("type"), F.col("recurrence_type")))
        .when(F.col("short").isNotNull(), F.when(income, "recurring_income").otherwise(F.concat("short_frequency", F.lit("_recurring")))).when(F.col("often").isNotNull(), F.when(income, "recurring_income").otherwise(F.col("often_kind")))
    )
    # A monthly score may stand on the day of the month alone; the frequency also asks for half of the gaps.
    frequency = F.when(F.col("plan").isNotNull(), "monthly").when(F.col("monthly").isNotNull(), F.col("m_frequency")).when(F.col("short").isNotNull(), F.col("short_frequency")).otherwise("unknown")
    return facts.withColumns({"pattern_kind": kind, "frequency": frequency, "pattern": F.coalesce("plan", "monthly", "short", "often")}).where("pattern_kind is not null")


def on_cadence(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups with each weekly or biweekly one cut down to its dominant cadence track, where that has four rows or more;
    their periodicities; their patterns). Only groups that were cut are judged again."""
    periods = materialise(G.periodicity(groups, KEYS), "periods")
    kinds = materialise(best_patterns(groups, periods), "patterns")
    parts = []
    for kind, days in (("weekly_recurring", 7), ("biweekly_recurring", 14)):
        own = groups.join(kinds.where(F.col("pattern_kind") == kind).select(*KEYS), KEYS, "left_semi")
        track = G.cadence_track(own, KEYS, days)
        sizes = track.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k")).join(own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS)
        parts.append(track.join(sizes.where("k >= 4 and k < n").select(*KEYS), KEYS, "left_semi"))
    cut = materialise(parts[0].unionByName(parts[1]), "cadence-tracks")
    changed = cut.select(*KEYS).distinct()
    if not cut.limit(1).count():
        return groups, periods, kinds
    again = materialise(G.periodicity(cut, KEYS), "periods-again")
    rest = lambda frame: frame.join(changed, KEYS, "left_anti")
    return rest(groups).unionByName(cut.select(*groups.columns)), rest(periods).unionByName(again), rest(kinds).unionByName(best_patterns(cut, again))


#: Rows of a candidate that one task writes; those of a larger one are dealt over several.
SPLIT_ROWS = 100_000


def clustered(members: DataFrame) -> DataFrame:
    """Rows of a candidate side by side, so that what is added up for it is nearly complete before it is shuffled. The
    number of its rows is the last part of ``group_id``."""
    size = F.element_at(F.split("group_id", "-"), -1).cast("long")
    return members.repartition(*KEYS, F.pmod(F.xxhash64("id"), F.ceil(size / SPLIT_ROWS)))


def candidate_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with KEYS, key and score; their rows after trimming, without groups that hold two series)."""
    found, members = identity_candidates(rows)
    members = materialise(clustered(members), "candidate-ids")
    free = found.where(F.col("key").startswith("track:")).select(*KEYS)
    kept = without_outliers(members.join(free, KEYS, "left_anti"), rows, KEYS).unionByName(members.join(free, KEYS, "left_semi"))
    sizes = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    groups = materialise(kept.join(sizes, KEYS).join(rows.select(*ROW), ["company_id", "type", "id"]), "candidate-groups")
    return found, materialise(clustered(groups.join(competing_cores(groups), KEYS, "left_anti")), "candidate-members")


def pattern_suggestions(rows: DataFrame) -> DataFrame:
    """Suggestions from identity candidates, each with the first pattern that it fits: instalments, monthly, weekly or
    biweekly, frequent business.

    Companies of moderate size are judged where their rows lie (``judge``); the others, and those whose rows lack a date, an
    amount or an id of their own, by joins. The result is the same.
    """
    rows = rows if "in_place" in rows.columns else materialise(J.in_place_rows(rows), "placed-rows")
    facts = with_pattern(J.candidate_facts(J.numbered(rows.where("in_place"))))
    epoch = F.lit("1970-01-01").cast("date")
    facts = facts.withColumns({"start_date": F.date_add(epoch, "first_day"), "last_date": F.date_add(epoch, "last_day")})
    found = _scored(facts.where(_sound() & ~F.col("contradicted")))
    others = rows.where("not in_place").drop("in_place")
    return found.unionByName(_patterns_by_joins(others).withColumn("rolled", F.lit(None).cast("long"))) if others.limit(1).count() else found


def _patterns_by_joins(rows: DataFrame) -> DataFrame:
    found, groups = candidate_members(rows)
    groups, periods, kinds = on_cadence(groups)
    episodic = groups.groupBy(*KEYS).agg(F.bool_and("episodic").alias("episodic"))
    mixed_up = contaminated(groups, found).withColumn("contaminated", F.lit(True))
    facts = merged(*_facts(groups, rows), found.select(*KEYS, "score"), G.diversity(groups, KEYS, shape=F.col("shape")), kinds, episodic, G.stable_identity(groups, KEYS), mixed_up)
    facts = materialise(facts.where("n is not null and pattern_kind is not null").fillna(False, ["contaminated"]), "candidate-facts").where(_sound())
    # What is judged as monthly by its instalments alone has no monthly rhythm that could fall apart.
    rhythm = groups.join(facts.where((F.col("frequency") == "monthly") & F.col("m_next").isNotNull()).select(*KEYS), KEYS, "left_semi")
    return _scored(facts.join(contradicted(rhythm, rows, periods), KEYS, "left_anti"))


def _sound() -> Column:
    is_monthly, n, identity = F.col("frequency") == "monthly", F.col("n"), F.col("score")
    enough = F.when(is_monthly, n >= 4).when(F.col("pattern_kind").isin("weekly_recurring", "biweekly_recurring"), F.lit(True)).otherwise(n >= 6)
    mixed = (F.col("text_diversity") > 0.6) | (F.col("context_diversity") > 0.75) | F.col("contaminated")
    sound = (
        enough & ~(is_monthly & F.col("several_in_a_month")) & ~(is_monthly & F.col("episodic") & ~F.col("stable")) & ~((identity <= 0.72) & mixed)
        & ~((identity < 0.95) & (F.col("text_diversity") <= 0.25) & (F.col("context_diversity") > 0.6))
    )
    return (F.col("pattern_kind") == "installment") | sound


def _scored(facts: DataFrame) -> DataFrame:
    score = G.pattern_score(F.col("pattern_kind"), F.col("pattern"), F.col("score"), F.col("amount_score"), F.col("category_score"), F.col("n"))
    next_date = F.when(F.col("frequency") == "monthly", F.add_months("last_date", 1))
    return _suggested(facts.withColumn("confidence", score).withColumn("next_date", next_date).where(F.col("confidence") >= MIN_SCORE))


def distinct_suggestions(suggestions: DataFrame) -> DataFrame:
    """One suggestion for each set of rows: one from linked groups always wins, else the highest confidence. Sets are told by a
    hash, so their lists go through the shuffle only where they are asked for."""
    told = suggestions.withColumn("_set", F.sha2(F.array_join(F.sort_array("transaction_ids"), "|"), 256))
    own = Window.partitionBy("company_id", "type", "_set").orderBy(F.col("pattern_kind").isNotNull(), F.desc("confidence"), "group_id")
    return told.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_set")


def rolling_hash(ids: Column) -> Column:
    """The 32-bit rolling hash of the joined ids, from 0 up."""
    codes = F.transform(F.split(F.array_join(ids, "|"), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(4294967295))


def suggestion_id(company: Column, ids: Column, rolled: Column | None = None) -> Column:
    """``rec_<company>_`` and the rolling hash of the ids, signed and then without its sign, in base 36; ``rolled`` is that hash if
    it is known."""
    rolled = rolling_hash(ids) if rolled is None else rolled
    signed = F.when(rolled >= 2147483648, rolled - 4294967296).otherwise(rolled)
    return F.concat(F.lit("rec_"), company, F.lit("_"), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def detect_recurrences(txns: DataFrame, patterns: bool = True) -> DataFrame:
    """Suggested recurrences of every company, with ids, kind, confidence and the rows of each."""
    rows = materialise(J.in_place_rows(detection_rows(txns)), "clean-rows")
    found = linked_suggestions(rows.drop("in_place")).withColumn("rolled", F.lit(None).cast("long"))
    if patterns:
        found = found.unionByName(pattern_suggestions(rows))
    # The hash is told once, in a projection of its own; inside the id it would be told for every place that names it. Hash and
    # size are told before equal sets meet, so that without the lists themselves no list is shuffled.
    ids = F.col("transaction_ids")
    sized = found.withColumn("_r", F.explode(F.array(F.struct(F.coalesce("rolled", rolling_hash(ids)).alias("rolled"), F.size(ids).alias("n")))))
    hashed = distinct_suggestions(sized.drop("rolled").select("*", "_r.rolled", "_r.n").drop("_r"))
    return hashed.withColumn("suggestion_id", suggestion_id(F.col("company_id"), F.col("transaction_ids"), F.col("rolled"))).drop("group_id", "rolled")
