"""Candidates for recurring series: normalised rows, blocks, links, components, identity groups and their lanes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import is_cadence_pair, month_index, relative_difference
from ledgerloom.functions.similarity import STRICT_GROUPS, VARIABLE_GROUPS
from ledgerloom.functions.text import GENERIC_TOKENS, alias_groups, digits, distinctive, document_in_text, installment, recurrence_tokens, spread
from ledgerloom.plans.scratch import materialise

from . import in_place
from .components import connected_components

#: Lower bounds of the amount bands; the last one is open.
AMOUNT_BANDS = (0, 50, 100, 250, 500, 1000, 2500)


def amount_bucket(amount: Column) -> Column:
    """Index of the band of a non-negative amount."""
    rule = F.when(amount < AMOUNT_BANDS[1], 0)
    for index in range(2, len(AMOUNT_BANDS)):
        rule = rule.when(amount < AMOUNT_BANDS[index], index - 1)
    return rule.otherwise(len(AMOUNT_BANDS) - 1)


def normalized_rows(txns: DataFrame) -> DataFrame:
    """Adds tokens, normalized_description, normalized_counterparty, distinctive, abs_amount and bucket; a document that
    is not given is read from the description."""
    both = txns.withColumn("_d", recurrence_tokens(F.col("description"))).withColumn("_c", recurrence_tokens(F.col("counterparty_name")))
    rows = both.withColumn("tokens", F.array_union("_d", "_c")).withColumn("normalized_counterparty", F.nullif(F.array_join("_c", " "), F.lit(""))).drop("_d", "_c")
    return rows.withColumns({
        "normalized_description": F.array_join("tokens", " "), "distinctive": distinctive(F.col("tokens")), "abs_amount": F.abs("amount"), "bucket": amount_bucket(F.abs("amount")),
        "document_number": F.coalesce("document_number", document_in_text(F.col("description"))),
    })


#: Pairs of description and counterparty up to this number are normalised once each and sent to all tasks.
TEXTS, MOST_TEXTS = ["description", "counterparty_name"], 100_000


def normalized_once(txns: DataFrame, **more: Callable[[DataFrame], Column]) -> DataFrame:
    """``normalized_rows`` with ``more``, which is made of the columns of texts alone. Where ``txns`` have few texts, each is
    normalised once and its rows look it up; else every row is normalised by itself. The result is the same."""
    texts = materialise(txns.select(*TEXTS).distinct(), "texts")
    if texts.count() > MOST_TEXTS:
        rows = normalized_rows(txns)
        return rows.withColumns({name: of(rows) for name, of in more.items()})
    known = normalized_rows(texts.withColumns({"amount": F.lit(0.0), "document_number": F.lit(None).cast("string")}))
    known = known.withColumns({name: of(known) for name, of in more.items()})
    made = [c for c in known.columns if c not in (*TEXTS, "amount", "abs_amount", "bucket")]
    known = materialise(known.select(*[F.col(c).alias(f"_{c}") for c in TEXTS], *made).withColumnRenamed("document_number", "_document"), "normalized-texts")
    same = [txns[c].eqNullSafe(known[f"_{c}"]) for c in TEXTS]
    rows = txns.join(F.broadcast(known), same[0] & same[1]).drop(*[f"_{c}" for c in TEXTS])
    return rows.withColumns({"abs_amount": F.abs("amount"), "bucket": amount_bucket(F.abs("amount")), "document_number": F.coalesce("document_number", "_document")}).drop("_document")


#: A company with more rows than this is not gathered in one task; the largest MANY_COMPANIES of them are named one by one.
LARGE_COMPANY, MANY_COMPANIES = 1_000_000, 1000
#: In which the rows of a company are joined by what they share, not by their dates alone.
LARGE_LINKED = 100_000


def by_company(rows: DataFrame, of: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None) -> DataFrame:
    """``of(rows)``, where every step of ``of`` keeps companies apart: rows are shuffled once, by company and before they are
    spread, and what follows finds them in place. Companies of more than ``most`` (LARGE_COMPANY) rows go through ``large``,
    else through ``of`` with shuffles by the keys of each step; the result is the same."""
    sizes = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (most or LARGE_COMPANY))
    big = [r["company_id"] for r in sizes.orderBy(F.desc("n")).limit(MANY_COMPANIES).collect()]
    if not big:
        return of(rows.repartition("company_id"))
    is_big = F.coalesce(F.col("company_id").isin([c for c in big if c is not None]), F.lit(None in big))
    return of(rows.where(~is_big).repartition("company_id")).unionByName((large or of)(rows.where(is_big)))


def without_exact_copies(rows: DataFrame) -> DataFrame:
    """Keeps the first row, by date and id, of each company, account, date, whole cents and normalised description."""
    cents = F.floor(F.col("amount") * 100 + 0.5)
    order = Window.partitionBy("company_id", "bank_account_id", "date", cents, "normalized_description").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def amount_blocks(rows: DataFrame) -> DataFrame:
    """(company_id, type, bucket, id): for each bucket that exists, the rows of it and of its neighbours; two or more."""
    existing = rows.select("company_id", "type", F.col("bucket").alias("block")).distinct()
    near = rows.select("company_id", "type", "id", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("block"))
    members = near.join(existing, ["company_id", "type", "block"])
    return members.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("company_id", "type", "block"))).where("_n >= 2").drop("_n")


def _entry(key: Column, score: float) -> Column:
    return F.struct(key.alias("key"), F.lit(score).alias("score"))


def identity_keys() -> Column:
    """array of struct(key, score): document, counterparty, description, ordered token pairs and single tokens."""
    return F.concat(document_keys(), text_keys())


def document_keys() -> Column:
    document = digits(F.col("document_number"))
    return F.array_compact(F.array(F.when(document.isNotNull(), _entry(F.concat(F.lit("document:"), document), 0.98))))


def text_keys() -> Column:
    """The identity keys that a row's texts give."""
    d = F.col("distinctive")
    single = [
        F.when(F.col("normalized_counterparty").isNotNull(), _entry(F.concat(F.lit("counterparty:"), "normalized_counterparty"), 0.95)),
        F.when((F.col("normalized_description") != "") & (F.size(d) > 0), _entry(F.concat(F.lit("description:"), "normalized_description"), 0.92)),
    ]
    pairs = F.flatten(F.transform(d, lambda a, i: F.transform(F.slice(d, i + 2, F.size(d)), lambda b: _entry(F.concat(F.lit("tokens:"), a, F.lit("+"), b), 0.88))))
    tokens = F.transform(d, lambda a: _entry(F.concat(F.lit("token:"), a), 0.72))
    return F.concat(F.array_compact(F.array(*single)), pairs, tokens)


def identity_groups(rows: DataFrame, least: int = 3) -> DataFrame:
    """(company_id, type, key, score, id): rows by what identifies the payee, in groups of ``least`` or more."""
    own = Window.partitionBy("company_id", "type", "key")
    return identity_members(rows).withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_n") >= least).drop("_n")


def identity_members(rows: DataFrame, *more: str) -> DataFrame:
    """(company_id, type, key, score, id, more): rows by everything that identifies the payee."""
    return spread(rows, "company_id", "type", "id", *more, each=identity_keys(), name="k").select("company_id", "type", "id", *more, "k.key", "k.score")


def block_members(rows: DataFrame) -> DataFrame:
    """(company_id, type, key, id): rows by document, counterparty, description and ordered pairs of distinctive tokens; a
    description counts here even without such tokens."""
    plain = F.when((F.col("normalized_description") != "") & (F.size("distinctive") == 0), F.concat(F.lit("description:"), "normalized_description"))
    keys = F.filter(identity_keys()["key"], lambda k: ~k.startswith("token:"))
    return spread(rows, "company_id", "type", "id", each=F.array_compact(F.concat(keys, F.array(plain))), name="key").distinct()


def identity_overlaps(rows: DataFrame, large: Callable[[DataFrame], DataFrame], least: int = 3) -> DataFrame:
    """``in_place.OVERLAPS`` of the groups of ``identity_groups``, named by company, type and key; ``large`` gives those of large
    companies. ``rows`` may bring the keys of their texts as ``text_keys``."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_place.overlaps_of(batches, least)

    of = lambda own: _sorted(own.select("company_id", "type", "id", _keys(own).alias("keys"))).mapInArrow(overlaps, in_place.OVERLAPS)
    return by_company(rows, of, large)


def identity_blocks(rows: DataFrame) -> DataFrame:
    """(company_id, type, key, id): the blocks of ``block_members`` with two rows or more."""
    own = Window.partitionBy("company_id", "type", "key")
    return block_members(rows).withColumn("_n", F.count(F.lit(1)).over(own)).where("_n >= 2").drop("_n")


#: How a shared ground links a pair: at once, with different parts of one plan, or with amounts that are very near.
AT_ONCE, OTHER_PART, NEAR = 0, 1, 2


def _grounds(tokens: Column, specific: Column, groups: Column, document: Column, party: Column, total: Column) -> Column:
    """array of struct(ground, how): everything of a row that a linked row has to share, alone or in pairs."""
    ground = lambda how, *parts: F.named_struct(F.lit("ground"), F.concat(*parts), F.lit("how"), F.lit(how))
    single = F.array_compact(F.array(F.when(document.isNotNull(), ground(AT_ONCE, F.lit("d:"), document)), F.when(party.isNotNull(), ground(AT_ONCE, F.lit("c:"), party))))
    # A specific token counts with a second token or an alias group.
    both = F.flatten(F.transform(specific, lambda a: F.transform(F.filter(tokens, lambda b: b != a), lambda b: ground(AT_ONCE, F.lit("t:"), F.least(a, b), F.lit("+"), F.greatest(a, b)))))
    named = F.flatten(F.transform(specific, lambda a: F.transform(groups, lambda g: ground(AT_ONCE, F.lit("g:"), a, F.lit("+"), g))))
    plan = F.when(total.isNotNull(), F.transform(specific, lambda a: ground(OTHER_PART, F.lit("p:"), total.cast("string"), F.lit("+"), a)))
    alias = lambda how, mark, names: F.transform(F.filter(groups, lambda g: g.isin(*names)), lambda g: ground(how, F.lit(mark), g))
    found = [single, both, named, F.coalesce(plan, F.slice(single, 1, 0)), alias(AT_ONCE, "v:", VARIABLE_GROUPS), alias(NEAR, "s:", STRICT_GROUPS)]
    return F.array_distinct(F.concat(*found))


def _plan() -> Column:
    """struct(current, total) of a row's instalments, where they make sense."""
    plan = installment(F.col("description"))
    return F.when((plan["current"] >= 1) & (plan["total"] >= 2) & (plan["current"] <= plan["total"]), plan)


def row_grounds(rows: DataFrame) -> Column:
    """What the rows of a normalised frame can share, as ``_grounds``."""
    return _text_grounds(rows, digits(rows["document_number"]))


def text_grounds(texts: DataFrame) -> Column:
    """The grounds that a row's texts give, which are all but its document."""
    return _text_grounds(texts, F.lit(None).cast("string"))


def _text_grounds(rows: DataFrame, document: Column) -> Column:
    tokens = rows["tokens"]
    specific = F.filter(tokens, lambda w: ~w.isin(GENERIC_TOKENS))
    return _grounds(tokens, specific, alias_groups(tokens), document, rows["normalized_counterparty"], _plan()["total"])


def link_edges(rows: DataFrame, max_months: int = 3, tolerance: float = 0.6, strict: float = 0.12) -> DataFrame:
    """(company_id, left_id, right_id): pairs that may belong to one monthly series.

    Every linked pair shares a ground: a document, a counterparty, a specific token with another token or an alias group, a
    plan of instalments, or certain alias groups. Where the rows of a company lie, those whose dates can fit meet, and of
    these the ones with near amounts look for a ground that both have. In companies of more than LARGE_LINKED rows they are
    joined by what they share. ``rows`` may bring the grounds of their texts and the part of their plan as ``text_grounds``
    and ``part``.
    """
    given = rows.where("company_id is not null and type is not null and id is not null and date is not null and abs_amount is not null")
    of = lambda own: _links_in_place(own, max_months, tolerance, strict)
    return by_company(_linkable(given), of, lambda own: _links_by_joins(own, max_months, tolerance, strict), LARGE_LINKED)


def _linkable(rows: DataFrame) -> DataFrame:
    if "text_grounds" not in rows.columns:
        return rows.select("company_id", "type", "id", "date", "abs_amount", _plan()["current"].alias("part"), row_grounds(rows).alias("grounds"))
    document = digits(F.col("document_number"))
    own = F.array_compact(F.array(F.when(document.isNotNull(), F.struct(F.concat(F.lit("d:"), document).alias("ground"), F.lit(AT_ONCE).alias("how")))))
    return rows.select("company_id", "type", "id", "date", "abs_amount", "part", F.concat(own, "text_grounds").alias("grounds"))


def linkable_texts() -> dict[str, Callable[[DataFrame], Column]]:
    """What ``normalized_once`` makes of texts for ``link_edges``."""
    return {"text_grounds": text_grounds, "part": lambda texts: _plan()["current"]}


def _links_in_place(rows: DataFrame, max_months: int, tolerance: float, strict: float) -> DataFrame:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_place.links_of(batches, max_months, tolerance, strict, OTHER_PART, NEAR)

    return _sorted(rows).mapInArrow(links, in_place.LINKS)


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows that were shuffled by company, with each company's side by side."""
    return rows.sortWithinPartitions("company_id")


def _links_by_joins(rows: DataFrame, max_months: int, tolerance: float, strict: float) -> DataFrame:
    """Rows are spread over their grounds and joined by hash on company, type, ground and a block of months, so only rows
    with something in common meet."""
    each = rows.withColumn("month", month_index(F.col("date"))).withColumn("g", F.explode_outer("grounds")).where("g is not null")
    each = materialise(each.select("*", "g.ground", "g.how").drop("g", "grounds"), "link-grounds")
    width = max_months + 1
    side = lambda mark, block: each.select("company_id", "type", "ground", "how", block.alias("block"), *[F.col(c).alias(mark + c) for c in ("id", "date", "abs_amount", "part", "month")])
    own = F.floor(F.col("month") / width)
    left, right = side("l_", own), side("r_", F.explode(F.array(own, own - 1)))
    pairs = left.join(right, ["company_id", "type", "ground", "how", "block"]).where("l_id <> r_id")
    later = F.col("r_month") - F.col("l_month")
    once = later.between(1, max_months) | ((later == 0) & (F.col("l_id") < F.col("r_id")))
    difference = relative_difference(F.col("l_abs_amount"), F.col("r_abs_amount"))
    how = F.when(F.col("how") == OTHER_PART, F.col("l_part") != F.col("r_part")).when(F.col("how") == NEAR, difference <= strict).otherwise(F.lit(True))
    linked = pairs.where(once & (difference <= tolerance) & how & is_cadence_pair(F.col("l_date"), F.col("r_date"), max_months))
    return linked.select("company_id", F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id")).distinct()


def linked_groups(edges: DataFrame) -> DataFrame:
    """(id, component) for the linked rows; ids are unique over all companies, so no component goes across them. Those of
    companies with more than LARGE_COMPANY links are found by steps over all their links."""
    links = edges.where("left_id is not null and right_id is not null")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_place.stars_of(batches)

    found = by_company(
        materialise(links.select("company_id", "left_id", "right_id"), "links"), lambda own: _sorted(own).mapInArrow(stars, "node string, component string"),
        lambda own: connected_components(own, "left_id", "right_id"),
    )
    return found.withColumnRenamed("node", "id")


def split_by_identity(rows: DataFrame, key: str = "component") -> DataFrame:
    """Adds ``part``: a group in which every row has a document splits by document, else by counterparty if all have one."""
    own = Window.partitionBy(key)
    document = digits(F.col("document_number"))
    whole = lambda c: F.count(c).over(own) == F.count(F.lit(1)).over(own)
    several = lambda c: F.size(F.collect_set(c).over(own)) > 1
    by_document = whole(document) & several(document)
    party = F.col("normalized_counterparty")
    return rows.withColumn("part", F.when(by_document, document).when(whole(party) & several(party), party).otherwise(""))


#: Amounts whose difference is within 35 % of their mean are in one band of their logarithm or in neighbouring ones.
LANE_RATIO = 2.35 / 1.65
LEAST_LANE = 5


def _amount_band(amount: Column) -> Column:
    return F.floor(F.log(F.greatest(amount, F.lit(1e-9))) / F.lit(math.log(LANE_RATIO) + 1e-9)).cast("long")


def day_lanes(sized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anchor, id, ...): for each day of the month that a group has, its rows within three days of it."""
    days = sized.where("date is not null").withColumn("_day", F.day("date"))
    anchors = days.select(*keys, F.col("_day").alias("anchor")).distinct()
    near = days.withColumn("anchor", F.explode(F.sequence(F.col("_day") - 3, F.col("_day") + 3))).drop("_day")
    return near.join(anchors, [*keys, "anchor"], "left_semi")


def amount_lanes(sized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anchor, id, ...): for each amount that a group has, its rows within 35 % of it."""
    rows = sized.where("abs_amount is not null")
    anchors = rows.select(*keys, F.col("abs_amount").alias("anchor")).distinct()
    anchors = anchors.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: _amount_band(F.col("anchor")) + i)))
    near = rows.withColumn("_band", _amount_band(F.col("abs_amount"))).join(anchors, [*keys, "_band"])
    return near.where(relative_difference(F.col("abs_amount"), F.col("anchor")) <= 0.35).drop("_band")


GROUP = ["company_id", "type", "key"]
#: Values of a lane are placed so that those near a value lie within REACH of its place: amounts by millionths of their
#: logarithm, with some room for rounding, and days so far apart that three of them fit.
AMOUNT_PLACES, DAYS_NEAR, AMOUNT_NEAR = 1_000_000, 3, 0.35
REACH = math.ceil(math.log(LANE_RATIO) * AMOUNT_PLACES) + 2


def lanes(rows: DataFrame) -> DataFrame:
    """Sub-series of identity groups of five rows or more: around each row, the rows within three days of the month, and
    those within 35 % of its amount; three rows or more and not the whole group. Gives GROUP, lane, anchor_id, n and
    signature, the MD5 of the sorted ids.

    Rows with one day, or one amount, have one lane, which is hashed once where the company's rows lie, so no list is
    written or sent. Rows that share an id are one anchor, and each has the date and amount of every one of them. ``rows``
    may bring the keys of their texts as ``text_keys``.
    """
    return by_company(rows, _lanes_in_place, lambda own: _lanes_by_joins(materialise(_lane_rows(own), "lane-rows")))


def _keys(rows: DataFrame) -> Column:
    """Identity keys of a row without their scores."""
    return F.concat(document_keys()["key"], F.col("text_keys")) if "text_keys" in rows.columns else identity_keys()["key"]


def _lanes_rows(rows: DataFrame) -> DataFrame:
    return rows.select("company_id", "type", "id", "date", "abs_amount", _keys(rows).alias("keys"))


def _lanes_in_place(rows: DataFrame) -> DataFrame:
    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_place.lanes_of(batches, DAYS_NEAR, AMOUNT_NEAR, LEAST_LANE)

    return _lanes_rows(rows).groupBy("company_id").applyInArrow(lanes, in_place.LANES)


def _lane_rows(rows: DataFrame) -> DataFrame:
    """(GROUP, n, again, id, date, abs_amount) of identity groups of LEAST_LANE rows or more; ``again``: some id of the group
    stands for several rows."""
    facts = F.collect_list(F.struct("date", "abs_amount")).over(Window.partitionBy("company_id", "id"))
    own = Window.partitionBy(*GROUP)
    sized = identity_members(rows.withColumn("facts", facts), "facts").withColumns({"n": F.count(F.lit(1)).over(own), "again": F.max(F.size("facts") > 1).over(own)})
    return sized.where(F.col("n") >= LEAST_LANE).select(*GROUP, "n", "again", "id", F.inline("facts"))


def lane_values() -> Column:
    """Of a row with date and abs_amount: array of struct(lane, anchor, place), its day and its amount with their places."""
    entry = lambda lane, value, place: F.struct(F.lit(lane).alias("lane"), value.cast("double").alias("anchor"), place.cast("long").alias("place"))
    day, amount = F.day("date"), F.col("abs_amount")
    place = F.floor(F.log(F.least(F.greatest(amount, F.lit(1e-9)), F.lit(1e300))) * AMOUNT_PLACES)
    return F.array(entry("day", day, day * (REACH // DAYS_NEAR)), entry("amount", amount, place))


def _signed(found: DataFrame, ids: Column, *kept: str) -> DataFrame:
    """Lanes by their size and hash. The ids are made once: as a plain column, every condition on their number would make
    them again."""
    each = F.transform(F.array(F.sort_array(ids)), lambda i: F.struct(F.size(i).cast("long").alias("size"), F.md5(F.array_join(i, "|")).alias("signature")))
    signed = found.select(*GROUP, "n", "lane", *kept, F.explode_outer(each).alias("s"))
    return signed.where((F.col("s.size") >= 3) & (F.col("s.size") < F.col("n"))).select(*GROUP, "lane", *kept, "s.size", "s.signature")


def _lanes_by_joins(sized: DataFrame) -> DataFrame:
    """Lanes whose rows meet by join, for groups in which an id stands for several rows, and for large companies."""
    found = []
    for lane, frame, own in (("day", day_lanes(sized, GROUP), F.day("date")), ("amount", amount_lanes(sized, GROUP), F.col("abs_amount"))):
        ids = frame.groupBy(*GROUP, "n", "anchor").agg(F.collect_list("id").alias("ids")).withColumn("lane", F.lit(lane))
        anchors = sized.select(*GROUP, "again", F.col("id").alias("anchor_id"), own.alias("anchor"))
        # An id with one row has the lane of its value; else those of all its values count together.
        one = _signed(ids, F.col("ids"), "anchor").join(anchors.where(~F.col("again")), [*GROUP, "anchor"]).select(*GROUP, "lane", "anchor_id", F.col("size").alias("n"), "signature")
        several = anchors.where("again").join(ids, [*GROUP, "anchor"]).groupBy(*GROUP, "n", "anchor_id").agg(F.flatten(F.collect_list("ids")).alias("ids")).withColumn("lane", F.lit(lane))
        found += [one, _signed(several, F.col("ids"), "anchor_id").withColumnRenamed("size", "n")]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part.select(whole.columns))
    return whole


def income_track_rows(rows: DataFrame) -> DataFrame:
    """(company_id, anchor_id, id): for each income row, the best row of every month within two days of the month and 55 %
    of the amount; four months or more. The best has the most frequent description, then the nearest amount, then comes
    first."""
    income = rows.where("type = 'income'").select("company_id", "id", "date", "abs_amount", "normalized_description")
    return by_company(income, _tracks_of_companies, _tracks_of_days)


def _tracks_of_companies(income: DataFrame) -> DataFrame:
    """Tracks where the rows of a company lie together: they meet in place."""
    anchors = income.select("company_id", F.col("id").alias("anchor_id"), F.day("date").alias("a_day"), F.col("abs_amount").alias("a_amount"))
    near = income.join(anchors.hint("merge"), "company_id").where(F.abs(F.day("date") - F.col("a_day")) <= 2)
    return _best_of_months(near.drop("a_day"))


def _tracks_of_days(income: DataFrame) -> DataFrame:
    # Days of the month that differ by two at most share a key when one side is copied to its five neighbours.
    anchors = income.select("company_id", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.day("date") - 2, F.day("date") + 2)).alias("day"), F.col("abs_amount").alias("a_amount"))
    return _best_of_months(income.withColumn("day", F.day("date")).join(anchors, ["company_id", "day"]).drop("day"))


def _best_of_months(pairs: DataFrame) -> DataFrame:
    """``pairs``: rows with anchor_id and a_amount."""
    near = pairs.where(relative_difference(F.col("abs_amount"), F.col("a_amount")) <= 0.55)
    near = near.withColumn("frequency", F.count(F.lit(1)).over(Window.partitionBy("company_id", "anchor_id", "normalized_description")))
    order = F.struct((-F.col("frequency")).alias("f"), relative_difference(F.col("abs_amount"), F.col("a_amount")).alias("d"), "date", "id")
    best = near.groupBy("company_id", "anchor_id", F.trunc("date", "MM").alias("month")).agg(F.min(order).getField("id").alias("id"))
    months = F.count(F.lit(1)).over(Window.partitionBy("company_id", "anchor_id"))
    return best.withColumn("_n", months).where("_n >= 4").select("company_id", "anchor_id", "id")


def income_tracks(rows: DataFrame) -> DataFrame:
    """The tracks of ``income_track_rows`` with their sorted ids."""
    return income_track_rows(rows).groupBy("company_id", "anchor_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def set_hash(ids: Column) -> list[Column]:
    """Two sums of 38 bits of each id: what a set of rows is told by, whatever their order. Sums of parts add up."""
    bits = lambda x: F.shiftrightunsigned(x, 26)
    return [F.sum(bits(F.xxhash64(ids))).alias("h1"), F.sum(bits(F.xxhash64(ids, F.lit("second")))).alias("h2")]


def distinct_candidates(found: DataFrame) -> DataFrame:
    """Of candidates (company_id, type, key, score, ids) with the same ids, the one of highest score, then smallest key."""
    signed = found.withColumn("signature", F.sha2(F.array_join("ids", "|"), 256))
    best = Window.partitionBy("company_id", "signature").orderBy(F.desc("score"), "key")
    return signed.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _ratios(counts: DataFrame) -> DataFrame:
    precision = F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("hit") / F.col("n_found"))
    recall = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("hit") / F.col("n_expected"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return counts.select("hit", "n_found", "n_expected", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def pair_evaluation(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the pairs of rows that share a group; (group_id, id) on both sides."""

    def pairs(groups: DataFrame) -> DataFrame:
        a, b = groups.select("group_id", F.col("id").alias("a")), groups.select("group_id", F.col("id").alias("b"))
        return a.join(b, "group_id").where("a < b").select("a", "b").distinct()

    both = pairs(found).withColumn("f", F.lit(1)).join(pairs(expected).withColumn("e", F.lit(1)), ["a", "b"], "full")
    counts = both.agg(F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hit"), F.count("f").alias("n_found"), F.count("e").alias("n_expected"))
    return _ratios(counts)


def partition_evaluation(found: DataFrame, expected: DataFrame) -> DataFrame:
    """What ``pair_evaluation`` gives where each id has one group at most on either side (another is an error): a group of
    n rows has n * (n - 1) / 2 pairs, and so has each meeting of two groups, so no pair is made."""

    def grouped(groups: DataFrame, name: str) -> DataFrame:
        each = groups.where("group_id is not null").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("group_id").alias(name))
        return each.select("id", F.when(F.col("_n") > 1, F.raise_error(F.lit("an id is in several groups")).cast("string")).otherwise(F.col(name)).alias(name))

    def pairs(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
        return groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name))

    f, e = grouped(found, "f"), grouped(expected, "e")
    return _ratios(pairs(f.join(e, "id"), ["f", "e"], "hit").crossJoin(pairs(f, ["f"], "n_found")).crossJoin(pairs(e, ["e"], "n_expected")))
