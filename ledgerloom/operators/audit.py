"""Audits of suggestions and queues against labelled truth, and diagnostics of overlap and coverage."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import audit_text
from ledgerloom.plans.scratch import materialise

#: Upper bounds and names of the amount bands of audits.
BANDS = ((100, "0-99.99"), (500, "100-499.99"), (1000, "500-999.99"), (5000, "1000-4999.99"), (20000, "5000-19999.99"))
LAST_BAND = "20000+"
#: Words that a description family leaves out, and the name of an empty one.
FAMILY_NOISE = "SYN DOC NF REF PARC CP ISO".split()
NO_FAMILY = "SEM DESCRICAO"
#: The category that no rule is mined for.
UNCATEGORISED = "cat-uncategorized"


def amount_band(amount: Column) -> Column:
    """``0-99.99`` to ``5000-19999.99``, then ``20000+``."""
    a, rule = F.abs(amount), F
    for high, name in BANDS:
        rule = rule.when(a < high, name)
    return rule.otherwise(LAST_BAND)


def description_family(text: Column) -> Column:
    """A description in audit form without numbers and the words that stand for documents."""
    plain = F.regexp_replace(F.regexp_replace(audit_text(F.coalesce(text, F.lit(""))), r"\b[0-9]+\b", " "), rf"\b({'|'.join(FAMILY_NOISE)})\b", " ")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit("")), F.lit(NO_FAMILY))


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n), most frequent first."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def rule_keys(rows: DataFrame, *more: str) -> DataFrame:
    """(rule_type, value, category_id, more): what rules of each type could compare, for each categorised row."""
    party = F.coalesce("counterparty_name", F.lit(""))
    kinds = {
        "document_equals": F.col("document_number"), "counterparty_contains": party, "description_contains": F.col("family"),
        "counterparty_and_amount_range": F.when(party != "", F.concat(party, F.lit("|"), amount_band(F.col("amount")))),
    }
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("rule_type"), c.alias("value")) for k, c in kinds.items()]))
    each = rows.where((F.col("category_id") != "") & (F.col("category_id") != UNCATEGORISED)).select("category_id", *more, keys.alias("k"))
    return each.select("k.*", "category_id", *more).where("value <> ''")


def dominant_categories(rows: DataFrame) -> DataFrame:
    """(rule_type, value, all, b): for each key its number of rows and, of its most frequent category, the first by name of
    several, category_id, n and months."""
    each = rule_keys(rows.withColumn("month", F.trunc("date", "MM")), "month")
    counted = each.groupBy("rule_type", "value", "category_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("month").alias("months"))
    return counted.groupBy("rule_type", "value").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("order"), "category_id", "n", "months")).alias("b"))


def mine_rules(rows: DataFrame, purity: float = 0.9, least: int = 3, months: int = 3) -> DataFrame:
    """Keys of categorised rows that point to one category: (rule_type, value, category_id, n, months, purity, general).

    ``rows``: counterparty_name, document_number, family, amount, category_id, date. ``n`` and ``months`` count the rows of
    the dominant category, the most frequent one, then the first by name. A key is general when they are ``least`` rows or
    more in ``months`` months or more, and ``purity`` of its rows at least.
    """
    best = dominant_categories(rows)
    share = F.col("b.n") / F.col("all")
    general = (share >= purity) & (F.col("b.n") >= least) & (F.col("b.months") >= months)
    return best.select("rule_type", "value", "b.category_id", "b.n", "b.months", share.alias("purity"), general.alias("general"))


def mined_coverage(mined: DataFrame) -> DataFrame:
    """Rules and rows of the general candidates of each rule type."""
    return mined.where("general").groupBy("rule_type").agg(F.count(F.lit(1)).alias("rules"), F.sum("n").alias("transactions"))


def coverage(matches: DataFrame) -> DataFrame:
    """Matches, transactions and rules of each rule type."""
    return matches.groupBy("rule_type").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("id").alias("transactions"), F.count_distinct("rule_id").alias("rules"))


def pending_kpis(items: DataFrame) -> DataFrame:
    """Open items of each company in several units: items, business events and the things they are about.

    ``items``: company_id, pending_type, transaction_id, suggestion_id, recurrence_suggestion_id, duplicate_candidate_id,
    dedup_key. An event is the first of these ids that an item has, of one type.
    """
    thing = F.coalesce("transaction_id", "suggestion_id", "recurrence_suggestion_id", "duplicate_candidate_id", "dedup_key")
    return items.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct(F.struct("pending_type", thing)).alias("events"), F.count_distinct("transaction_id").alias("transactions"),
        F.count_distinct("suggestion_id").alias("suggestions"), F.count_distinct("recurrence_suggestion_id").alias("recurrence_groups"), F.count_distinct("duplicate_candidate_id").alias("duplicates"),
    )


def overlap_pairs(links: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of suggestions that share rows: shared rows, Jaccard and overlap coefficients, the largest overlap first;
    ``most`` is a top-k report. Suggestions with the same rows are one class, and the inverted index of links
    (suggestion_id, transaction_id) holds each class once."""
    classes = suggestion_classes(links)
    return class_pairs(shared_rows(classes), classes, most=most)


def suggestion_classes(links: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within, suggestion_id, ids, size, class): suggestions with the same rows are one class, named by the smallest.
    ``within`` are columns of which neither a suggestion nor a row has two values."""
    sets = links.where("transaction_id is not null").groupBy(*within, "suggestion_id").agg(F.array_sort(F.collect_set("transaction_id")).alias("ids"))
    return sets.withColumns({"size": F.size("ids"), "class": F.min("suggestion_id").over(Window.partitionBy(*within, "ids"))})


def shared_rows(classes: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within, left_class, right_class, shared): classes that share rows, each with itself as well."""
    each = classes.where(F.col("class") == F.col("suggestion_id")).select(*within, "class", F.explode("ids").alias("transaction_id"))
    of_row = each.groupBy(*within, "transaction_id").agg(F.array_sort(F.collect_list("class")).alias("all"))
    pairs = of_row.select(*within, "all", F.explode("all").alias("left_class")).select(*within, "left_class", F.explode("all").alias("right_class"))
    return pairs.where("left_class <= right_class").groupBy(*within, "left_class", "right_class").agg(F.count(F.lit(1)).alias("shared"))


def class_pairs(shared: DataFrame, classes: DataFrame, within: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """What ``overlap_pairs`` gives, from the classes and the rows they share."""
    found = measured_overlaps(class_overlaps(shared, classes, within)).select("left_id", "right_id", "shared", "jaccard", "overlap")
    return found.orderBy(F.desc("overlap"), F.desc("jaccard"), "left_id", "right_id").limit(most) if most else found


def class_overlaps(shared: DataFrame, classes: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within, left_id, right_id, shared, left_size, right_size) from the classes and the rows they share."""
    side = lambda name: classes.select(*within, F.col("class").alias(f"{name}_class"), F.col("suggestion_id").alias(f"{name}_id"), F.col("size").alias(f"{name}_size"))
    joined = shared.join(side("left"), [*within, "left_class"]).join(side("right"), [*within, "right_class"]).where("left_class < right_class or left_id < right_id")
    turned = F.col("left_id") > F.col("right_id")
    either = lambda a, b, kind: F.when(turned, F.col(f"{b}_{kind}")).otherwise(F.col(f"{a}_{kind}"))
    ids = [either("left", "right", "id").alias("left_id"), either("right", "left", "id").alias("right_id")]
    return joined.select(*within, *ids, "shared", either("left", "right", "size").cast("long").alias("left_size"), either("right", "left", "size").cast("long").alias("right_size"))


def measured_overlaps(found: DataFrame) -> DataFrame:
    """Adds jaccard and overlap to pairs with shared, left_size and right_size."""
    return found.withColumns({"jaccard": F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared")), "overlap": F.col("shared") / F.least("left_size", "right_size")})


def pending_integrity(suggestions: DataFrame, items: DataFrame) -> DataFrame:
    """Suggestions and items that do not fit: ``missing`` and ``multiple`` by suggestion, ``extra`` by item."""
    counted = items.groupBy("suggestion_id").agg(F.count(F.lit(1)).alias("n"))
    joined = suggestions.select("suggestion_id", F.lit(True).alias("known")).join(counted, "suggestion_id", "full")
    problem = F.when(F.col("known").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "multiple")
    return joined.select("suggestion_id", problem.alias("problem")).where("problem is not null")


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Adds to each row the ``value`` of the latest event of its keys at or before its time; null before the first.

    Rows and events are merged and sorted once by key and time, and the last value seen is carried on: no range join.
    """
    order = Window.partitionBy(*keys).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.select(*keys, time, F.lit(0).alias("_kind"), F.col(value).alias("_value")).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    carried = both.withColumn(f"as_of_{value}", F.last("_value", ignorenulls=True).over(order)).where("_kind = 1")
    return carried.select(*rows.columns, f"as_of_{value}")


def similar_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], most: int = 10) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def candidate_classes(found: DataFrame, truth: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Class of each suggestion against labelled groups: suggestion_id, group_id, mapped, precision, recall, f1, confidence, class.

    ``found``: (suggestion_id, transaction_id); ``truth``: (transaction_id, group_id, kind, month, party), one row for each
    labelled transaction; ``candidates``: (suggestion_id, frequency, confidence); ``groups``: (group_id, kind, frequency).
    Two groups with two rows and 15 % of a suggestion's labelled rows each make it a merge error. With two rows of its best
    group it is exact at a precision of 0.9, a recall of 0.8 and a fitting frequency, else partial. Of the others those of
    transfers are false, those of one party over four months ambiguous.
    """
    labelled = materialise(found.join(truth, "transaction_id").drop("transaction_id"), "labelled")
    known = labelled.groupBy("suggestion_id").agg(F.count(F.lit(1)).alias("mapped"), F.count_distinct("month").alias("months"), F.count_if(F.col("kind").rlike("(?i)transfer")).alias("transfers"))
    party = labelled.where("party <> ''").groupBy("suggestion_id", "party").agg(F.count(F.lit(1)).alias("n")).groupBy("suggestion_id").agg(F.max("n").alias("of_party"))
    per_group = labelled.where("group_id is not null").groupBy("suggestion_id", "group_id").agg(F.count(F.lit(1)).alias("k")).join(known.select("suggestion_id", "mapped"), "suggestion_id")
    best = per_group.groupBy("suggestion_id").agg(
        F.min(F.struct((-F.col("k")).alias("order"), "group_id", "k")).alias("b"), F.count_if((F.col("k") >= 2) & (F.col("k") / F.col("mapped") >= 0.15)).alias("significant")
    )
    expected = truth.where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("expected"))
    sides = groups.join(expected, "group_id", "left").select("group_id", F.col("kind").alias("group_kind"), F.col("frequency").alias("group_frequency"), "expected")
    joined = candidates.join(known, "suggestion_id", "left").join(party, "suggestion_id", "left").join(best, "suggestion_id", "left").withColumn("group_id", F.col("b.group_id")).join(sides, "group_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    mapped, k = F.greatest(count("mapped"), F.lit(1)), F.coalesce(F.col("b.k"), F.lit(0))
    precision, recall = k / mapped, k / F.greatest(count("expected"), F.lit(1))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    fits = F.coalesce((F.col("frequency") == F.col("group_frequency")) | ((F.col("group_kind") == "frequent_supplier") & (F.col("frequency") == "biweekly")), F.lit(False))
    kind = (
        F.when(count("significant") >= 2, "merge_error").when((k >= 2) & (precision >= 0.9) & (recall >= 0.8) & fits, "exact_match").when(k >= 2, "partial_match")
        .when(count("transfers") / mapped >= 0.5, "false_positive").when((count("months") >= 4) & (count("of_party") / mapped >= 0.75), "ambiguous").otherwise("false_positive")
    )
    return joined.select("suggestion_id", "group_id", count("mapped").alias("mapped"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "confidence", kind.alias("class"))


def mark_variants(classes: DataFrame, labelled: DataFrame, share: float = 0.7) -> DataFrame:
    """``classes`` with the variants of better suggestions as ``duplicate_variant``.

    Of the suggestions of one group, other than merge errors, the best by f1, then confidence, then id is taken first; one
    that shares more than ``share`` of the smaller set of labelled rows with a taken one is a variant. ``labelled``:
    (suggestion_id, transaction_id). Only pairs that share a row are counted.
    """
    classes = materialise(classes, "classes")
    ranked = classes.where("group_id is not null and class <> 'merge_error'").select("group_id", "suggestion_id", "f1", "confidence")
    rows = materialise(labelled.join(ranked.select("suggestion_id", "group_id"), "suggestion_id").distinct(), "ranked-rows")
    sizes = rows.groupBy("suggestion_id").agg(F.count(F.lit(1)).alias("size"))
    side = lambda frame, name, *more: frame.select(F.col("suggestion_id").alias(name), *more)
    keys = ("group_id", "transaction_id")
    pairs = side(rows, "one", *keys).join(side(rows, "other", *keys), list(keys)).where("one < other")
    shared = pairs.groupBy("group_id", "one", "other").agg(F.count(F.lit(1)).alias("both"))
    least = shared.join(side(sizes, "one", F.col("size").alias("n")), "one").join(side(sizes, "other", F.col("size").alias("m")), "other")
    close = least.where(F.col("both") / F.least("n", "m") > share).select("group_id", "one", "other")

    def choose(suggestions: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for one, other in zip(pairs["one"], pairs["other"]):
            near.setdefault(one, set()).add(other)
            near.setdefault(other, set()).add(one)
        taken, variants = set(), []
        for s in suggestions.sort_values(["f1", "confidence", "suggestion_id"], ascending=[False, False, True])["suggestion_id"]:
            if near.get(s, set()) & taken:
                variants.append(s)
            else:
                taken.add(s)
        return pd.DataFrame({"suggestion_id": variants}, dtype=object)

    close = materialise(close, "variant-pairs")
    # Nearly all pairs stand alone: neither has another near one, and the later of the two is the variant.
    ends = close.select("group_id", F.explode(F.array("one", "other")).alias("end"))
    busy = materialise(ends.groupBy("group_id", "end").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "variant-knots")
    knot = lambda name: busy.select("group_id", F.col("end").alias(name), F.lit(True).alias(f"{name}_busy"))
    told = close.join(knot("one"), ["group_id", "one"], "left").join(knot("other"), ["group_id", "other"], "left")
    is_alone = F.col("one_busy").isNull() & F.col("other_busy").isNull()
    rest = told.where(~is_alone).select("group_id", "one", "other")
    order = F.struct((-F.col("f1")).alias("f1"), F.col("confidence").isNull().alias("unsure"), (-F.col("confidence")).alias("confidence"), "suggestion_id")
    rank = lambda name: ranked.select("group_id", F.col("suggestion_id").alias(name), order.alias(f"{name}_order"))
    alone = told.where(is_alone).select("group_id", "one", "other").join(rank("one"), ["group_id", "one"]).join(rank("other"), ["group_id", "other"])
    later = alone.select(F.greatest("one_order", "other_order")["suggestion_id"].alias("suggestion_id"))
    involved = ranked.join(rest.select("group_id").distinct(), "group_id", "left_semi")
    chosen = involved.groupBy("group_id").cogroup(rest.groupBy("group_id")).applyInPandas(choose, "suggestion_id string")
    variants = later.unionByName(chosen).withColumn("variant", F.lit(True))
    return classes.join(variants, "suggestion_id", "left").withColumn("class", F.when(F.col("variant"), "duplicate_variant").otherwise(F.col("class"))).drop("variant")


def group_coverage(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """How each labelled group is found: (group_id, coverage: exact, partial or absent, fragmented: by several)."""
    seen = classes.where(F.col("class").isin("exact_match", "partial_match")).groupBy("group_id").agg(F.bool_or(F.col("class") == "exact_match").alias("exact"), F.count(F.lit(1)).alias("n"))
    joined = groups.select("group_id").distinct().join(seen, "group_id", "left")
    kind = F.when(F.col("n").isNull(), "absent").when(F.col("exact"), "exact").otherwise("partial")
    return joined.select("group_id", kind.alias("coverage"), (F.coalesce("n", F.lit(0)) > 1).alias("fragmented"))


#: What a class means to a reviewer, and what to do with it.
ACTIONS = {
    "exact_match": ("true_positive", "manter melhor representante"), "partial_match": ("fragmented_true_positive", "manter melhor representante"), "duplicate_variant": ("duplicate_actionable", "superseded"),
    "ambiguous": ("ambiguous", "revisao humana"), "merge_error": ("false_positive", "non_actionable/rejected"), "false_positive": ("false_positive", "non_actionable/rejected"),
}


def dispositions_of(classes: DataFrame) -> DataFrame:
    """Adds ``actionable`` and ``disposition`` to classified suggestions."""
    named = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i])]), F.col("class"))
    return classes.withColumn("actionable", named(0)).withColumn("disposition", named(1))


def actionable(classes: DataFrame, useful: float = 0.7, false: float = 0.2) -> DataFrame:
    """Counts of what a reviewer can use, and whether the queue passes: ``useful`` share at least, ``false`` share at most."""
    kinds = sorted({v[0] for v in ACTIONS.values()})
    total = dispositions_of(classes).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("actionable") == k).alias(k) for k in kinds])
    good = (F.col("true_positive") + F.col("fragmented_true_positive") + F.col("ambiguous")) / F.greatest("total", F.lit(1))
    return total.select("*", good.alias("useful_share"), ((good >= useful) & (F.col("false_positive") <= F.col("total") * false)).alias("passes"))


def link_records(stored: DataFrame, truth: DataFrame) -> DataFrame:
    """One-to-one links of stored rows to labelled ones of one company, date and cents: (stored_id, truth_id, score, tied).

    Of a block's pairs the best score is taken first: one point, ten for equal text, five for one document, three for one
    counterparty. ``tied``: the two best pairs of the stored row have one score. Blocks hold the few rows of a company that
    share a day and an amount.
    """
    keys = ["company_id", "date", "cents"]
    t = truth.select(*keys, F.col("id").alias("truth_id"), F.col("text").alias("t_text"), F.col("party").alias("t_party"), F.col("document").alias("t_document"))
    pairs = stored.select(*keys, F.col("id").alias("stored_id"), "text", "party", "document").join(t, keys)
    same = lambda a, b, n: F.when(F.col(a) == F.col(b), n).otherwise(0)
    scored = pairs.select(*keys, "stored_id", "truth_id", (1 + same("text", "t_text", 10) + same("document", "t_document", 5) + same("party", "t_party", 3)).cast("int").alias("score"))

    # A block lies in one partition, its best pairs first, so the choice is made while its rows go by.
    placed = scored.repartition(*keys)
    own = Window.partitionBy(*keys, "stored_id")
    best = placed.withColumn("_top", F.max("score").over(own)).withColumn("tied", F.count_if(F.col("score") == F.col("_top")).over(own) > 1)
    ordered = best.sortWithinPartitions(*keys, F.desc("score"), "stored_id", "truth_id").select(*keys, "stored_id", "truth_id", "score", "tied")

    def greedy(batches):
        block, left, right = None, set(), set()
        for batch in batches:
            taken = []
            for company, date, cents, stored_id, truth_id in zip(*[batch[c].tolist() for c in (*keys, "stored_id", "truth_id")]):
                if (company, date, cents) != block:
                    block, left, right = (company, date, cents), set(), set()
                free = stored_id not in left and truth_id not in right
                if free:
                    left.add(stored_id)
                    right.add(truth_id)
                taken.append(free)
            yield batch.loc[taken, ["stored_id", "truth_id", "score", "tied"]]

    return ordered.mapInPandas(greedy, "stored_id string, truth_id string, score int, tied boolean")


def partition_cover(rows: DataFrame, goal: float = 0.8) -> DataFrame:
    """The greedy cover where each row has one key: (key, n) by falling n, then key, until ``goal`` of all rows is reached.

    No step changes what the other keys add, so the cover is a running sum over the sorted keys, taken in ranges; rows
    without a key count among all rows only.
    """
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(counts.where("key is not null").repartitionByRange(parts, F.desc("n"), F.asc("key")).withColumn("part", F.spark_partition_id()), "cover-keys")
    # One row for each range.
    sums = ranged.groupBy("part").agg(F.sum("n").alias("own")).withColumn("before", F.sum("own").over(Window.orderBy("part")) - F.col("own")).drop("own")
    within = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("n"), "key")) - F.col("n")
    placed = ranged.withColumn("within", within).join(F.broadcast(sums), "part").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))
    return placed.where(F.col("before") + F.col("within") < goal * F.col("total")).select("key", "n")
