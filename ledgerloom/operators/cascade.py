"""Deletes that carry on along declared foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (child, column or columns, parent, its columns) of the ledger's tables: fixed values. Rows of a company go by its id, and
#: children go before what they refer to.
LEDGER_KEYS = [
    ("projected_cashflow_item", "recurrence_id", "approved_recurrence", "id"), ("approved_recurrence", "suggestion_id", "recurrence_suggestion", "id"),
    ("recurrence_suggestion_transaction", "recurrence_suggestion_id", "recurrence_suggestion", "id"), ("recurrence_suggestion_transaction", "transaction_id", "transaction", "id"),
    ("duplicate_candidate", "left_id", "transaction", "id"), ("duplicate_candidate", "right_id", "transaction", "id"), ("categorization_suggestion", "transaction_id", "transaction", "id"),
    ("pending_item", "transaction_id", "transaction", "id"), ("imported_transaction_raw", "bank_import_id", "bank_import", "id"), ("import_issue", "bank_import_id", "bank_import", "id"),
    ("transaction", "bank_import_id", "bank_import", "id"), ("bank_import", "uploaded_file_id", "uploaded_file", "id"),
]


def dependency_order(keys: list[tuple]) -> list[str]:
    """Tables with parents before children; a cycle is an error."""
    left = {t for child, _, parent, _ in keys for t in (child, parent)}
    order: list[str] = []
    while left:
        free = sorted(t for t in left if all(child != t or parent in order for child, _, parent, _ in keys))
        if not free:
            raise ValueError(f"foreign keys form a cycle among {sorted(left)}")
        order += free
        left -= set(free)
    return order


def cascade_delete(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: list[tuple] = LEDGER_KEYS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables without the doomed rows and all that refers to them, the rows that went).

    ``doomed``: for some tables the rows that go, as keys with columns of the table. A child goes when one of its foreign
    keys names a row of a parent that goes; a null key names none. Each foreign key is one semi join; parents are judged
    before children, so no row is looked at twice.
    """
    kept, gone = {}, {}
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    for name in [t for t in dependency_order(keys) if t in tables] + [t for t in tables if all(t not in (k[0], k[2]) for k in keys)]:
        rows = tables[name]
        reasons = [(as_list(cols), gone[parent].select(*[F.col(p).alias(c) for c, p in zip(as_list(cols), as_list(theirs))])) for child, cols, parent, theirs in keys if child == name and parent in gone]
        if name in doomed:
            reasons.append((doomed[name].columns, doomed[name]))
        stays = rows
        lost = None
        for cols, which in reasons:
            which = which.dropna().distinct()
            part = stays.join(which, cols, "left_semi")
            lost = part if lost is None else lost.unionByName(part)
            stays = stays.join(which, cols, "left_anti")
        kept[name], gone[name] = stays.select(*rows.columns), rows.limit(0) if lost is None else lost.select(*rows.columns)
    return kept, gone


def orphans(tables: dict[str, DataFrame], keys: list[tuple] = LEDGER_KEYS) -> DataFrame:
    """(child, column, n): rows whose foreign key names no row of the parent; empty after a cascade."""
    found = None
    for child, column, parent, theirs in keys:
        if child in tables and parent in tables and isinstance(column, str):
            lost = tables[child].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(theirs).alias(column)), column, "left_anti")
            row = lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(child).alias("child"), F.lit(column).alias("column"), "n").where("n > 0")
            found = row if found is None else found.unionByName(row)
    return found
