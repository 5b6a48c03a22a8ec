"""Repair of conversations' structure by generalised LR parsing of their roles, with the cheapest edits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import role_grammar as G
from .common import lookup_join, materialise
from .ranges import sha256_of_pieces

BLANKS = " \t\n\x0b\x0c\r"
#: Neighbouring role initials that are right.
LEGAL = ("su", "ua", "au")
TURNS = "array<struct<role:string,text:string>>"
_STATS = "blank long, duplicate long, truncated long, illegal long, least long, most long, distinct_turns long, first_turn long, last_turn long, first_symbol string, last_symbol string"
_RUN = f"conv_id long, part int, edge int, {_STATS}, cost long, audit string, turns {TURNS}, symbols string, kinds string, ways array<struct<entry:int,node:int,cost:long,rank:int>>"
_COLUMNS = [x.split()[0] for x in _STATS.split(", ")]


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults made by the checksum of ``conv_id:turn`` modulo 20: 0 leaves the row out, 1 empties its
    text, 2 takes its full stops, exclamation and question marks out, 3 repeats it (``copies`` 2), 4 makes it the user's.
    Null fields count as one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"))
    rows = rows.withColumn("_n", F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20).where("_n <> 0")
    text = F.when(F.col("_n") == 1, "").when(F.col("_n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_n") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows once with their number, whether their role and text came in an earlier turn, and marks of their text."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = materialise(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", digest), "repair-rows")
    # A turn of null comes before all others.
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.groupBy("conv_id", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialise(again, "repair-again")
    key = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), "digest"))
    seen = F.coalesce(when > F.col("first"), F.lit(False))
    rows = lookup_join(rows.withColumn("_key", key), again.select(key.alias("_key"), "first", "n"), "_key", "n", "left")
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", "digest", "role", "text", "copies", seen.alias("seen"), (body == "").alias("is_blank"), F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("symbol"),
    )


def _kind(row: dict) -> int:
    return G.BLANK if row["is_blank"] else G.DUPLICATE if row["seen"] else G.SOUND if row["ended"] else G.CUT_OFF


def _stats(rows: list[dict], symbols: str, kinds: list[int]) -> dict:
    turns = [r["turn"] for r in rows]
    known = [t for t in turns if t is not None]
    return {
        "blank": kinds.count(G.BLANK), "duplicate": kinds.count(G.DUPLICATE), "truncated": kinds.count(G.CUT_OFF), "illegal": sum(a + b not in LEGAL for a, b in zip(symbols, symbols[1:])),
        "least": min(known, default=None), "most": max(known, default=None), "distinct_turns": len(set(known)), "first_turn": turns[0], "last_turn": turns[-1], "first_symbol": symbols[0], "last_symbol": symbols[-1],
    }


def _turns(given: list[tuple[str, str]], audit: str, roles: list[str]) -> list[dict]:
    """The repaired turns: ``roles`` are those that each row leaves, inserted ones first."""
    out, letters = [], (x for x in audit if x != "I")
    for i, left in enumerate(roles):
        letter = next(letters, "")
        inserted = left[:-1] if letter in ("K", "R") else left
        out += [{"role": G.ROLES[x], "text": ""} for x in inserted]
        if letter in ("K", "R"):
            out.append({"role": given[i][0] if letter == "K" else G.ROLES[left[-1]], "text": given[i][1]})
    return out


def _run(rows: list[dict], part: int, edge: int | None) -> dict:
    expanded = [(r, k) for r in rows for k in [_kind(r), *[G.BLANK if r["is_blank"] else G.DUPLICATE] * (r["copies"] - 1)]]
    symbols, kinds = "".join(r["symbol"] for r, _ in expanded), [k for _, k in expanded]
    given = [(r["role"], r["text"]) for r, _ in expanded]
    out = {"conv_id": rows[0]["conv_id"], "part": part, "edge": edge, **_stats(rows, symbols, kinds), "cost": None, "audit": None, "symbols": None, "kinds": None, "ways": None}
    steps = list(zip(symbols, kinds))
    if edge is None:
        out["cost"], out["audit"], roles = G.repaired(steps, 0)
        return {**out, "turns": _turns(given, out["audit"], roles)}
    ways = [dict(zip(("entry", "node", "cost", "rank"), way)) for way in G.summary(steps)]
    return {**out, "turns": [{"role": a, "text": b} for a, b in given], "symbols": symbols, "kinds": "".join(map(str, kinds)), "ways": ways}


def _runs(schema: pa.Schema):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number, size, done = TaskContext.get().partitionId(), [], 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["conv_id"] != row["conv_id"]:
                    done.append(_run(held, part, 0 if number == 0 else None))
                    size += len(held)
                    held, number = [], number + 1
                    if size > 2000:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, size = [], 0
                held.append(row)
        if held:
            done.append(_run(held, part, min(number, 1)))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return read


_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("edge", pa.int32()), *[(c, pa.string() if c.endswith("symbol") else pa.int64()) for c in _COLUMNS], ("cost", pa.int64()), ("audit", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("symbols", pa.string()), ("kinds", pa.string()),
    ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("node", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))),
])
_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _whole(runs: pd.DataFrame) -> pd.DataFrame:
    """A conversation's runs, one for each range that it lies in: its totals, and where each run's way begins and ends."""
    runs = runs.sort_values(["part", "edge"])
    rows = runs.astype(object).where(runs.notna(), None).to_dict("records")
    cost, ways, last = G.joined([[(w["entry"], w["node"], w["cost"], w["rank"]) for w in r["ways"]] for r in rows])
    known = [r for r in rows if r["least"] is not None]
    distinct = sum(r["distinct_turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(rows, rows[1:]))
    gaps = max(r["most"] for r in known) - min(r["least"] for r in known) + 1 - distinct if known else 0
    illegal = sum(r["illegal"] for r in rows) + sum(a["last_symbol"] + b["first_symbol"] not in LEGAL for a, b in zip(rows, rows[1:]))
    out = {"conv_id": rows[0]["conv_id"], "gaps": gaps, "illegal": illegal, "cost": cost, **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}}
    out = [{**out, "part": r["part"], "edge": r["edge"], "entry": e, "leave": x, "head": i == 0, "last": last if i == len(rows) - 1 else ""} for i, (r, (e, x)) in enumerate(zip(rows, ways))]
    return pd.DataFrame(out).astype({"conv_id": "Int64"})


def _edge_turns(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            _, audit, roles = G.repaired(list(zip(r.symbols, map(int, r.kinds))), r.entry, r.leave)
            turns = _turns([(t["role"], t["text"]) for t in r.turns], audit, [*roles[:-1], r.last])
            out.append((r.conv_id, r.part, r.edge, audit + "I" * len(r.last), turns))
        yield pd.DataFrame(out, columns=["conv_id", "part", "edge", "audit", "turns"]).astype({"conv_id": "Int64"})


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations given as (conv_id, turn, role, text, copies); returns (totals, pieces).

    Totals: conv_id, gaps, blank, duplicate, truncated, illegal, cost. Pieces: conv_id, part, edge, alone, audit, turns (an
    array of role and text). A conversation has one piece (``alone``), or one for each range that it lies in, in the order
    of ``part`` and ``edge``.

    Rows go by turn, null first; rows of one turn by a digest of role and text; equal rows stand side by side. The first
    fault of a row counts: blank, duplicate (role and text came before), truncated (does not end in ``.!?``). Kept rows
    cost nothing, another role 2, deletion 3, an inserted empty turn 2, a truncated row that stays 1; blank rows and
    duplicates are deleted. The cheapest edits make the role initials ``(s?(ua)+)?``; of several, those whose initials
    come first in ASCII. Role and text are not null here; a null conversation is one of its own; no rows give none.

    Rows are sorted in ranges, so a large conversation lies in several; what a range does to each stack that may lie
    below it is small, and put together decides which way each range takes.
    """
    given = _marked(rows)
    ranged = given.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    runs = materialise(ranged.drop("digest").mapInArrow(_runs(_SCHEMA), _RUN), "repair-runs")
    edges = runs.where("edge is not null")
    plan = edges.select("conv_id", "part", "edge", *_COLUMNS, "ways").groupBy("conv_id").applyInPandas(
        _whole, "conv_id long, gaps long, illegal long, cost long, blank long, duplicate long, truncated long, part int, edge int, entry int, leave int, head boolean, last string"
    )
    plan = materialise(plan, "repair-plan")  # two rows for a range at most
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct_turns"), F.lit(0).cast("long"))
    totals = runs.where("edge is null").withColumn("gaps", gaps).select("conv_id", *_TOTALS).unionByName(plan.where("head").select("conv_id", *_TOTALS))
    ways = F.broadcast(plan.select(F.col("part").alias("_part"), F.col("edge").alias("_edge"), "entry", "leave", "last"))
    spread = edges.join(ways, (F.col("part") == F.col("_part")) & (F.col("edge") == F.col("_edge"))).select("conv_id", "part", "edge", "symbols", "kinds", "turns", "entry", "leave", "last")
    spread = spread.mapInPandas(_edge_turns, f"conv_id long, part int, edge int, audit string, turns {TURNS}")
    names = ["conv_id", "part", "edge", "alone", "audit", "turns"]
    pieces = runs.where("edge is null").withColumn("alone", F.lit(True)).select(*names).unionByName(spread.withColumn("alone", F.lit(False)).select(*names))
    return totals, pieces


def _body(turns: str = "turns") -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def repaired_digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 after repair of ``rows``; zeros, an empty audit and the empty string's hash where it has no rows."""
    totals, pieces = repair_conversations(rows)
    alone = pieces.where("alone").select("conv_id", "audit", F.sha2(_body(), 256).alias("repaired_sha256"))
    split = materialise(pieces.where("not alone").select("conv_id", "part", "edge", "audit", (F.size("turns") > 0).alias("any"), _body().cast("binary").alias("body")), "repair-pieces")
    audits = split.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "edge", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hashes = sha256_of_pieces(split.where("any"), ["conv_id"], ["part", "edge"], "body", b"\n").withColumnRenamed("conv_id", "own")
    split = audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    found = alone.unionByName(split).withColumnRenamed("conv_id", "own")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    totals = totals.withColumnRenamed("conv_id", "counted")
    joined = ids.join(totals, F.col("conv_id").eqNullSafe(F.col("counted")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("conv_id", *[zero(c) for c in _TOTALS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_digests(conversations, damaged(conversations))
