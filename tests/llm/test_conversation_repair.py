"""Conversation repair against a search over all edits, on small conversations and on the whole sample table."""

import hashlib
import heapq
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_repair as C
from ledgerloom.llm import role_grammar as G

@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables stay in several ranges, so that conversations lie across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


BLANKS = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, repaired rows) of [(role, text, kind)] by a shortest-path search with whole audits as ties."""
    queue, seen = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        push = lambda c, x, j, s, *row: heapq.heappush(queue, (cost + c, audit + x, j, s, out + row))
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT:
                push(2, "I", i, NEXT[state, role[0]], (role, ""))
        if i < len(rows):
            role, text, kind = rows[i]
            push(3, "D", i + 1, state)
            if kind < 2:
                if (state, role[:1]) in NEXT:
                    push(kind, "K", i + 1, NEXT[state, role[:1]], (role, text))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        push(2 + kind, "R", i + 1, NEXT[state, new[0]], (new, text))


def brute(table):
    rows_of = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        rows_of[conv] += [(turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    for conv, rows in rows_of.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        kinds, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(BLANKS)
            kinds.append(2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1)
            seen.add((role, text))
        cost, audit, out = cheapest([(r, t, k) for (_, r, t), k in zip(rows, kinds)])
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        text = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count(2), kinds.count(3), kinds.count(1), illegal, cost, audit, text


def found(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    order = lambda r: (r[0] is not None, r[0] or 0)
    return sorted((tuple(r) for r in C.repaired_digests(frame, C.damaged(frame)).select(*names).collect()), key=order)


def conversations(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(3))
    text = lambda: r.choice([f"{word()} {word()}.", f"{word()}!", f"{word()} ", "", " \n", "same.", "é?\t"])
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", "umpire"])
    rows = [(c, t, role(), text()) for c in range(40) for t in range(r.randint(1, 7))]
    rows += [(1000, t, ["user", "assistant"][t % 2] if r.random() < 0.8 else role(), f"{t} {text()}" if r.random() < 0.9 else text()) for t in range(600)]
    rows += [(None, 0, "user", "x."), (None, None, None, None), (50, None, "user", "a."), (50, None, "assistant", "b"), (50, 3, None, "c."), (51, 5, "user", "a."), (51, 5, "user", "a."), (51, 7, "user", "a.")]
    rows += [(52, i, "user", "again.") for i in range(-3, 40)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_equals_a_search_over_all_edits(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("cost", F.lit(1)).repartition(5)
    assert found(frame) == sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_repair_of_the_conversations_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    if not os.path.exists(path):
        pytest.skip("no sample tables here")
    frame = spark.read.parquet(path)
    assert found(frame) == sorted(brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]))


def test_repair_of_nothing(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_repaired_turns_follow_the_grammar(spark):
    rows = conversations(9)
    totals, pieces = C.repair_conversations(C.damaged(spark.createDataFrame(rows, SCHEMA)))
    whole = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.part, -1 if r.edge is None else r.edge)):
        whole.setdefault(r.conv_id, []).extend(t.role for t in r.turns)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)) for roles in whole.values())
    assert pieces.where("conv_id = 1000").count() > 1 and totals.where("conv_id = 1000").count() == 1


def test_parts_of_a_conversation_join_to_the_same_repair():
    r = random.Random(1)
    for _ in range(400):
        rows = [(r.choice("suuaax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(1, 25))]
        cost, audit, _ = G.repaired(rows, 0)
        assert (cost, audit) == cheapest([(symbol, "", kind) for symbol, kind in rows])[:2]
        cuts = [0, *sorted(r.sample(range(1, len(rows)), min(len(rows) - 1, 3))), len(rows)]
        parts = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        total, ways, last = G.joined([G.summary(p) for p in parts])
        assert (total, "".join(G.repaired(p, *way)[1] for p, way in zip(parts, ways)) + "I" * len(last)) == (cost, audit)
