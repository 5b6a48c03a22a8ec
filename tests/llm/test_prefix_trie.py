"""The trie of conversations against nested dictionaries, with subtrees of all sizes in shards and above them."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import prefix_trie as P
from ledgerloom.llm import ranges
from ledgerloom.llm.slot_table import SlotTable

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables stay in several ranges, so that groups lie across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(table):
    own = {}
    for conv, turn, role, text in table:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [r[3:] for r in sorted(rows)] for c, rows in own.items()}
    nodes = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": []})
            node["members"].append(c)
        nodes[tuple(path)]["ends"].append(c)
    for path, node in nodes.items():
        node["below"] = [p for p in nodes if p[: len(path)] == path]
    leaf = {p for p, n in nodes.items() if len(n["below"]) == 1}
    saved = {p: (len(n["members"]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0 for p, n in nodes.items()}
    for p, n in nodes.items():
        parent = min(nodes[p[:-1]]["members"]) if p else None
        children = sum(len(q) == len(p) + 1 for q in n["below"])
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        yield min(n["members"]), len(p), parent, len(n["members"]), children, sum(q in leaf for q in n["below"]), sum(saved[q] for q in n["below"]), ends


def conversations(seed=3):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "a  b\n c", "", "é d"])) for c in range(120) for t in range(r.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(3)]
    rows += [(300, t, "user", f"long {t % 7}") for t in range(80)] + [(320, t, "user", f"long {t % 7}") for t in range(60)]
    rows += [(None, 1, "user", "x"), (-7, 1, None, "x"), (-7, None, "user", None), (401, 1, "user", "x"), (401, 1, "user", "x"), (403, 2, "a", "bc"), (404, 2, "ab", "c")]
    return rows


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
by = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("subtree_turns,shard_nodes", [(100_000, 500_000), (40, 50), (0, 20)])
def test_trie_equals_nested_prefixes(spark, subtree_turns, shard_nodes):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("size", F.lit(0)).repartition(5)
    found = P.prefix_trie(P.rebuilt(frame), subtree_turns, shard_nodes).select(*NAMES).collect()
    assert sorted(map(tuple, found), key=by) == sorted(brute(rows), key=by)


def test_trie_of_nothing(spark):
    assert P.prefix_trie(P.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_slots_are_minimal_and_verified(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(-(1 << 63), 1 << 63, n))
    table = SlotTable(keys, keys[::-1])
    assert sorted(table.slot.tolist()) == list(range(len(keys))) and (table.find(keys, keys[::-1]) == table.slot).all()
    assert (table.find(r.integers(0, 1 << 40, 1000), r.integers(0, 1 << 40, 1000)) == -1).all()


def test_slots_beyond_the_levels(monkeypatch):
    monkeypatch.setattr("ledgerloom.llm.slot_table.MOST_LEVELS", 1)
    table = SlotTable(np.arange(100))
    assert table.rest and (table.find(np.arange(100)) == table.slot).all() and table.find(np.array([100, -1])).tolist() == [-1, -1]


def test_running_sums_over_ranges(spark):
    rows = [(g, i, i % 5) for g, n in ((None, 3), (1, 500), (2, 1), (3, 40)) for i in range(n)]
    out = ranges.running(spark.createDataFrame(rows, "g long, i long, v long").repartition(3), "g", ["i"], ["v"], "test-running").collect()
    assert len(out) == len(rows) and all((r.place, r.run_v) == (r.i + 1, sum(x % 5 for x in range(r.i + 1))) for r in out)


def test_lists_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE_BYTES", 160)
    rows = [(g, x) for g, n in ((1, 300), (2, 1), (3, 25)) for x in range(-5, n)]
    out = ranges.sha256_of_lists(spark.createDataFrame(rows, "g long, x long").repartition(3), ["g"], "x", "test-lists").collect()
    assert {r.g: r.sha256 for r in out} == {g: hashlib.sha256(",".join(map(str, range(-5, n))).encode()).hexdigest() for g, n in ((1, 300), (2, 1), (3, 25))}
