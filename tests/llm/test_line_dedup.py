"""Line dedup against a plain count of lines; insertions and deletions against building the index anew."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup as L
from ledgerloom.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed, ids):
    r = random.Random(seed)
    lines = [f"Shared line number {i} of the corpus" for i in range(6)] + ["é" * 20, "e" * 19, "  \tSHARED line number 1 of the corpus\r", "", "É" * 20]
    return [(i, "\n".join(r.choice(lines) if r.random() < 0.6 else f"own line {r.random()} of document {i}" for _ in range(r.randint(0, 9)))) for i in ids]


def brute(rows, held=None):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    owners = defaultdict(set)
    for i, text in held or rows:
        for line in (text or "").split("\n"):
            owners[key(line)].add(i)
    top = {k: max((x for x in v if x is not None), default=None) for k, v in owners.items() if len(k) >= 20 and len(v) >= 3}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in top or (top[key(line)] == i and i is not None)]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)


def by(r):
    return r[0] is not None, r[0] or 0, r[1:]


def rows():
    out = texts(1, range(60)) + [(None, "Shared line number 1 of the corpus\nx"), (None, None), (70, None), (71, ""), (72, "\n\n"), (3, "Shared line number 5 of the corpus"), (3, "Shared line number 5 of the corpus")]
    return out + [(80, "\n".join(["Shared line number 2 of the corpus"] * 50)), (81, "only line of this document, shared by three"), (82, "only line of this document, shared by three"), (83, "ONLY line of this document, shared by three ")]


@pytest.mark.parametrize("limit", [L.FILTER_BYTES, 0])
def test_line_dedup_equals_plain_counts(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "FILTER_BYTES", limit)
    docs = spark.createDataFrame(rows(), SCHEMA).withColumn("row", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    index = L.insert(L.empty_index(spark, shards=4), docs)
    found = L.drop_repeated_lines(docs, index).collect()
    assert sorted(map(tuple, found), key=by) == sorted(brute(rows()), key=by)
    short = L.drop_repeated_lines(docs, index, with_text=False)
    assert sorted(map(tuple, short.collect()), key=by) == sorted((r[:4] for r in brute(rows())), key=by)


def contents(index):
    keys = np.array([r.k1 for r in index.counts.where(F.col("n_docs") >= index.need).collect()], np.int64)
    shards = {r.shard: r for r in index.filters.collect()}
    for r in index.counts.where(F.col("n_docs") >= index.need).collect():
        f = shards[r.k2 % len(shards)]
        assert CuckooFilter(len(f.table) // 8, f.table, f.full).holds(np.array([r.k1]).view(np.uint64)).all()
    assert sum(r.n_keys for r in shards.values()) == len(keys)
    assert sum(int((np.frombuffer(r.table, np.uint16) > 0).sum()) for r in shards.values()) == len(keys)
    return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.refs.collect()), key=str)


def test_insertions_and_deletions_equal_a_new_index(spark):
    first, second = texts(2, range(0, 40)), texts(3, range(40, 90))
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (first, second))
    one = L.insert(L.empty_index(spark, shards=4), a)
    both = L.insert(one, b)
    whole = L.insert(L.empty_index(spark, shards=4), a.unionByName(b))
    assert contents(both) == contents(whole)
    back = L.delete(both, b.select("doc_id"))
    assert contents(back) == contents(one)
    some = L.delete(both, spark.createDataFrame([(i,) for i in (1, 5, 44, 89, 1000)], "doc_id long"))
    left = [r for r in first + second if r[0] not in (1, 5, 44, 89)]
    assert contents(some) == contents(L.insert(L.empty_index(spark, shards=4), spark.createDataFrame(left, SCHEMA)))
    found = L.drop_repeated_lines(a, some).collect()
    assert sorted(map(tuple, found), key=by) == sorted(brute(first, left), key=by)
    again = L.insert(both, a)
    assert contents(again) == contents(both)


def test_line_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    index = L.insert(L.empty_index(spark), docs)
    assert L.drop_repeated_lines(docs, index).count() == 0 and L.delete(index, docs.select("doc_id")).counts.count() == 0


def test_filter_grows_with_its_keys_and_a_full_one_says_yes(monkeypatch):
    r = np.random.default_rng(1)
    for n in (0, 1, 40, 3000):
        keys = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        made = CuckooFilter.of(keys)
        assert not made.full and made.holds(keys).all()
        made.remove(keys[::2])
        assert made.holds(keys[1::2]).all() and (made.table > 0).sum() == len(keys[1::2])
    small = CuckooFilter(2)
    small.add(r.integers(0, 1 << 64, 100, dtype=np.uint64))
    assert small.full and 5 in small
