"""A trie of conversations by their turns, as a table of nodes under minimal perfect hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, materialise
from .ranges import running, sha256_of_lists
from .slot_table import SlotTable

#: Nodes of a shard, and members' turns below a node up to which its subtree lies in one shard.
SHARD_NODES, SUBTREE_TURNS = 500_000, 100_000
#: A digest of a prefix is four sums of numbers of so many bits, one of each turn.
LANES, BITS = 4, 31
KEY = ["k1", "k2", "depth"]
WORD = r"[^\x20\x09-\x0D]+"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words): a null role or text is empty. Rows without a conversation are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share openings: (conv_id, depth from 1, digest, words, size), and a row of depth 0 for each.

    Conversation c takes its first h = crc32(c) mod ``most`` turns from conversation c - c mod ``family``, as far as it has
    them, and the rest from its own. Turns go by turn, null first; those of one turn by digest; equal ones all stay.
    """
    given = turn_digests(conversations).withColumn("row", F.monotonically_increasing_id())
    turns = running(given, "conv_id", ["turn", "digest", "row"], [], "trie-turns").select("conv_id", "digest", "words", "place")
    heads = F.crc32(F.col("conv_id").cast("string")) % most
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = materialise(convs.withColumn("size", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), "trie-convs")
    own = lookup_join(turns, convs.select("conv_id", "n", "h", "head", "size"), "conv_id", "n").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "digest", "words", "size")
    shared = convs.where("head > 0").select("conv_id", "base", "size", F.explode(F.sequence(F.lit(1).cast("long"), "head")).alias("depth"))
    first = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "words")
    shared = shared.join(first, ["base", "depth"]).select("conv_id", "depth", "digest", "words", "size")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"), "size")
    return own.unionByName(shared).unionByName(roots)


def _members(turns: DataFrame) -> DataFrame:
    """Each prefix of each conversation with its digest (k1, k2), its parent's (p1, p2) and a mark of its last turn."""
    digest = F.sha2(F.concat("digest", F.lit(":"), F.col("depth").cast("string")), 256)
    lane = lambda i: F.when(F.col("depth") == 0, 0).otherwise(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").bitwiseAND((1 << BITS) - 1)).cast("long")
    lanes = [f"a{i}" for i in range(LANES)]
    rows = materialise(turns.select("conv_id", "depth", "words", "size", F.xxhash64("digest").alias("mark"), *[lane(i).alias(c) for i, c in enumerate(lanes)]), "trie-lanes")
    summed = running(rows, "conv_id", ["depth"], lanes, "trie-members")

    def key(left: Column, right: Column) -> Column:
        low = lambda x: x.bitwiseAND((1 << BITS) - 1)
        return F.shiftleft(low(left), BITS).bitwiseOR(low(right))

    run = [F.col(f"run_{c}") for c in lanes]
    before = [r - F.col(c) for r, c in zip(run, lanes)]
    return summed.select("conv_id", "depth", "words", "size", "mark", key(*run[:2]).alias("k1"), key(*run[2:]).alias("k2"), key(*before[:2]).alias("p1"), key(*before[2:]).alias("p2"))


def _one(column: str) -> Column:
    """The one value of a group; members of one node that differ would be two prefixes with one digest."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))


def _shard(nodes: pd.DataFrame) -> pd.DataFrame:
    """Numbers the nodes of whole subtrees and sums up from the deepest to the tops."""
    get = lambda c: nodes[c].to_numpy(np.int64)
    k1, k2, depth = get("k1"), get("k2"), get("depth")
    table = SlotTable(k1, k2, depth)
    if (table.find(k1, k2, depth) != table.slot).any():
        raise ValueError("two nodes have one digest")
    size, slot = len(nodes), table.slot
    put = lambda values: (out := np.empty(size, np.int64), out.__setitem__(slot, values))[0]
    parent, level, conv = put(table.find(get("p1"), get("p2"), depth - 1)), put(depth), put(get("conv_id"))
    saved, children = put((get("n_convs") - 1) * get("words")), np.zeros(size, np.int64)
    below = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[below], 1)
    leaves = (children == 0).astype(np.int64)
    below = below[np.argsort(-level[below], kind="stable")]
    for same in np.split(below, np.flatnonzero(np.diff(level[below])) + 1) if len(below) else ():
        np.add.at(saved, parent[same], saved[same])
        np.add.at(leaves, parent[same], leaves[same])
    out = nodes[["k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs"]].copy()
    up = parent[slot]
    out["parent_conv_id"] = pd.array(np.where(up >= 0, conv[up], 0), "Int64")
    out.loc[up < 0, "parent_conv_id"] = pd.NA
    out["n_children"], out["n_leaves"], out["saved_tokens"], out["top"] = children[slot], leaves[slot], saved[slot], up < 0
    return out


_OUT = "k1 long, k2 long, depth long, p1 long, p2 long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


def prefix_trie(turns: DataFrame, subtree_turns: int = SUBTREE_TURNS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of conversations given as (conv_id, depth, digest, words, size) with a row of depth 0 each.

    Returns k1, k2 and depth (a node's digest), conv_id (smallest member), n_convs, parent_conv_id, n_children, n_leaves,
    saved_tokens and ends_sha256. No conversations give no nodes; a conversation of no turns is a member of the root.

    A subtree with few turns below its top lies in one shard, which numbers its nodes by a minimal perfect hash and sums up
    counts in arrays along parents' slots. Above these subtrees a node adds what each of its members brings: a
    conversation brings the tops of which it is the smallest member, so each counts once.
    """
    members = _members(turns)
    nodes = materialise(
        members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), _one("words").alias("words"), _one("p1").alias("p1"), _one("p2").alias("p2"), _one("mark").alias("mark"), F.sum(F.col("size") - F.col("depth")).alias("weight")).drop("mark"),
        "trie-nodes",
    )
    light = (F.col("weight") <= subtree_turns).alias("light")
    found = materialise(
        lookup_join(members.select("conv_id", *KEY), nodes.select(*KEY, "owner", "n_convs", "words", "p1", "p2", light), KEY, "n_convs").withColumn("own", F.col("conv_id") == F.col("owner")).drop("owner"), "trie-found"
    )
    roots = found.where("light").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("root"), F.sum(F.col("own").cast("long")).alias("n")).where("n > 0")
    shards = max(1, -(-nodes.count() // shard_nodes))
    placed = lookup_join(found.where("light and own"), materialise(roots, "trie-roots"), "conv_id", "n")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(shards)).cast("int")).select("shard", *KEY, "p1", "p2", "conv_id", "n_convs", "words")
    low = materialise(placed.groupBy("shard").applyInPandas(_shard, _OUT), "trie-shards")
    high = found.where("not light")
    # From below: what each conversation brings to its prefixes above the shards, summed up from the deepest.
    brought = high.select("conv_id", *KEY, F.when(F.col("own"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"), F.lit(True).alias("high"))
    tops = low.where("top")
    brought = brought.unionByName(tops.select("conv_id", *KEY, F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"), F.lit(False).alias("high")))
    brought = running(materialise(brought.withColumn("up", -F.col("depth")), "trie-brought"), "conv_id", ["up"], ["saved", "leaves"], "trie-sums")
    sums = brought.where("high").groupBy(*KEY).agg(F.sum("run_saved").alias("saved_tokens"), F.sum("run_leaves").alias("n_leaves"))
    heavy = high.where("own").select(*KEY, "p1", "p2", "conv_id", "n_convs").join(sums, KEY)
    above = heavy.select("p1", "p2", "depth").unionByName(tops.select("p1", "p2", "depth")).groupBy("p1", "p2", (F.col("depth") - 1).alias("depth")).count()
    above = above.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "depth", F.col("count").alias("n_children"))
    heavy = materialise(heavy.join(above, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-heavy")
    names = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parents = heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    upper = tops.drop("parent_conv_id", "top").unionByName(heavy).withColumn("parent_depth", F.col("depth") - 1)
    upper = lookup_join(upper, parents, ["p1", "p2", "parent_depth"], "n_rows", "left")
    every = low.where("not top").select(*names).unionByName(upper.select(*names))
    ends = sha256_of_lists(members.where("depth = size"), KEY, "conv_id", "trie-ends")
    return every.join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, count(*) as n, conv_id - conv_id % 20 as base,
         xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
                         lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4 as h
  from t group by conv_id),
h as (
  select c.*, least(c.h, coalesce(b.n, 0)) as head from c left join c b on c.base = b.conv_id),
r as (
  select h.conv_id, t.pos as depth, t.role, t.text from h join t on t.conv_id = h.base and t.pos <= h.head
  union all
  select h.conv_id, t.pos - h.h + h.head, t.role, t.text from h join t on t.conv_id = h.conv_id and t.pos > h.h),
z as (
  select conv_id, 0 as depth, '' as node, 0 as words, null as parent from h
  union all
  select conv_id, depth, node, words, coalesce(lag(node) over (partition by conv_id order by depth), '') as parent
  from (select conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
               string_agg(sha256(length(role) || ':' || role || text), ',') over (partition by conv_id order by depth) as node from r)),
l as (
  select conv_id, max(depth) as size from z group by conv_id),
m as (
  select z.*, z.depth = l.size as ended from z join l using (conv_id)),
n as (
  select node, any_value(depth) as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended), '')) as ends_sha256
  from m group by node),
k as (
  select parent, count(*) as n_children from n where depth > 0 group by parent),
v as (
  select n.*, coalesce(k.n_children, 0) as n_children, (n.n_convs - 1) * n.words as own, (k.n_children is null)::bigint as leaf
  from n left join k on k.parent = n.node),
s as (
  select m.node, sum(v.own)::bigint as saved_tokens, sum(v.leaf)::bigint as n_leaves
  from v join m on m.conv_id = v.conv_id and m.depth <= v.depth group by m.node)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
from v join s using (node) left join v p on v.depth > 0 and p.node = v.parent
"""
