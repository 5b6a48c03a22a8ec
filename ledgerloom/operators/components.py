"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.scratch import materialise


#: A node counts as a hub when it ends more than this share of all edges, so at most 2 / HUB_SHARE nodes are hubs.
HUB_SHARE = 1 / 1000
FEW_EDGES = 1_000_000


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Joins ``rows`` to their node's smallest neighbour. The few hubs are broadcast, so their rows stay where they are;
    of few edges no node has too many for one task."""
    if edges <= FEW_EDGES:
        return rows.join(least.select("u", "m"), "u")
    floor = max(1000, int(edges * HUB_SHARE))
    known = rows.join(F.broadcast(least.where(F.col("degree") > floor).select("u", F.col("m").alias("m_hub"))), "u", "left")
    other = least.where(F.col("degree") <= floor).select("u", F.col("m").alias("m_other"))
    hubs = known.where("m_hub is not null").select("u", "v", F.col("m_hub").alias("m"))
    return hubs.unionByName(known.where("m_hub is null").join(other, "u").select("u", "v", F.col("m_other").alias("m")))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Connects every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return _with_least(both.where(F.col("v") > F.col("u")), least, count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Connects a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    turned = _with_least(down, least, count).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an edge; the component is named by its smallest node.

    Alternates large-star and small-star steps until the edges form stars. Every round is a few joins and aggregations
    over the edges alone and ends in a shared table. Loops, repeated and reversed edges are allowed; edges with a null
    end are left out; no edges give no rows.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    nodes = edges.select(F.col(left).alias("node")).unionByName(edges.select(F.col(right).alias("node"))).where("node is not null").distinct()
    now, before = materialise(now.where("u != v").distinct(), "edges"), None
    for _ in range(max_rounds):
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before, now = after, materialise(_small_star(_large_star(now, after[0]), after[0]), "edges")
    else:
        raise RuntimeError("components have not settled")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
