"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.plans.materialize import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Each round joins the edges with one row for each node, so a node with very many links is an ordinary
    skewed join; rounds grow with the logarithm of the nodes. Self links and repeated links do no harm.
    """
    cur = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialize(cur, f"{tag}-edges")
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{tag}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        cur = materialize(small, f"{tag}-small")
        last, state = state, _state(cur)
        if state == last:
            break
    return materialize(cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component"), tag)
