"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step is one grouped minimum and one
join over edges, and the number of steps grows with the logarithm of the longest path. Each round is written to the
shared folder, so lineage stays short and an executor may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.shared import stored


def _large(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 50) -> DataFrame:
    """(node, component): the component of every node of an edge, named by its smallest node.

    Direction, repeated edges and edges with a null end play no part; a node linked only to itself is a component.
    An empty table gives no rows. Nodes must be of one orderable type.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = e.where("u = v").select("u").distinct()
    links = stored(e.where("u <> v").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        links = stored(_small(_large(links)), "links")
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
    else:
        raise RuntimeError("components did not settle")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found.select("node"), "node", "left_anti")
    return found.union(alone)
