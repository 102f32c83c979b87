"""Connected components by alternating stars; no step needs more than a node's smallest neighbour.

Each round joins every edge with its node's smallest neighbour. Where there are few edges, that table is broadcast and equal
edges stay, so a round takes two shuffles; else equal edges become one, and hubs are joined apart, so that no task gets a
hub's whole neighbourhood. Rounds end as soon as every node is a root or has its root as its only neighbour. The rounds needed
grow with the logarithm of the longest path, so MOST_ROUNDS is out of reach; it turns a fault into an error instead of an
endless loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import BROADCAST_BYTES, few_files, join_one, scratch

MOST_ROUNDS = 60
#: Of a node, its smallest neighbour and its degree.
NODE_BYTES = 64


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any ordered type. (id, root): the smallest id that each linked id reaches; roots themselves are left out."""
    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    most = 2 * edges.count()  # no round has more edges, which have at most twice as many nodes
    few = most * NODE_BYTES <= BROADCAST_BYTES

    def met(edges: DataFrame, least: DataFrame) -> DataFrame:
        return edges.join(F.broadcast(least), "a") if few else join_one(edges, least, "a", "degree", NODE_BYTES)

    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("b").alias("most"), F.count("*").alias("degree"))
        least = scratch(few_files(least, most), "least")
        if not least.where("m < a and m < most").count():  # nodes with a smaller neighbour and another one
            return least.where("m < a").select(F.col("a").alias("id"), F.col("m").alias("root"))
        # large star: each node's larger neighbours go to its smallest neighbour
        large = met(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch(few_files(large if few else large.distinct(), most), "large-star")
        # small star: each node and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = met(large, least if few else scratch(few_files(least, most), "least")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = scratch(few_files(small if few else small.distinct(), most), "small-star")
    raise RuntimeError("components did not settle")
