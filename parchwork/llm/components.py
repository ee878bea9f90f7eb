"""Connected components by rounds of contraction.

In each round every node moves to the least of itself and its neighbours, the
order of nodes being another each time, and edges follow their ends; a graph
shrinks by a constant factor a round, a star vanishes in one or two. Each
round's moves are written to a table; at the end nodes are sent through them.
A node with any number of neighbours costs one partial aggregation and joins
that adaptive execution can split; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.scratch import discard, stash


def _moved(edges: DataFrame, moves: DataFrame, end: str) -> DataFrame:
    """edges with column ``end`` sent through moves."""
    to = moves.select(F.col("node").alias(end), F.col("to").alias("_to"))
    return edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of edges (a, b: long).

    Loops and repeated edges do no harm; edges with a null end are left out.
    Nodes without an edge to another node don't appear. An empty table gives an
    empty result.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    first = current = stash(edges, "edges")
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        # Node numbers under an exclusive or: an order of nodes that is new each round, and from which nodes can be read back.
        salt = F.lit(0 if not rounds else (0x9E3779B97F4A7C15 * len(rounds)) % (1 << 63)).cast("long")
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.col("b").bitwiseXOR(salt)).alias("least"))
        moves = stash(
            least.where(F.col("least") < F.col("node").bitwiseXOR(salt)).select("node", F.col("least").bitwiseXOR(salt).alias("to")), "moves"
        )
        rounds.append(moves)
        moved = _moved(_moved(current, moves, "a"), moves, "b")
        following = stash(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
        )
        if current is not first:
            discard(current)
        current = following
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().withColumn("root", F.col("node"))
    for moves in rounds:
        nodes = _moved(nodes, moves, "root")
    nodes = stash(nodes, "roots")
    least = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(stash(least, "least"), "root").select("node", "component")
