"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.unions import union
from quillstone.llm.workspace import Table, join_keys, write_table


def connected_components(edges: DataFrame) -> Table:
    """(node, root) of every node in ``edges`` (a, b: integers, stored); the root is the component's smallest node.

    A star step links a node's larger (or smaller) neighbours with its smallest one, found by a
    grouped minimum; the smallest ones of nodes with many neighbours are broadcast, so no task holds those neighbours.
    The tables are as large as the edges.
    """
    n = edges.count()  # a step makes at most as many, and one more a node
    current = write_table(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows=n)
    before = None
    while True:
        e = current.df
        both = union(e, e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        upward = F.count_if(F.col("v") > F.col("u")).alias("uses")
        least = write_table(both.groupBy("u").agg(F.min("v").alias("m"), upward).withColumn("m", F.least("u", "m")), "least", rows=2 * n)
        large = join_keys(both.filter("v > u"), least.df, ["u"], "uses", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_table(large.filter("u != v").distinct(), "large-star", rows=n)
        current.drop()
        least.drop()
        e = large.df
        least = write_table(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses")), "least", rows=n)
        joined = join_keys(e, least.df, ["u"], "uses", n)
        small = union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")), least.df.select("u", F.col("m").alias("v")))
        current = write_table(small.filter("u != v").distinct(), "small-star", rows=2 * n)
        large.drop()
        least.drop()
        # Done when every node points at one root and no root points anywhere: the edges no longer change.
        state = current.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            e = current.df
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found = write_table(union(nodes, e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components", rows=2 * n)
            current.drop()
            return found
        before = state
