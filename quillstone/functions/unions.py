"""Unions that later grouping can rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

#: Spark 4.1 can take the partitioning of a union from its children even when adaptive execution then coalesces
#: them differently, so that groups over the union come apart.  The setting is switched off for the session.
SETTING = "spark.sql.unionOutputPartitioning"


def union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, by name."""
    first.sparkSession.conf.set(SETTING, "false")
    return reduce(DataFrame.unionByName, rest, first)
