"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down already: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u")
    return down.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, m): the least node m of the component of each node u of edges(u, v) that is not its component's least.

    Each round is two aggregations and joins over distinct edges, written to the shared folder; the rounds grow with the
    logarithm of the nodes. No component is gathered in one place.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(down, f"{name}-0")
    mark = None
    for k in itertools.count(1):
        now = materialize(_small_star(_large_star(now).filter("u <> v").distinct()).filter("u <> v").distinct(), f"{name}-{k}")
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        if (seen[0], seen[1]) == mark and seen[0] == seen[2]:
            return now.select("u", F.col("v").alias("m"))
        mark = (seen[0], seen[1])
    raise AssertionError
