"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
    return bad.isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the smallest node
    reachable. Each round joins the edges with the smallest neighbour of each node; no
    list of neighbours is built, so a node may have any number of them. The number of
    rounds grows with the logarithm of the longest path; every round is written to the
    shared folder."""
    e = staged(edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_forest(e):
        # large star: the larger neighbours of a node go to its smallest
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")).withColumnRenamed("a", "u")
        e1 = (both.filter("b > a").join(low, F.col("a") == F.col("u"))
              .select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = e1.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u")
        e2 = (e1.join(low, F.col("a") == F.col("u")).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
              .unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b"))))
        e = staged(e2.distinct(), "edges")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
