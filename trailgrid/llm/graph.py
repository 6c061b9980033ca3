"""Distributed connected components by alternating large and small stars.

Every round is two aggregations (combined before the shuffle) and two joins whose hot side, the edges of a
hub, adaptive execution splits where it is large; its edges are written to the shared folder. Nothing is
gathered on the driver but one count. Plans are kept small: there are many rounds, and the driver holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    """Of each u its least neighbour or itself."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, root): the least node of its component, for each node with an edge to another, of the type of a; null ends ignored."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    now = scratch.keep(pairs.distinct(), f"{name}0")
    mark, round_no = None, 0
    while True:
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark, round_no = (seen["n"], seen["h"]), round_no + 1
        later = scratch.keep(_small(_large(now)), f"{name}{round_no}")
        scratch.drop(f"{name}{round_no - 1}")
        now = later
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
