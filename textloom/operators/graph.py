"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.scratch import discard, materialize, new_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node among itself and its neighbours."""
    near = edges.select(F.inline(_both_ways())).groupBy("x").agg(F.min("y").alias("y"))
    least = near.select(F.col("x").alias("u"), F.least("x", "y").alias("to"))
    return edges.join(least, "u").select("v", F.col("to").alias("u")).distinct()


def _both_ways() -> Column:
    return F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("v").agg(F.min("u").alias("to"))
    others = edges.join(least, "v").filter("u <> to").select(F.col("u").alias("v"), F.col("to").alias("u"))
    return others.unionByName(least.select("v", F.col("to").alias("u"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b of one ordered type); label is the component's smallest node.

    Large-star and small-star steps alternate until every component is a star around its smallest node. Distances halve
    with every round, so rounds grow with the logarithm of a path's length. Edges never become more; a hub costs one row
    an edge, and its smallest neighbour comes from combined minima. Each round's edges are written and the last round's
    deleted. Self-loops are allowed; rows with a null end are left out; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    first = materialize(ends.distinct())
    stars, path, state = first.filter("v <> u"), None, None
    while True:
        now = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state, last, path = now, path, new_path(spark)
        stars = materialize(_small_star(_large_star(stars)), path)
        if last:
            discard(spark, last)
    # a node of no edge but a loop to itself isn't in the stars
    nodes = first.select(F.explode(F.array("v", "u")).alias("node")).distinct()
    return nodes.join(stars.select(F.col("v").alias("node"), F.col("u").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def min_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for ``nodes`` with and without edges (a, b)."""
    found = connected_components(edges)
    return nodes.distinct().join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
