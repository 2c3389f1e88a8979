"""Connected components of an edge list by alternating star contractions.

Large-star links every larger neighbour of a node to the node's least neighbour; small-star
links a node's smaller neighbours and itself to the least of them. Alternated until the edges
are stars (a further round would change nothing), every node is left with one edge to the least node of its component. Each
rewrite is a grouped minimum (partial aggregation on the map side) and a join on the same key.
A hub's rows are spread by the join's skew handling; no group is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut, release, sized


def large_star(edges: DataFrame) -> DataFrame:
    """(v, m) for each larger neighbour v of a node, m the least of the node and its neighbours.
    Every edge gives one row, so nothing needs to be made distinct here."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """(v, m) for each smaller neighbour v of a node and the node itself, m the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lower = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select("u", F.col("m").alias("v"))).distinct()


def unfinished(edges: DataFrame) -> bool:
    """Whether some node has two edges up, or one up and one down: then it is no set of stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def packed(uuid: Column) -> Column:
    """A canonical UUID as its 16 bytes, which order like the text."""
    return F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))


def unpacked(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def components(edges: DataFrame, a: str, b: str, uuids: bool = False) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node.

    Self-links and repeated or reversed edges are ignored, null ends dropped; an empty edge
    list gives no rows. Nodes keep their type (any orderable one); uuids: they are canonical
    UUID strings, carried as 16 bytes in between."""
    put, get = (packed, unpacked) if uuids else (lambda c: c, lambda c: c)
    now = edges.select(put(F.col(a)).alias("x"), put(F.col(b)).alias("y")).filter("x is not null and y is not null and x != y")
    now = cut(now.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    with sized(now.sparkSession, 2 * now.count()):
        while unfinished(now):
            before, now = now, cut(small_star(large_star(now)))
            release(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    every = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return every.select(get(F.col("node")).alias("node"), get(F.col("component")).alias("component"))
