"""Bounded traversal with paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.session import cut


class StartNotFound(ValueError):
    """The start is missing or archived."""


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, dir, edge) for one hop; dir 0 out, 1 in."""
    edge = F.struct("source_id", "target_id", "relationship_type").alias("edge")
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.lit(0).alias("dir"), edge)
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), F.lit(1).alias("dir"), edge)
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def traverse(entities: DataFrame, edges: DataFrame, start: str, direction: str = "outgoing", depth: int = 3, limit: int | None = 100, kind: str | None = None, entity_type: str | None = None, until: str | None = None) -> DataFrame:
    """(entity_id, depth, path, edges) of the active entities within `depth` hops.

    A breadth-first loop of joins, one per level: inactive nodes and other relationship types are
    left out while it expands, other entity types only afterwards; it ends early when nothing new or `until` is found; of equal ways the outgoing one,
    then the least parent holds. The visited set is an anti-join, never a driver-side list."""
    active = entities.filter("is_active").select("id", "entity_type")
    if active.filter(F.col("id") == start).isEmpty():
        raise StartNotFound(start)
    hop = steps(edges.filter(F.col("relationship_type") == kind) if kind else edges, direction).join(active.select(F.col("id").alias("to")), "to", "left_semi")
    none = F.array().cast("array<struct<source_id:string,target_id:string,relationship_type:string>>")
    seen = cut(active.filter(F.col("id") == start).select(F.col("id").alias("entity_id"), F.lit(0).alias("depth"), F.array("id").alias("path"), none.alias("edges")))
    front = seen
    for level in range(1, depth + 1):
        way = F.min(F.struct("dir", F.col("entity_id"), "edge", "path", "edges")).alias("w")
        grown = front.join(hop, front.entity_id == hop.at).groupBy("to").agg(way)
        new = grown.join(seen.select(F.col("entity_id").alias("to")), "to", "left_anti")
        front = cut(new.select(F.col("to").alias("entity_id"), F.lit(level).alias("depth"), F.array_append("w.path", F.col("to")).alias("path"), F.array_append("w.edges", F.col("w.edge")).alias("edges")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if until is not None and not front.filter(F.col("entity_id") == until).isEmpty():
            break
    found = seen.filter("depth > 0")
    if entity_type:
        found = found.join(active.filter(F.lower("entity_type") == entity_type.lower()).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return found.orderBy("depth", "entity_id").limit(limit) if limit else found


def shortest_path(edges: DataFrame, a: str, b: str) -> list[str] | None:
    """One undirected shortest path of any length, least in order of ids; None if there is none."""
    if a == b:
        return [a]
    nodes = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct().withColumn("is_active", F.lit(True)).withColumn("entity_type", F.lit(""))
    if nodes.filter(F.col("id").isin(a, b)).count() < 2:
        return None
    row = traverse(nodes, edges, a, "both", 1 << 30, None, until=b).filter(F.col("entity_id") == b).select("path").first()
    return row["path"] if row else None


def service_paths(entities: DataFrame, edges: DataFrame, start: str, depth: int = 3, limit: int = 100) -> DataFrame:
    """The paths to what is reached both ways, at most `limit`."""
    return traverse(entities, edges, start, "both", depth, limit).select("path")


def graph_from(entities: DataFrame, edges: DataFrame, start: str, depth: int = 3, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a start."""
    t = traverse(entities, edges, start, "both", depth, limit)
    nodes = t.select(F.explode("path").alias("id")).distinct()
    return nodes, t.select(F.explode("edges").alias("e")).select("e.*").distinct()


def by_depth(found: DataFrame) -> DataFrame:
    """A08."""
    return found.groupBy("depth").agg(F.count("*").alias("n"))


def recursive_sql(view: str, start: str, depth: int) -> str:
    """The same outgoing traversal as a recursive CTE over a view (at, to)."""
    return f"""WITH RECURSIVE walk(id, depth) AS (SELECT '{start}', 0 UNION ALL SELECT e.to, w.depth + 1 FROM walk w JOIN {view} e ON e.at = w.id WHERE w.depth < {depth})
    SELECT id, min(depth) AS depth FROM walk GROUP BY id"""


def shallowest(rows: DataFrame) -> DataFrame:
    """The shallowest row of each id, the shorter path of equals."""
    w = W.partitionBy("id").orderBy("depth", F.size("path"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
