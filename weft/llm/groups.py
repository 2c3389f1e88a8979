"""Problem 5: pairwise matches consolidated into groups.

Accepted match rows become undirected edges between canonical ids; alternating large-star and
small-star rewrites (weft.plans.stars) leave every record with the least id of its component.

Defined results: rows with a null, blank or unreadable id on either side, a record matched with
itself, or a confidence that is null or below the threshold make no link; pairs logged
more than once or in both directions are one link; ids are compared in canonical form; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.keys import entity_key, sql_uuid
from weft.plans.stars import components
from weft.session import cut, table

THRESHOLD = 0.78


def match_links(log: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): distinct links with a < b."""
    ends = log.filter(F.col("confidence") >= threshold).filter(~F.isnan("confidence"))
    ends = ends.select(entity_key(F.col("source_id")).alias("x"), entity_key(F.col("target_id")).alias("y"))
    return ends.filter("x is not null and y is not null and x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def match_groups(log: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity_id, group_id) for each record that has a link."""
    found = components(match_links(log, threshold), "a", "b", uuids=True)
    return found.select(F.col("node").alias("entity_id"), F.col("component").alias("group_id"))


def group_sizes(log: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(group_id, members, links): the size of each group and its number of distinct links."""
    links = cut(match_links(log, threshold))
    found = components(links, "a", "b", uuids=True)
    groups = cut(found.select(F.col("node").alias("entity_id"), F.col("component").alias("group_id")))
    of = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    per = links.join(groups, links.a == groups.entity_id).groupBy("group_id").agg(F.count("*").alias("links"))
    return of.join(per, "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return match_groups(table(spark, d, "resolution_log"))


def p5_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return group_sizes(table(spark, d, "resolution_log"))


QUERIES = {"p5_found": p5_found, "p5_group_sizes": p5_group_sizes}
_GROUPS = f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (
    SELECT {sql_uuid('source_id')} AS x, {sql_uuid('target_id')} AS y FROM resolution_log WHERE confidence >= {THRESHOLD})
  WHERE x <> y),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS n, a AS r FROM sym UNION SELECT e.b, r.r FROM reach r JOIN sym e ON e.a = r.n),
grp AS (SELECT n AS entity_id, min(r) AS group_id FROM reach GROUP BY 1)
"""
ORACLES = {
    "p5_found": _GROUPS + "SELECT entity_id, group_id FROM grp",
    "p5_group_sizes": _GROUPS + """SELECT g.group_id, count(*) AS members, min(l.n) AS links FROM grp g JOIN (
      SELECT group_id, count(*) AS n FROM links JOIN grp ON a = entity_id GROUP BY 1) l ON l.group_id = g.group_id GROUP BY 1""",
}
