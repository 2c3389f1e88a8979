"""Queries of the general problems (2, 4 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.keys import NIL, enum_key, sql_enum, sql_uuid, uuid_key
from weft.operators import hierarchy as H
from weft.operators import orphans as O
from weft.operators import wide as W
from weft.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return W.unreadable(table(spark, d, "components"), table(spark, d, "component_catalog"), W.month_of(F.col("created_at")))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return W.wide_table(table(spark, d, "components"), table(spark, d, "component_catalog"), W.month_of(F.col("created_at")))


def _referring(spark: SparkSession, d: str) -> dict:
    return {
        "relationships": (table(spark, d, "relationships"), ["source_id", "target_id"]),
        "components": (table(spark, d, "components"), ["entity_id"]),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(_referring(spark, d), table(spark, d, "entities")).select("table_name", "field_name", "record_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_referring(spark, d), table(spark, d, "entities"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relationships").filter("is_active").filter(enum_key(F.col("relationship_type")) == "hasmessage")
    return rows.select(uuid_key(F.col("source_id")).alias("parent"), uuid_key(F.col("target_id")).alias("child"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_links(spark, d), paths=False, uuids=True).select("node_id", "root_id", "depth")


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_links(spark, d), uuids=True)


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.ancestors(_links(spark, d), uuids=True)


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    return H.link_kinds(_links(spark, d), uuids=True)


QUERIES = {f.__name__: f for f in (p2_found, p2_wide, p4_found, p4_report, p7_found, p7_hierarchy, p7_descendants, p7_links)}

_JSON_AT = "json_extract(data, p)"
_TS = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_CELLS = f"""
WITH rows AS (
  SELECT {sql_uuid('entity_id')} AS entity_id, {sql_enum('component_type')} AS ct, id, version, created_at,
         CASE WHEN json_valid(data) THEN data END AS data FROM components),
named AS (
  SELECT r.*, c.component_type, c.column_name, c.column_type, c.json_paths
  FROM rows r JOIN component_catalog c ON r.ct = lower(c.component_type)
  WHERE entity_id IS NOT NULL AND entity_id <> '{NIL}'),
places AS (
  SELECT *, unnest(list_value(json_extract(data, json_paths[1]), CASE WHEN len(json_paths) > 1 THEN json_extract(data, json_paths[2]) END)) AS j,
         unnest(list_value(1, 2)) AS k FROM named),
val AS (
  SELECT *, CASE
    WHEN column_type = 'string' AND json_type(j) = 'VARCHAR' AND regexp_matches(j->>'$', '\\S') THEN j->>'$'
    WHEN column_type = 'array<string>' AND json_type(j) = 'ARRAY' AND json_array_length(j) > 0
         AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN CAST(j AS VARCHAR)
    WHEN column_type = 'bigint' AND json_type(j) IN ('UBIGINT', 'BIGINT') THEN CAST(j AS VARCHAR)
    WHEN column_type = 'bigint' AND json_type(j) = 'VARCHAR' AND regexp_matches(j->>'$', '^[0-9]+$') THEN j->>'$'
    WHEN column_type = 'timestamp' AND json_type(j) = 'VARCHAR' AND regexp_matches(j->>'$', '{_TS}')
         AND TRY_CAST(j->>'$' AS TIMESTAMPTZ) IS NOT NULL THEN j->>'$' END AS value FROM places)
"""
_WIDE_ORACLE = _CELLS + """,
best AS (SELECT entity_id, column_name, arg_max(value, (version, created_at, id, -k)) FILTER (WHERE value IS NOT NULL) AS value FROM val GROUP BY 1, 2)
SELECT entity_id,
  max(value) FILTER (column_name = 'title') AS title, max(value) FILTER (column_name = 'description') AS description,
  max(value) FILTER (column_name = 'content') AS content, max(value) FILTER (column_name = 'summary') AS summary,
  max(value) FILTER (column_name = 'author') AS author, max(value) FILTER (column_name = 'lang_code') AS lang_code,
  CAST(json(max(value) FILTER (column_name = 'tags')) AS VARCHAR[]) AS tags,
  CAST(max(value) FILTER (column_name = 'happened_at') AS TIMESTAMPTZ) AS happened_at,
  CAST(max(value) FILTER (column_name = 'size_bytes') AS BIGINT) AS size_bytes,
  max(value) FILTER (column_name = 'source_path') AS source_path, max(value) FILTER (column_name = 'message_text') AS message_text
FROM best GROUP BY 1
"""
_REFS = f"""
WITH ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC) AS rn FROM entities) WHERE rn = 1),
refs AS (
  SELECT 'relationships' AS table_name, 'source_id' AS field_name, id AS record_id, created_at AS at_, source_id AS value FROM relationships
  UNION ALL SELECT 'relationships', 'target_id', id, created_at, target_id FROM relationships
  UNION ALL SELECT 'components', 'entity_id', id, created_at, entity_id FROM components),
keyed AS (SELECT *, {sql_uuid('value')} AS key FROM refs WHERE value IS NOT NULL AND regexp_matches(value, '\\S')),
bad AS (
  SELECT DISTINCT table_name, field_name, record_id, at_,
    CASE WHEN key IS NULL OR key = '{NIL}' THEN 'no_key' WHEN e.id IS NULL THEN 'missing' WHEN e.created_at > at_ THEN 'later'
         WHEN NOT e.is_active AND e.updated_at < at_ THEN 'deleted' END AS reason
  FROM keyed LEFT JOIN ent e ON e.id = key)
"""
_TREE = f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT {sql_uuid('source_id')} AS parent, {sql_uuid('target_id')} AS child FROM relationships
  WHERE is_active AND {sql_enum('relationship_type')} = 'hasmessage'),
up AS (SELECT child AS node, min(parent) AS parent FROM links WHERE parent IS NOT NULL AND child IS NOT NULL GROUP BY 1),
every AS (SELECT node FROM up UNION SELECT parent FROM up),
tree AS (
  SELECT node, node AS root, 0 AS depth, '/' || node AS path FROM every WHERE node NOT IN (SELECT node FROM up)
  UNION ALL SELECT u.node, t.root, t.depth + 1, t.path || '/' || u.node FROM tree t JOIN up u ON u.parent = t.node)
"""
_RINGS = _TREE + """, lost AS (SELECT node, parent FROM up WHERE node NOT IN (SELECT node FROM tree)),
walk AS (SELECT node AS n, parent AS a FROM lost UNION SELECT w.n, l.parent FROM walk w JOIN lost l ON l.node = w.a),
ring AS (SELECT w.n, min(x.a) AS low FROM walk w JOIN walk x ON x.n = w.n WHERE w.n = w.a GROUP BY 1)
"""
ORACLES = {
    "p2_found": _CELLS + "SELECT entity_id, component_type FROM val GROUP BY 1, 2 HAVING count(value) = 0",
    "p2_wide": _WIDE_ORACLE,
    "p4_found": _REFS + "SELECT DISTINCT table_name, field_name, record_id FROM bad WHERE reason IS NOT NULL",
    "p4_report": _REFS + """SELECT table_name, field_name, strftime(at_ AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans,
      count(*) FILTER (reason = 'no_key') AS no_key, count(*) FILTER (reason = 'missing') AS missing,
      count(*) FILTER (reason = 'later') AS later, count(*) FILTER (reason = 'deleted') AS deleted
      FROM bad WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "p7_found": _TREE + "SELECT e.node AS node_id, coalesce(t.root, 'cycle') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth FROM every e LEFT JOIN tree t USING (node)",
    "p7_hierarchy": _RINGS + """SELECT e.node AS node_id, coalesce(t.root, 'cycle') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, u.parent AS parent_id, t.path,
      CASE WHEN t.node IS NOT NULL THEN (SELECT count(*) FROM tree x WHERE starts_with(x.path, t.path || '/')) END AS descendants,
      r.n IS NOT NULL AS on_cycle, coalesce(r.n = r.low, false) AS back_edge
      FROM every e LEFT JOIN tree t USING (node) LEFT JOIN up u USING (node) LEFT JOIN ring r ON r.n = e.node""",
    "p7_links": _RINGS + """SELECT l.parent AS parent_id, l.child AS node_id,
      CASE WHEN u.parent = l.parent THEN CASE WHEN r.n = r.low THEN 'back' WHEN c.path IS NULL THEN 'cycle' ELSE 'tree' END
           WHEN contains(p.path || '/', '/' || l.child || '/') THEN 'back' ELSE 'cross' END AS kind
      FROM links l JOIN up u ON u.node = l.child LEFT JOIN tree p ON p.node = l.parent LEFT JOIN tree c ON c.node = l.child LEFT JOIN ring r ON r.n = l.child
      WHERE l.parent IS NOT NULL AND l.child IS NOT NULL""",
    "p7_descendants": _TREE + """, lists AS (
      SELECT parent AS ancestor, node AS descendant, 1 AS distance FROM up WHERE node IN (SELECT node FROM tree) UNION ALL
      SELECT u.parent, l.descendant, l.distance + 1 FROM lists l JOIN up u ON u.node = l.ancestor)
    SELECT ancestor, descendant, CAST(distance AS INTEGER) AS distance FROM lists""",
}
