"""The canonical tables of a data directory as one set of DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema as S
from weft.functions.keys import NIL, entity_key, sql_uuid
from weft.operators.orphans import current_entities
from weft.operators.search import index, search_docs
from weft.operators.wide import wide_table
from weft.session import kept, table


class Model:
    """entities, flat (an entity with its wide attributes), edges, members and the rest.

    These are derived tables: the first query of a session that needs one writes it, the others read
    only the columns and row groups they ask for (sorted by what is mostly filtered on)."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, directory

    def _kept(self, name: str, make) -> DataFrame:
        return kept(self.spark, self.dir, name, make)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def entities(self) -> DataFrame:
        """The row that holds of each id, archived ones too."""
        e = current_entities(self.raw("entities"))
        named = e.select("id", S.canonical(F.col("entity_type"), S.KNOWN_TYPES).alias("entity_type"), "is_active", "created_at", "updated_at", "version")
        return self._kept("entities", lambda: named.sortWithinPartitions("id"))

    @cached_property
    def active(self) -> DataFrame:
        return self.entities.filter("is_active")

    @cached_property
    def components(self) -> DataFrame:
        c = self.raw("components").select("id", entity_key(F.col("entity_id")).alias("entity_id"), S.canonical(F.col("component_type"), S.COMPONENT_TYPES).alias("component_type"), "data", "created_at", "version")
        return c.filter("entity_id is not null").distinct()

    @cached_property
    def flat(self) -> DataFrame:
        """Active entities with title (Untitled for none), content, tags and the other attributes."""

        def make() -> DataFrame:
            w = wide_table(self.raw("components"), self.raw("component_catalog"))
            joined = self.active.join(w, self.active.id == w.entity_id, "left").drop("entity_id")
            named = joined.withColumn("title", F.coalesce("title", F.lit(S.UNTITLED))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
            return named.sortWithinPartitions("entity_type", "id")

        return self._kept("flat", make)

    @cached_property
    def edges(self) -> DataFrame:
        """Active relationships between UUIDs, one row per id."""
        r = self.raw("relationships").filter("is_active")
        r = r.select("id", entity_key(F.col("source_id")).alias("source_id"), entity_key(F.col("target_id")).alias("target_id"), S.canonical(F.col("relationship_type"), S.RELATIONSHIP_TYPES).alias("relationship_type"), "created_at")
        return self._kept("edges", lambda: r.filter("source_id is not null and target_id is not null").distinct().sortWithinPartitions("relationship_type", "source_id"))

    @cached_property
    def postings(self) -> DataFrame:
        """The keyword index, in ranges of terms, so that a query reads only those of its terms."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._kept("postings", lambda: index(search_docs(self.flat))[0].repartitionByRange(n, "term", "entity_id").sortWithinPartitions("term", "entity_id"))

    @cached_property
    def lengths(self) -> DataFrame:
        return self._kept("lengths", lambda: index(search_docs(self.flat))[1])

    @cached_property
    def members(self) -> DataFrame:
        """(collection_id, entity_id, added_at) as documents were filed."""
        d = self.raw("documents").select(entity_key(F.col("collection_id")).alias("collection_id"), entity_key(F.col("entity_id")).alias("entity_id"), "created_at")
        return self._kept("members", lambda: d.filter("collection_id is not null and entity_id is not null").groupBy("collection_id", "entity_id").agg(F.min("created_at").alias("added_at")))


def prelude(wide_sql: str) -> str:
    """The same tables as CTEs of DuckDB's SQL: ent, comp, flat, edge and member."""
    return f"""
WITH RECURSIVE ent AS (
  SELECT id, {S.sql_canonical('entity_type', S.KNOWN_TYPES)} AS entity_type, is_active, created_at, updated_at, version
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC) AS rn FROM entities) WHERE rn = 1),
act AS (SELECT * FROM ent WHERE is_active),
comp AS (SELECT DISTINCT id, {sql_uuid('entity_id')} AS entity_id, {S.sql_canonical('component_type', S.COMPONENT_TYPES)} AS component_type, data, created_at, version
  FROM components WHERE {sql_uuid('entity_id')} <> '{NIL}'),
wide AS ({wide_sql}),
flat AS (SELECT e.*, coalesce(w.title, 'Untitled') AS title, w.description, w.content, w.summary, w.author, w.lang_code, coalesce(w.tags, CAST([] AS VARCHAR[])) AS tags,
  w.happened_at, w.size_bytes, w.source_path, w.message_text FROM act e LEFT JOIN wide w ON w.entity_id = e.id),
edge AS (SELECT DISTINCT id, {sql_uuid('source_id')} AS source_id, {sql_uuid('target_id')} AS target_id, {S.sql_canonical('relationship_type', S.RELATIONSHIP_TYPES)} AS relationship_type, created_at
  FROM relationships WHERE is_active AND {sql_uuid('source_id')} <> '{NIL}' AND {sql_uuid('target_id')} <> '{NIL}'),
member AS (SELECT {sql_uuid('collection_id')} AS collection_id, {sql_uuid('entity_id')} AS entity_id, min(created_at) AS added_at FROM documents
  WHERE {sql_uuid('collection_id')} <> '{NIL}' AND {sql_uuid('entity_id')} <> '{NIL}' GROUP BY 1, 2)
"""
