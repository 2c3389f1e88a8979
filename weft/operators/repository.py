"""Lookups, filters and joins over the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft import schema as S
from weft.plans.model import Model


def get(m: Model, ids: list[str]) -> DataFrame:
    """entities by id in the order asked for, missing ones left out."""
    asked = m.spark.createDataFrame(list(enumerate(ids)), "position int, id string")
    return asked.join(m.entities, "id").orderBy("position").drop("position")


def by_type(m: Model, kind: str) -> DataFrame:
    """active entities of a type, spelled in any case."""
    return m.active.filter(F.lower("entity_type") == kind.lower())


def by_title(m: Model, title: str) -> DataFrame:
    """F04."""
    return m.flat.filter(F.col("title") == title)


def by_component_type(m: Model, kind: str) -> DataFrame:
    """active entities that have a component of the type."""
    return m.active.join(m.components.filter(F.col("component_type") == kind), m.active.id == F.col("entity_id"), "left_semi")


def by_tag(m: Model, tag: str) -> DataFrame:
    """active entities with the tag, without case."""
    return m.flat.filter(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def by_tag_text(m: Model, tag: str) -> DataFrame:
    """F06 as stored: the tag within the text of the Tags payload, `%` and `_` as wildcards."""
    rows = m.components.filter(F.col("component_type") == "Tags").filter(F.col("data").ilike(f'%"{tag}"%'))
    return m.active.join(rows, m.active.id == rows.entity_id, "left_semi")


def versions(m: Model, entity: str | None = None) -> DataFrame:
    """the recorded versions of an entity, newest first; of all entities in no order."""
    rows = m.raw("entities").select("id", "version", "updated_at", "is_active").distinct()
    return rows if entity is None else rows.filter(F.col("id") == entity).orderBy(F.desc("version"), F.desc("updated_at"))


def component_contains(m: Model, kind: str, text: str) -> DataFrame:
    """components of a type whose payload contains a text, without case."""
    return m.components.filter(F.col("component_type") == kind).filter(F.contains(F.lower("data"), F.lit(text.lower())))


def component_path_equals(m: Model, kind: str, path: str, value: str) -> DataFrame:
    """F09 by JSON path."""
    return m.components.filter(F.col("component_type") == kind).filter(F.try_variant_get(F.try_parse_json("data"), path, "string") == value)


def related(m: Model, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Active relationships by either end and type."""
    out = m.edges
    for column, value in (("source_id", source), ("target_id", target), ("relationship_type", kind)):
        out = out.filter(F.col(column) == value) if value else out
    return out


def events(m: Model, user: int | None = None) -> DataFrame:
    """the event log of a user (or all), newest first by ts then id."""
    e = m.raw("events")
    return e.filter(F.col("user_id") == user).orderBy(F.desc("ts"), "event_id") if user is not None else e


def collections(m: Model) -> DataFrame:
    """Collections with title and number of active members."""
    size = m.members.join(m.active.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy("collection_id").agg(F.count("*").alias("members"))
    every = m.members.select("collection_id").distinct().join(size, "collection_id", "left")
    title = m.flat.select(F.col("id").alias("collection_id"), "title")
    return every.join(title, "collection_id", "left").select("collection_id", F.coalesce("title", F.lit(S.UNTITLED)).alias("title"), F.coalesce("members", F.lit(0)).alias("members"))


def collection_members(m: Model) -> DataFrame:
    """(collection_id, entity_id, entity_type) of active members."""
    return m.members.join(m.active.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select("collection_id", "entity_id", "entity_type")


def entity_collections(m: Model) -> DataFrame:
    """F16: each entity's number of collections."""
    return m.members.groupBy("entity_id").agg(F.count_distinct("collection_id").alias("collections"))


def is_member(m: Model, collection: str, entity: str) -> bool:
    """F17."""
    return not m.members.filter((F.col("collection_id") == collection) & (F.col("entity_id") == entity)).isEmpty()


def merge_history(m: Model) -> DataFrame:
    """merge audit rows per entity they touch, on either side."""
    from weft.functions.keys import entity_key

    log = m.raw("resolution_log").select("id", entity_key(F.col("source_id")).alias("s"), entity_key(F.col("target_id")).alias("t"), "strategy", "confidence", "logged_at").distinct()
    side = F.explode(F.array_distinct(F.array("s", "t"))).alias("entity_id")
    return log.select(side, "id", "strategy", "confidence", "logged_at").filter("entity_id is not null")


def component_map(m: Model) -> DataFrame:
    """(entity_id, components): the last payload per type as a map."""
    last = m.components.groupBy("entity_id", "component_type").agg(F.max_by("data", F.struct("version", "created_at", "id")).alias("data"))
    return last.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("component_type", "data")))).alias("components"))


def peers(m: Model) -> DataFrame:
    """Each active entity's relationships both ways with the peer's type and title."""
    both = m.edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), F.col("target_id").alias("peer_id"), "relationship_type").unionByName(
        m.edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), F.col("source_id").alias("peer_id"), "relationship_type")
    )
    peer = m.flat.select(F.col("id").alias("peer_id"), F.col("entity_type").alias("peer_type"), F.col("title").alias("peer_title"))
    return both.join(m.active.select("id"), "id", "left_semi").join(peer, "peer_id", "left").distinct()


def full_detail(m: Model, ids: DataFrame) -> DataFrame:
    """all that is known of the given entities (column id), as rows (id, part, key, value, at): their
    components, outgoing and incoming relationships, versions and merges. Rows, not nested lists:
    a hub may have any number of them."""
    k = ids.select("id").distinct()
    c = m.components.select(F.col("entity_id").alias("id"), F.lit("component").alias("part"), F.col("component_type").alias("key"), F.col("data").alias("value"), F.col("created_at").alias("at"))
    title = m.flat.select(F.col("id").alias("peer"), "title")

    def side(own: str, other: str, part: str) -> DataFrame:
        e = m.edges.select(F.col(own).alias("id"), F.lit(part).alias("part"), F.concat_ws(" ", "relationship_type", other).alias("key"), F.col(other).alias("peer"), F.col("created_at").alias("at"))
        return e.join(k, "id", "left_semi").join(title, "peer", "left").select("id", "part", "key", F.col("title").alias("value"), "at")

    v = versions(m).select("id", F.lit("version").alias("part"), F.col("version").cast("string").alias("key"), F.col("is_active").cast("string").alias("value"), F.col("updated_at").alias("at"))
    h = merge_history(m).select(F.col("entity_id").alias("id"), F.lit("merge").alias("part"), F.col("id").alias("key"), F.col("strategy").alias("value"), F.col("logged_at").alias("at"))
    own = [x.join(k, "id", "left_semi") for x in (c, v, h)]
    out = own[0].unionByName(own[1]).unionByName(own[2])
    return out.unionByName(side("source_id", "target_id", "outgoing")).unionByName(side("target_id", "source_id", "incoming")).distinct()


def summaries(m: Model) -> DataFrame:
    """id, type, title, preview of at most 200 characters, tags, updated_at."""
    return m.flat.select("id", "entity_type", "title", F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("preview"), F.array_join("tags", ", ").alias("tags"), "updated_at")


def sources(m: Model) -> DataFrame:
    """where an entity came from: Provenance's source, else BinaryContent's reference."""
    ref = F.try_variant_get(F.try_parse_json("data"), "$.reference", "string")
    binary = m.components.filter(F.col("component_type") == "BinaryContent").select("entity_id", ref.alias("reference")).filter("reference is not null")
    binary = binary.groupBy("entity_id").agg(F.min("reference").alias("reference"))
    return m.flat.join(binary, m.flat.id == binary.entity_id, "left").select("id", F.coalesce("source_path", "reference").alias("source")).filter("source is not null")


def resolve_mention(m: Model, name: str, kind: str) -> DataFrame:
    """the entity of a type with exactly the title, else the one whose title holds it; least id."""
    rows = m.flat.filter(F.lower("entity_type") == kind.lower())
    exact = F.when(F.col("title") == name, 0).when(F.contains(F.lower("title"), F.lit(name.lower())), 1)
    return rows.withColumn("rank", exact).filter("rank is not null").orderBy("rank", "id").limit(1).select("id", "title", "rank")


def first_component(c: DataFrame) -> DataFrame:
    """the first component of each type of an entity, by created_at then id."""
    w = W.partitionBy("entity_id", "component_type").orderBy(F.col("created_at").asc_nulls_first(), "id", "data")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def word_count(c: Column) -> Column:
    """A13."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


# --- views -----------------------------------------------------------------------------------


def table_view(m: Model, kinds: list[str] | None = None, tags: list[str] | None = None, search: str | None = None, sort: str = "title", descending: bool = False, limit: int | None = None) -> DataFrame:
    """Id, type, title, tags, created, updated as the table shows them."""
    rows = m.flat.select("id", "entity_type", "title", F.array_join("tags", ", ").alias("tags"), "created_at", "updated_at", F.col("tags").alias("_tags"))
    if kinds:
        rows = rows.filter(F.lower("entity_type").isin([k.lower() for k in kinds]))
    if tags:
        rows = rows.filter(F.arrays_overlap("_tags", F.array(*[F.lit(t) for t in tags])))
    if search:
        s = F.lit(search.lower())
        rows = rows.filter(F.contains(F.lower("title"), s) | F.exists("_tags", lambda t: F.contains(F.lower(t), s)) | F.contains(F.lower("entity_type"), s))
    rows = rows.drop("_tags")
    if sort in rows.columns:
        key = F.col(sort).cast("string")
        rows = rows.orderBy(key.desc() if descending else key.asc(), "id") if limit else rows
    return rows.limit(limit) if limit else rows


def quick_filter(rows: DataFrame, text: str) -> DataFrame:
    """Rows of which any cell contains the text."""
    return rows.filter(F.contains(F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in rows.columns])), F.lit(text.lower())))


def tree_view(m: Model) -> DataFrame:
    """(root, kind, child_id, child_title): collections first, then one root per type."""
    title = m.flat.select(F.col("id").alias("child_id"), F.col("title").alias("child_title"), "entity_type")
    named = collections(m).select("collection_id", "title")
    of = m.members.join(named, "collection_id").select(F.col("title").alias("root"), F.lit("collection").alias("kind"), F.col("entity_id").alias("child_id")).join(title.drop("entity_type"), "child_id")
    types = title.select(F.col("entity_type").alias("root"), F.lit("type").alias("kind"), "child_id", "child_title")
    return of.select("root", "kind", "child_id", "child_title").distinct().unionByName(types)


def tree_roots(m: Model, kinds: list[str] | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(position, root, kind, child_id, child_title): collections by name, then a root per type in
    the order in which the types were first made; at most `limit` roots. Types and tags choose the children of
    type roots only. A row per child: a root may have any number of them."""
    named = collections(m).select(F.col("collection_id").alias("rid"), F.col("title").alias("root"))
    rows = m.flat.select("id", "title", "entity_type", "created_at", "tags")
    if kinds:
        rows = rows.filter(F.lower("entity_type").isin([k.lower() for k in kinds]))
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    first = rows.groupBy("entity_type").agg(F.min(F.struct("created_at", "id")).alias("first"))
    order = named.select("rid", "root", F.lit("collection").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.col("root").alias("by"), F.col("rid").alias("then"))
    order = order.unionByName(first.select(F.col("entity_type").alias("rid"), F.col("entity_type").alias("root"), F.lit("type").alias("kind"), F.col("first.created_at").alias("at"), F.lit("").alias("by"), F.col("first.id").alias("then")))
    order = order.orderBy("kind", "by", "at", "then")
    order = order.limit(limit) if limit else order
    roots = order.withColumn("position", F.row_number().over(W.orderBy("kind", "by", "at", "then"))).select("position", "rid", "root", "kind")  # a row per root
    title = m.flat.select(F.col("id").alias("child_id"), F.col("title").alias("child_title"))
    of = m.members.select(F.col("collection_id").alias("rid"), F.col("entity_id").alias("child_id"), F.lit("collection").alias("kind")).join(title, "child_id")
    typed = rows.select(F.col("entity_type").alias("rid"), F.col("id").alias("child_id"), F.lit("type").alias("kind"), F.col("title").alias("child_title"))
    return roots.join(of.unionByName(typed), ["rid", "kind"]).select("position", "root", "kind", "child_id", "child_title")


def graph_all(m: Model, kinds: list[str], limit: int | None = None) -> DataFrame:
    """The edges both of whose ends are active entities of the types, without repeats; with a limit,
    of the first `limit` nodes by id and the first `limit` edges."""
    nodes = m.active.filter(F.lower("entity_type").isin([k.lower() for k in kinds])).select("id")
    nodes = nodes.orderBy("id").limit(limit) if limit else nodes
    inner = m.edges.join(nodes, m.edges.source_id == nodes.id, "left_semi").join(nodes, F.col("target_id") == nodes.id, "left_semi")
    out = inner.select("source_id", "target_id", "relationship_type").distinct()
    return out.orderBy("source_id", "target_id", "relationship_type").limit(limit) if limit else out


def timeline(m: Model, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, entity_type, title, at): the Timeline attribute, else when the entity was made; the first
    `limit` in order of time."""
    rows = m.flat.filter(F.lower("entity_type").isin([k.lower() for k in kinds])) if kinds else m.flat
    out = rows.select("id", "entity_type", "title", F.coalesce("happened_at", "created_at").alias("at"))
    return out.orderBy("at", "id").limit(limit) if limit else out


BUCKETS = ["Today", "Yesterday", "This Week", "This Month", "Last 3 Months", "This Year", "Older"]


def bucket(at: Column, now: Column) -> Column:
    """The label of a time by whole days of 24 hours before now."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000))
    return F.when(days == 0, BUCKETS[0]).when(days == 1, BUCKETS[1]).when(days < 7, BUCKETS[2]).when(days < 30, BUCKETS[3]).when(days < 90, BUCKETS[4]).when(days < 365, BUCKETS[5]).otherwise(BUCKETS[6])


def timeline_buckets(m: Model, now: str) -> DataFrame:
    return timeline(m).groupBy(bucket(F.col("at"), F.lit(now).cast("timestamp")).alias("bucket"), "entity_type").agg(F.count("*").alias("n"))


def dashboard(m: Model) -> DataFrame:
    """Active entities by type."""
    return m.active.groupBy("entity_type").agg(F.count("*").alias("n"))


def recent(m: Model, n: int = 5, without: tuple = ()) -> DataFrame:
    """The entities touched last."""
    rows = m.flat.filter(~F.col("entity_type").isin(list(without))) if without else m.flat
    return rows.orderBy(F.desc("updated_at"), "id").limit(n).select("id", "entity_type", "title", "updated_at")


def format_histogram(m: Model) -> DataFrame:
    """Sources by extension, with how many and the bytes of their payloads."""
    ext = F.lower(F.regexp_extract("source_path", r"\.([A-Za-z0-9]+)$", 1))
    rows = m.flat.filter("source_path is not null").select(F.when(ext == "", "unknown").otherwise(ext).alias("format"), "size_bytes", "content")
    return rows.groupBy("format").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def content_words(m: Model) -> DataFrame:
    """A13 over all entities with content."""
    return m.flat.filter("content is not null").select("id", word_count(F.col("content")).alias("words"))
