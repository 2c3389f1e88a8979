"""Queries of views with limits, services, imports and lookups by value, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.keys import entity_key, sql_uuid
from weft.operators import chat as C
from weft.operators import ocr as OC
from weft.operators import repository as R
from weft.operators import resolve as RS
from weft.operators import search as K
from weft.operators import vectors as V
from weft.plans.model import Model
from weft.queries.model import _INDEX, _REFS, _TITLED, ORACLES, QUERIES, query
from weft.sources import files as FS
from weft.sources import refs as XR

__all__ = ["ORACLES", "QUERIES"]

# --- views with order and limits -------------------------------------------------------------
query("timeline_first", "SELECT id, entity_type, title, coalesce(happened_at, created_at) AS \"at\" FROM flat WHERE entity_type IN ('Article', 'Note') ORDER BY 4, 1 LIMIT 25")(lambda m: R.timeline(m, ["article", "NOTE"], 25))
query("tree_roots", """, coll AS (SELECT DISTINCT c.collection_id AS rid, coalesce(f.title, 'Untitled') AS root FROM member c LEFT JOIN flat f ON f.id = c.collection_id),
picked AS (SELECT * FROM flat WHERE list_has_any(tags, ['harbour', 'ledger', 'vault'])),
roots AS (SELECT rid, root, 'collection' AS kind, CAST(NULL AS TIMESTAMPTZ) AS "at", root AS "by", rid AS "then" FROM coll
  UNION ALL SELECT entity_type, entity_type, 'type', min(created_at), '', arg_min(id, (created_at, id)) FROM picked GROUP BY 1),
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY kind, "by", "at", "then") AS INTEGER) AS position FROM roots)
SELECT position, root, kind, f.id AS child_id, f.title AS child_title FROM placed p JOIN member m ON p.kind = 'collection' AND m.collection_id = p.rid JOIN flat f ON f.id = m.entity_id
UNION ALL SELECT position, root, kind, f.id, f.title FROM placed p JOIN picked f ON p.kind = 'type' AND f.entity_type = p.rid""")(lambda m: R.tree_roots(m, tags=["harbour", "ledger", "vault"]))
query("tree_roots_first", """, coll AS (SELECT DISTINCT c.collection_id AS rid, coalesce(f.title, 'Untitled') AS root FROM member c LEFT JOIN flat f ON f.id = c.collection_id),
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY root, rid) AS INTEGER) AS position FROM coll ORDER BY root, rid LIMIT 3)
SELECT position, root, 'collection' AS kind, f.id AS child_id, f.title AS child_title FROM placed p JOIN member m ON m.collection_id = p.rid JOIN flat f ON f.id = m.entity_id""")(lambda m: R.tree_roots(m, limit=3))
query("graph_view_first", """, nodes AS (SELECT id FROM act WHERE entity_type IN ('Article', 'Note') ORDER BY id LIMIT 400)
SELECT DISTINCT source_id, target_id, relationship_type FROM edge WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) ORDER BY 1, 2, 3 LIMIT 400""")(lambda m: R.graph_all(m, ["article", "note"], 400))
query("conversations_recent", r""", hm AS (SELECT DISTINCT source_id, target_id FROM edge WHERE relationship_type = 'HasMessage')
SELECT f.id AS conversation_id, f.title, count(*) AS messages, max(t.created_at) AS last_message_at FROM hm JOIN flat f ON f.id = source_id LEFT JOIN flat t ON t.id = target_id GROUP BY 1, 2
ORDER BY 4 DESC NULLS LAST, 1 LIMIT 20""")(lambda m: C.conversations_list(m).orderBy(F.col("last_message_at").desc_nulls_last(), "conversation_id").limit(20).select("conversation_id", "title", "messages", "last_message_at"))

query("conversation_view", """, hm AS (SELECT DISTINCT source_id, target_id FROM edge WHERE relationship_type = 'HasMessage'),
told AS (SELECT entity_id, arg_max(struct_pack(r := json_extract_string(data, '$.role'), t := coalesce(CASE WHEN json_type(data, '$.content') NOT IN ('NULL') THEN json_extract_string(data, '$.content') END, json_extract_string(data, '$.text'))), (version, created_at, id)) AS m
  FROM comp WHERE component_type = 'MessageContent' AND json_valid(data) AND coalesce(json_extract_string(data, '$.content'), json_extract_string(data, '$.text')) IS NOT NULL GROUP BY 1),
rated AS (SELECT entity_id, arg_max(json_extract_string(data, '$.rating'), (created_at, version, id)) AS rating FROM comp WHERE component_type = 'Provenance' AND json_valid(data) AND json_extract_string(data, '$.rating') IS NOT NULL GROUP BY 1)
SELECT source_id AS conversation_id, target_id AS message_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY f.created_at, target_id) AS INTEGER) AS position, told.m.r AS role, told.m.t AS text, rated.rating
FROM hm JOIN flat f ON f.id = target_id LEFT JOIN told ON told.entity_id = target_id LEFT JOIN rated ON rated.entity_id = target_id""")(C.conversation_view)

# --- lookups by value ------------------------------------------------------------------------
_least = lambda m: m.active.agg(F.min("id")).first()[0]
_source = lambda m: m.edges.agg(F.min("source_id")).first()[0]
query("entity_get", "SELECT id, entity_type, version FROM ent WHERE id = (SELECT min(id) FROM act)")(lambda m: R.get(m, [_least(m), "00000000-0000-0000-0000-00000000ffff"]).select("id", "entity_type", "version"))
query("entity_versions_of", "SELECT DISTINCT id, version, updated_at, is_active FROM entities WHERE id = (SELECT min(id) FROM act)")(lambda m: R.versions(m, _least(m)))
query("relationships_of_source", "SELECT id, source_id, target_id, relationship_type FROM edge WHERE source_id = (SELECT min(source_id) FROM edge)")(lambda m: R.related(m, source=_source(m)).select("id", "source_id", "target_id", "relationship_type"))
query("relationships_of_pair", "SELECT id, relationship_type FROM edge WHERE (source_id, target_id) = (SELECT (source_id, target_id) FROM edge ORDER BY source_id, target_id LIMIT 1)")(
    lambda m: (lambda e: R.related(m, e["source_id"], e["target_id"]))(m.edges.orderBy("source_id", "target_id").first()).select("id", "relationship_type")
)
query("membership_test", "SELECT true AS held, false AS other")(
    lambda m: (lambda x: m.spark.createDataFrame([(R.is_member(m, x["collection_id"], x["entity_id"]), R.is_member(m, x["entity_id"], x["entity_id"]))], "held boolean, other boolean"))(m.members.filter("collection_id != entity_id").orderBy("collection_id", "entity_id").first())
)
query("quick_filter", "SELECT id, title FROM flat WHERE contains(lower(id || chr(1) || title), 'vault')")(lambda m: R.quick_filter(m.flat.select("id", "title"), "VAULT"))
_FIVE = "(SELECT id FROM act ORDER BY id LIMIT 5)"
query("entity_full_detail", f"""SELECT entity_id AS id, 'component' AS part, component_type AS key, data AS value, created_at AS "at" FROM comp WHERE entity_id IN {_FIVE}
UNION SELECT source_id, 'outgoing', relationship_type || ' ' || target_id, title, e.created_at FROM edge e LEFT JOIN flat f ON f.id = target_id WHERE source_id IN {_FIVE}
UNION SELECT target_id, 'incoming', relationship_type || ' ' || source_id, title, e.created_at FROM edge e LEFT JOIN flat f ON f.id = source_id WHERE target_id IN {_FIVE}
UNION SELECT id, 'version', CAST(version AS VARCHAR), CAST(is_active AS VARCHAR), updated_at FROM entities WHERE id IN {_FIVE}
UNION SELECT x, 'merge', id, strategy, logged_at FROM (SELECT id, strategy, logged_at, unnest([{sql_uuid('source_id')}, {sql_uuid('target_id')}]) AS x FROM resolution_log) WHERE x IN {_FIVE}""")(
    lambda m: R.full_detail(m, m.active.select("id").orderBy("id").limit(5))
)

# --- search services -------------------------------------------------------------------------
_held = lambda m: (m.postings, m.lengths)
query("retrieval_search", _INDEX + """SELECT entity_id, f.entity_type, f.title, substr(coalesce(f.content, ''), 1, 200) AS preview, round(score, 6) AS score FROM bm JOIN flat f ON f.id = entity_id
WHERE lower(f.entity_type) = 'article' ORDER BY bm.score, entity_id LIMIT 20""")(
    lambda m: K.retrieval(K.search_docs(m.flat), "harbour OR ledger", ("article", "note"), held=_held(m)).select("entity_id", "entity_type", "title", "preview", F.round("score", 6).alias("score"))
)
query("mention_autocomplete", _INDEX + "SELECT entity_id, f.entity_type, f.title, substr(coalesce(f.content, ''), 1, 200) AS preview, round(score, 6) AS score FROM bm JOIN flat f ON f.id = entity_id WHERE hits = 2")(
    lambda m: K.mentions(K.search_docs(m.flat), "ledger harbour", _held(m)).select("entity_id", "entity_type", "title", "preview", F.round("score", 6).alias("score"))
)
query("embeddings_rebuilt", "SELECT id AS entity_id, 'fold' AS model, 64 AS dimensions, NULL AS error FROM flat WHERE content <> ''")(lambda m: V.rebuilt(K.search_docs(m.flat)).select("entity_id", "model", "dimensions", "error"))

# --- imports, references, resolution ---------------------------------------------------------
_DOCS = "SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN sha256(text) END AS h FROM documents"


def _import_actions(m: Model):
    known = m.raw("documents").filter("doc_id % 7 = 0 and text rlike '\\\\S'").select(F.sha2("text", 256).alias("content_hash"))
    files = m.raw("documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.when(F.col("text").rlike(r"\S"), F.sha2("text", 256)).alias("content_hash"))
    return FS.import_counts(FS.import_actions(files, known))


query("import_summary", f""", d AS ({_DOCS}), k AS (SELECT h FROM d WHERE doc_id % 7 = 0 AND h IS NOT NULL), f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM d)
SELECT CASE WHEN h IS NULL THEN 'error' WHEN h IN (SELECT h FROM k) OR doc_id <> first THEN 'merged' ELSE 'created' END AS action, count(*) AS n FROM f GROUP BY 1""")(_import_actions)
# texts as notes that spell their plain addresses as links
_linked = lambda m: m.raw("documents").withColumn("text", F.regexp_replace("text", r"(https?://\S+)", "[$1]($1)"))
query("url_edges", _REFS + rf""", u AS (SELECT doc_id, entity_id, unnest(regexp_extract_all(regexp_replace(text, '(https?://\S+)', '[\1](\1)', 'g'), '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 2)) AS url FROM documents)
SELECT DISTINCT {sql_uuid('entity_id')} AS entity_id, url FROM u WHERE regexp_matches(url, '^https?://') AND {sql_uuid('entity_id')} <> '00000000-0000-0000-0000-000000000000'""")(
    lambda m: XR.url_edges(XR.markdown_refs(_linked(m)), m.raw("documents").select("doc_id", entity_key(F.col("entity_id")).alias("entity_id")).filter("entity_id is not null"))[1].select("entity_id", F.get_json_object("data", "$.url").alias("url"))
)
# every entity's own source as a reference to a section of it
query("refs_by_path", """, p AS (SELECT id, './' || upper(source_path) || '#part' AS target, lower(source_path) AS path FROM flat WHERE source_path IS NOT NULL)
SELECT p.id AS doc_id, 'section' AS kind, target, min(f.id) AS entity_id FROM p JOIN flat f ON contains(lower(f.source_path), path) AND regexp_extract(lower(f.source_path), '([^/]*)$', 1) = regexp_extract(path, '([^/]*)$', 1) GROUP BY 1, 2, 3""")(
    lambda m: XR.path_refs(m.flat.filter("source_path is not null").select(F.col("id").alias("doc_id"), F.lit("section").alias("kind"), F.concat(F.lit("./"), F.upper("source_path"), F.lit("#part")).alias("target")), m.flat)
)
query("content_matches", _TITLED + r""", w AS (SELECT id, entity_type, list_distinct(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS w FROM titled WHERE content <> ''),
c AS (SELECT a.id, b.id AS canonical_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score
  FROM (SELECT *, min(id) OVER (PARTITION BY entity_type) AS first FROM w) a JOIN w b ON b.id = a.first AND a.id <> b.id)
SELECT id, canonical_id, round(score, 6) AS confidence FROM c WHERE score >= 0.12""")(lambda m: _content_matches(RS.titled(m.flat)))


def _content_matches(t):
    """Every entity with content against the first of its type."""
    held = t.filter("content != ''")
    first = held.groupBy("entity_type").agg(F.min("id").alias("canonical_id"))
    pairs = held.join(first, "entity_type").filter("id != canonical_id").select("id", "canonical_id")
    return RS.content_matches(t, pairs, 0.12).withColumn("confidence", F.round("confidence", 6))


query("ocr_events", f"""SELECT entity_id, 'ComponentUpdated' AS event_type, count(*) AS pages, round(avg(c), 6) AS confidence FROM (
  SELECT {sql_uuid('entity_id')} AS entity_id, page_no, max(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.5 WHEN confidence > 1 THEN least(confidence / 100, 1.0) ELSE greatest(confidence, 0.0) END) AS c
  FROM ocr_results WHERE text IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2) WHERE entity_id <> '00000000-0000-0000-0000-000000000000' GROUP BY 1""")(lambda m: OC.events(m.raw("ocr_results")).withColumn("confidence", F.round("confidence", 6)))
