"""Queries of the engine's own operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import similarity as X
from weft.functions.keys import sql_uuid
from weft.operators import chat as C
from weft.operators import repository as R
from weft.operators import resolve as RS
from weft.operators import search as K
from weft.operators import traverse as G
from weft.operators import vectors as V
from weft.plans.model import Model, prelude
from weft.queries.general import _WIDE_ORACLE
from weft.sources import files as FS
from weft.sources import refs as XR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_P = prelude(_WIDE_ORACLE)
NOW = "2025-06-01 00:00:00"


def query(name: str, sql: str | None = None, model: bool = True):
    """Registers a query over the model, with its SQL over the prelude's tables."""

    def keep(f):
        QUERIES[name] = (lambda s, d: f(Model(s, d))) if model else f
        if sql:
            ORACLES[name] = (_P if model else "") + sql
        return f

    return keep


# --- lookups ---------------------------------------------------------------------------------
query("entity_list", "SELECT id, entity_type, created_at, updated_at, version FROM act")(lambda m: m.active.select("id", "entity_type", "created_at", "updated_at", "version"))
query("find_by_type", "SELECT id, version FROM act WHERE lower(entity_type) = 'article'")(lambda m: R.by_type(m, "ARTICLE").select("id", "version"))
query("find_by_title", "SELECT id, entity_type FROM flat WHERE title = 'Import workspace'")(lambda m: R.by_title(m, "Import workspace").select("id", "entity_type"))
query("find_by_component_type", "SELECT id, entity_type FROM act WHERE id IN (SELECT entity_id FROM comp WHERE component_type = 'Summary')")(lambda m: R.by_component_type(m, "Summary").select("id", "entity_type"))
query("find_by_tag", "SELECT id, title FROM flat WHERE len(list_filter(tags, lambda t: lower(t) = 'harbour')) > 0")(lambda m: R.by_tag(m, "Harbour").select("id", "title"))
query("find_by_tag_text", """SELECT id, entity_type FROM act WHERE id IN (SELECT entity_id FROM comp WHERE component_type = 'Tags' AND data ILIKE '%"harbour"%')""")(lambda m: R.by_tag_text(m, "harbour").select("id", "entity_type"))
query("version_history", "SELECT DISTINCT id, version, updated_at, is_active FROM entities")(R.versions)
query("component_find", "SELECT id, entity_id, version FROM comp WHERE component_type = 'Summary'")(lambda m: m.components.filter("component_type = 'Summary'").select("id", "entity_id", "version"))
query("component_contains", "SELECT id, entity_id FROM comp WHERE component_type = 'Content' AND contains(lower(data), 'harbour')")(lambda m: R.component_contains(m, "Content", "Harbour").select("id", "entity_id"))
query("component_path", "SELECT id, entity_id FROM comp WHERE component_type = 'Provenance' AND json_valid(data) AND data->>'$.format' = 'md'")(lambda m: R.component_path_equals(m, "Provenance", "$.format", "md").select("id", "entity_id"))
query("relationships_by_type", "SELECT id, source_id, target_id FROM edge WHERE relationship_type = 'ReferencedBy'")(lambda m: R.related(m, kind="ReferencedBy").select("id", "source_id", "target_id"))
query("edges_by_source", "SELECT source_id, count(*) AS n, count(DISTINCT target_id) AS targets FROM edge GROUP BY 1")(lambda m: m.edges.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets")))
query("edges_by_target", "SELECT target_id, count(*) AS n FROM edge GROUP BY 1")(lambda m: m.edges.groupBy("target_id").agg(F.count("*").alias("n")))
query("events_by_user", "SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 17", False)(
    lambda s, d: R.events(Model(s, d), 17).select("event_id", "user_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
)
query("collections_list", "SELECT c.collection_id, coalesce(f.title, 'Untitled') AS title, coalesce(n, 0) AS members FROM (SELECT DISTINCT collection_id FROM member) c LEFT JOIN flat f ON f.id = c.collection_id LEFT JOIN (SELECT collection_id, count(*) AS n FROM member WHERE entity_id IN (SELECT id FROM act) GROUP BY 1) m ON m.collection_id = c.collection_id")(R.collections)
query("collection_members", "SELECT collection_id, entity_id, entity_type FROM member JOIN act ON act.id = entity_id")(R.collection_members)
query("entity_collections", "SELECT entity_id, count(DISTINCT collection_id) AS collections FROM member GROUP BY 1")(R.entity_collections)
query("merge_history", f"""SELECT DISTINCT unnest(list_distinct([s, t])) AS entity_id, id, strategy, confidence, logged_at FROM
  (SELECT DISTINCT id, nullif({sql_uuid('source_id')}, '00000000-0000-0000-0000-000000000000') AS s, nullif({sql_uuid('target_id')}, '00000000-0000-0000-0000-000000000000') AS t, strategy, confidence, logged_at FROM resolution_log)""")(R.merge_history)
query("entity_components", "SELECT entity_id, count(DISTINCT component_type) AS types, count(DISTINCT id) AS payloads FROM comp GROUP BY 1")(lambda m: m.components.groupBy("entity_id").agg(F.count_distinct("component_type").alias("types"), F.count_distinct("id").alias("payloads")))
query("entity_detail", "SELECT entity_id, component_type, arg_max(data, (version, created_at, id)) AS data FROM comp GROUP BY 1, 2")(lambda m: R.component_map(m).select("entity_id", F.explode("components").alias("component_type", "data")))
query("entity_peers", """SELECT DISTINCT e.id, direction, peer_id, relationship_type, f.entity_type AS peer_type, f.title AS peer_title FROM
  (SELECT source_id AS id, 'out' AS direction, target_id AS peer_id, relationship_type FROM edge UNION ALL SELECT target_id, 'in', source_id, relationship_type FROM edge) e
  LEFT JOIN flat f ON f.id = e.peer_id WHERE e.id IN (SELECT id FROM act)""")(R.peers)
query("entity_summaries", "SELECT id, entity_type, title, substr(coalesce(content, ''), 1, 200) AS preview, array_to_string(tags, ', ') AS tags, updated_at FROM flat")(R.summaries)
query("entity_sources", """SELECT id, coalesce(source_path, r) AS source FROM flat LEFT JOIN (SELECT entity_id, min(data->>'$.reference') AS r FROM comp WHERE component_type = 'BinaryContent' AND json_valid(data) GROUP BY 1) b ON b.entity_id = id
  WHERE coalesce(source_path, r) IS NOT NULL""")(R.sources)
query("resolve_mention", "SELECT id, title, CASE WHEN title = 'harbour' THEN 0 ELSE 1 END AS rank FROM flat WHERE entity_type = 'Article' AND contains(lower(title), 'harbour') ORDER BY 3, 1 LIMIT 1")(lambda m: R.resolve_mention(m, "harbour", "article"))
query("first_components", "SELECT id, entity_id, component_type FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, component_type ORDER BY created_at NULLS FIRST, id, data NULLS FIRST) AS rn FROM comp) WHERE rn = 1")(lambda m: R.first_component(m.components).select("id", "entity_id", "component_type"))

# --- aggregates and views --------------------------------------------------------------------
query("dashboard_types", "SELECT entity_type, count(*) AS n FROM act GROUP BY 1")(R.dashboard)
query("recent_entities", "SELECT id, entity_type, title, updated_at FROM flat ORDER BY updated_at DESC, id LIMIT 5")(R.recent)
query("recent_fallback", "SELECT id, entity_type, title, updated_at FROM flat WHERE entity_type NOT IN ('Conversation', 'Message') ORDER BY updated_at DESC, id LIMIT 10")(lambda m: R.recent(m, 10, ("Conversation", "Message")))
query("distinct_types", "SELECT DISTINCT entity_type FROM act")(lambda m: m.active.select("entity_type").distinct())
query("format_histogram", r"SELECT coalesce(nullif(lower(regexp_extract(source_path, '\.([A-Za-z0-9]+)$', 1)), ''), 'unknown') AS format, count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM flat WHERE source_path IS NOT NULL GROUP BY 1")(R.format_histogram)
query("content_words", r"SELECT id, len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS words FROM flat WHERE content IS NOT NULL")(R.content_words)
query("table_view_articles", "SELECT id, entity_type, title, array_to_string(tags, ', ') AS tags, created_at, updated_at FROM flat WHERE entity_type = 'Article'")(lambda m: R.table_view(m, ["article"]))
query("table_view_search", "SELECT id, entity_type, title, array_to_string(tags, ', ') AS tags, created_at, updated_at FROM flat WHERE contains(lower(title), 'vault') OR contains(lower(entity_type), 'vault') OR len(list_filter(tags, lambda t: contains(lower(t), 'vault'))) > 0")(lambda m: R.table_view(m, search="Vault"))
query("table_view_sorted", "SELECT id, entity_type, title, array_to_string(tags, ', ') AS tags, created_at, updated_at FROM flat WHERE list_has_any(tags, ['harbour', 'ledger']) ORDER BY title DESC, id LIMIT 20")(lambda m: R.table_view(m, tags=["harbour", "ledger"], descending=True, limit=20))
query("tree_view", "SELECT DISTINCT coalesce(c.title, 'Untitled') AS root, 'collection' AS kind, f.id AS child_id, f.title AS child_title FROM member m JOIN flat f ON f.id = m.entity_id LEFT JOIN flat c ON c.id = m.collection_id UNION ALL SELECT entity_type, 'type', id, title FROM flat")(R.tree_view)
query("graph_view_induced", "SELECT DISTINCT source_id, target_id, relationship_type FROM edge WHERE source_id IN (SELECT id FROM act WHERE entity_type IN ('Article', 'Note')) AND target_id IN (SELECT id FROM act WHERE entity_type IN ('Article', 'Note'))")(lambda m: R.graph_all(m, ["Article", "Note"]))
query("timeline_view", "SELECT id, entity_type, title, coalesce(happened_at, created_at) AS at FROM flat".replace(" AS at", ' AS "at"'))(R.timeline)
query("timeline_buckets", f"""SELECT CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN 'This Week' WHEN d < 30 THEN 'This Month' WHEN d < 90 THEN 'Last 3 Months' WHEN d < 365 THEN 'This Year' ELSE 'Older' END AS bucket,
  entity_type, count(*) AS n FROM (SELECT entity_type, floor((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(coalesce(happened_at, created_at))) / 86400000000.0) AS d FROM flat) GROUP BY 1, 2""")(lambda m: R.timeline_buckets(m, NOW))

# --- keyword search --------------------------------------------------------------------------


def _index(*terms: str, more: str = "false") -> str:
    return f""", words AS (SELECT id AS entity_id, entity_type, tags AS tag_list, list_concat(list_concat({K.sql_tokens('title')}, {K.sql_tokens('content')}), {K.sql_tokens("array_to_string(tags, ', ')")}) AS w FROM flat),
post AS (SELECT term, entity_id, count(*) AS tf FROM (SELECT entity_id, unnest(w) AS term FROM words) GROUP BY 1, 2),
stat AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM words),
hit AS (SELECT p.*, len(w) AS len, count(*) OVER (PARTITION BY term) AS df FROM post p JOIN words USING (entity_id) WHERE term IN ({', '.join(repr(t) for t in terms) or "''"}) OR {more}),
bm AS (SELECT entity_id, -sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS hits FROM hit, stat GROUP BY 1)
"""


_INDEX = _index("harbour", "ledger")
_search = lambda m, q, **k: K.search(K.search_docs(m.flat), q, held=(m.postings, m.lengths), **k).select("entity_id", F.round("score", 6).alias("score"))
query("keyword_and", _INDEX + "SELECT entity_id, round(score, 6) AS score FROM bm WHERE hits = 2")(lambda m: _search(m, "harbour ledger"))
query("keyword_or", _INDEX + "SELECT entity_id, round(score, 6) AS score FROM bm")(lambda m: _search(m, "harbour OR ledger"))
query("keyword_not", _INDEX + ", h AS (SELECT entity_id, -greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM hit, stat WHERE term = 'harbour') SELECT entity_id, round(score, 6) AS score FROM h WHERE entity_id NOT IN (SELECT entity_id FROM post WHERE term = 'ledger')")(lambda m: _search(m, "harbour NOT ledger"))
query("keyword_type_tag", _INDEX + "SELECT entity_id, round(score, 6) AS score FROM bm JOIN words USING (entity_id) WHERE lower(entity_type) = 'article' AND list_contains(tag_list, 'harbour')")(lambda m: _search(m, "harbour OR ledger", kind="article", tag="harbour"))
query("keyword_phrase", _index("the", "harbour", "waits", more="starts_with(term, 'ledg')") + """SELECT entity_id, round(score, 6) AS score FROM bm JOIN words USING (entity_id)
WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' the harbour waits ') OR len(list_filter(w, lambda t: starts_with(t, 'ledg'))) > 0""")(lambda m: _search(m, '"the harbour waits" OR ledg*'))
query("keyword_column", _index() + f""", one AS (SELECT id AS entity_id, {K.sql_tokens('title')} AS tw, {K.sql_tokens('content')} AS cw FROM flat),
own AS (SELECT entity_id, 'title:relay' AS term, len(list_filter(tw, lambda t: t = 'relay')) AS tf FROM one UNION ALL SELECT entity_id, 'content:harbour', len(list_filter(cw, lambda t: t = 'harbour')) FROM one),
got AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM own WHERE tf > 0)
SELECT g.entity_id, round(-sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.w) / mean))), 6) AS score FROM got g JOIN words w USING (entity_id), stat GROUP BY 1""")(lambda m: _search(m, "title:relay OR content : harbour"))
query("search_postings", _INDEX + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1")(lambda m: m.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
query("chat_terms", f"""SELECT id, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nl}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 AND NOT list_contains([{', '.join(repr(w) for w in K.STOPWORDS)}], w)), ' OR ') AS terms
  FROM (SELECT DISTINCT id, text FROM message_details WHERE text IS NOT NULL)""", False)(lambda s, d: Model(s, d).raw("message_details").filter("text is not null").select("id", "text").distinct().select("id", F.array_join(K.chat_terms(F.col("text")), " OR ").alias("terms")))

# --- vectors ---------------------------------------------------------------------------------


def _query_vector(m: Model) -> list[float]:
    return list(m.raw("embeddings").orderBy("vec_id").select("embedding").first()[0])


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1))"
_named = lambda m: m.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
query("vector_topk", f"SELECT vec_id AS id, label, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10", False)(lambda s, d: V.top_k(_named(Model(s, d)), "embedding", _query_vector(Model(s, d)), 10).select("id", "label", F.round("score", 6).alias("score")))
query("vector_topk_filtered", f"SELECT vec_id AS id, label, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 3) AND {_COS} >= 0.0 ORDER BY {_COS} DESC, vec_id LIMIT 10", False)(lambda s, d: V.top_k(_named(Model(s, d)).filter("label in (1, 3)"), "embedding", _query_vector(Model(s, d)), 10, 0.0).select("id", "label", F.round("score", 6).alias("score")))
query("vector_cosines", f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings", False)(lambda s, d: _named(Model(s, d)).select("id", F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _query_vector(Model(s, d))])), 6).alias("score")))
query("embeddings_latest", "SELECT entity_id, model, dimensions, created_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, model ORDER BY created_at DESC) AS rn FROM embedding_vectors WHERE model IS NOT NULL) WHERE rn = 1")(lambda m: V.latest(m.raw("embedding_vectors").filter("model is not null"), ["entity_id", "model"], ["created_at"]).select("entity_id", "model", "dimensions", "created_at"))
_MODEL_VECTORS = """, vec AS (SELECT entity_id, CAST(vector AS DOUBLE[]) AS x FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC) AS rn FROM embedding_vectors WHERE model = 'fold-64')
  WHERE rn = 1 AND len(vector) = 64 AND dimensions = 64 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
asked AS (SELECT x FROM vec ORDER BY entity_id LIMIT 1),
vs AS (SELECT f.id, f.entity_type, f.title, round(list_cosine_similarity(v.x, a.x), 9) AS score FROM vec v JOIN flat f ON f.id = v.entity_id, asked a)
"""


def _entity_vectors(m: Model) -> DataFrame:
    """(entity_id, vector) of the model fold-64, the latest of each entity that can be compared."""
    rows = V.latest(m.raw("embedding_vectors").filter("model = 'fold-64'"), ["entity_id"], ["created_at"])
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter((F.size("vector") == 64) & (F.col("dimensions") == 64)).filter(fine).select("entity_id", "vector")


def _asked_vector(m: Model) -> list[float]:
    return list(_entity_vectors(m).orderBy("entity_id").select("vector").first()[0])


query("vector_entities", _MODEL_VECTORS + "SELECT id, entity_type, title, round(score, 6) AS score FROM vs WHERE entity_type = 'Article' AND score >= 0 ORDER BY vs.score DESC, id LIMIT 20")(
    lambda m: V.search_entities(_entity_vectors(m), m.flat, _asked_vector(m), 20, 0.0, "article").withColumn("score", F.round("score", 6))
)


@query("hybrid_rrf", _INDEX + _MODEL_VECTORS + """, kw AS (SELECT entity_id AS id, row_number() OVER (ORDER BY round(score, 9), entity_id) - 1 AS rank FROM bm ORDER BY rank LIMIT 50),
  near AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM vs ORDER BY rank LIMIT 50)
  SELECT id, round(sum(1.0 / (61 + rank)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM near) GROUP BY 1""")
def hybrid_rrf(m: Model) -> DataFrame:
    """Keywords and vectors of the same entities."""
    kw = K.bm25(m.postings, m.lengths, ["harbour", "ledger"]).select(F.col("entity_id").alias("id"), F.round("score", 9).alias("score")).orderBy("score", "id").limit(50)
    vec = V.search_entities(_entity_vectors(m), m.flat, _asked_vector(m), 1 << 30).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return V.hybrid(kw, vec).select("id", F.round("score", 9).alias("score"))


query("embed_fold")(lambda m: m.flat.filter("content is not null").select("id", V.embed(F.col("content")).alias("vector")))
query("embed_mock")(lambda m: m.flat.select("id", V.provider("mock://32")(F.col("title")).alias("vector")))

# --- traversal -------------------------------------------------------------------------------


def _start(m: Model) -> str:
    """The least active source of an active edge to an active entity other than itself."""
    a = m.active.select("id")
    e = m.edges.filter("source_id != target_id").join(a, m.edges.source_id == a.id, "left_semi").join(a, F.col("target_id") == a.id, "left_semi")
    return e.agg(F.min("source_id")).first()[0]


def _walk(steps: str, where: str = "") -> str:
    return f""", ok AS (SELECT * FROM edge WHERE source_id IN (SELECT id FROM act) AND target_id IN (SELECT id FROM act) {where}),
every AS (SELECT * FROM edge WHERE source_id IN (SELECT id FROM act) AND target_id IN (SELECT id FROM act)),
start AS (SELECT min(source_id) AS id FROM every WHERE source_id <> target_id),
hop AS (SELECT DISTINCT "at", "to" FROM ({steps})),
walk AS (SELECT id, 0 AS depth FROM start UNION SELECT h."to", w.depth + 1 FROM walk w JOIN hop h ON h."at" = w.id WHERE w.depth < 3),
reach AS (SELECT id AS entity_id, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0)
"""


_OUT = 'SELECT source_id AS "at", target_id AS "to" FROM ok'
_IN = 'SELECT target_id AS "at", source_id AS "to" FROM ok'
_go = lambda m, way, **k: G.traverse(m.entities, m.edges, _start(m), way, 3, None, **k)
for _way, _sql in (("outgoing", _OUT), ("incoming", _IN), ("both", f"{_OUT} UNION ALL {_IN}")):
    query(f"traverse_{_way}", _walk(_sql) + "SELECT entity_id, depth FROM reach")(lambda m, way=_way: _go(m, way).select("entity_id", "depth"))
query("traverse_rel_filter", _walk(f"{_OUT} UNION ALL {_IN}", "AND relationship_type = 'References'") + "SELECT entity_id, depth FROM reach")(lambda m: _go(m, "both", kind="References").select("entity_id", "depth"))
query("traverse_type_filter", _walk(f"{_OUT} UNION ALL {_IN}") + "SELECT entity_id, depth FROM reach JOIN act ON act.id = entity_id WHERE entity_type = 'Note'")(lambda m: _go(m, "both", entity_type="note").select("entity_id", "depth"))
query("traverse_by_depth", _walk(f"{_OUT} UNION ALL {_IN}") + "SELECT depth, count(*) AS n FROM reach GROUP BY 1")(lambda m: G.by_depth(_go(m, "both")))
_LEVELS = """, ok AS (SELECT * FROM edge WHERE source_id IN (SELECT id FROM act) AND target_id IN (SELECT id FROM act)),
start AS (SELECT min(source_id) AS id FROM ok WHERE source_id <> target_id),
hop AS (SELECT source_id AS "at", target_id AS "to", 0 AS dir, source_id, target_id, relationship_type FROM ok UNION ALL SELECT target_id, source_id, 1, source_id, target_id, relationship_type FROM ok),
l0 AS (SELECT id, 0 AS depth, id AS path, '' AS edges FROM start)""" + "".join(
    f""",
l{k} AS (SELECT h."to" AS id, {k} AS depth, arg_min(f.path || '>' || h."to", (h.dir, f.id, h.source_id, h.target_id, h.relationship_type)) AS path,
    arg_min(f.edges || ';' || h.source_id || '|' || h.target_id || '|' || h.relationship_type, (h.dir, f.id, h.source_id, h.target_id, h.relationship_type)) AS edges
  FROM l{k - 1} f JOIN hop h ON h."at" = f.id WHERE h."to" NOT IN ({' UNION ALL '.join(f'SELECT id FROM l{j}' for j in range(k))}) GROUP BY 1)"""
    for k in (1, 2, 3)
)
_edge_text = lambda: F.transform("edges", lambda e: F.concat(F.lit(";"), F.concat_ws("|", e["source_id"], e["target_id"], e["relationship_type"])))
query("traverse_paths", _LEVELS + " SELECT id AS entity_id, depth, path, edges FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)")(
    lambda m: _go(m, "both").select("entity_id", "depth", F.array_join("path", ">").alias("path"), F.array_join(_edge_text(), "").alias("edges"))
)
query("traverse_service", _LEVELS + " SELECT path FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) ORDER BY depth, id LIMIT 100")(
    lambda m: G.service_paths(m.entities, m.edges, _start(m)).select(F.array_join("path", ">").alias("path"))
)
query("graph_view_from", _LEVELS + """, one AS (SELECT DISTINCT unnest(string_split(edges[2:], ';')) AS e FROM (SELECT * FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) ORDER BY depth, id LIMIT 100))
SELECT split_part(e, '|', 1) AS source_id, split_part(e, '|', 2) AS target_id, split_part(e, '|', 3) AS relationship_type FROM one""")(lambda m: G.graph_from(m.entities, m.edges, _start(m), 2)[1])

# --- resolution ------------------------------------------------------------------------------
_NORM = r"trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
_TITLED = f""", titled AS (SELECT id, entity_type, title, {_NORM.format('title')} AS norm, content, lang_code AS lang, size_bytes AS size, strftime(happened_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM flat WHERE title <> 'Untitled'),
dist AS (SELECT DISTINCT entity_type, norm FROM titled WHERE octet_length(encode(norm)) >= 10),
pairs AS (SELECT x.entity_type, x.norm AS a, y.norm AS b FROM dist x JOIN dist y ON x.entity_type = y.entity_type AND x.norm < y.norm),
near AS (SELECT *, greatest(jaro_winkler_similarity(a, b), 1 - levenshtein(a, b) / greatest(octet_length(encode(a)), octet_length(encode(b)))) AS confidence FROM pairs)
"""
_class = lambda k, c: _TITLED + f"SELECT id, canonical_id, CAST({c} AS DOUBLE) AS confidence FROM (SELECT id, min(id) OVER (PARTITION BY entity_type, {k}) AS canonical_id FROM titled) WHERE id <> canonical_id"
query("resolve_exact", _class("title", 1.0))(lambda m: RS.classes(RS.titled(m.flat), "title"))
query("resolve_normalized", _class("norm", 0.95))(lambda m: RS.classes(RS.titled(m.flat), "norm"))
# DuckDB compares bytes, not letters, where titles have accents: tested against brute force instead
query("resolve_fuzzy")(lambda m: RS.near_titles(RS.titled(m.flat), 0.9).withColumn("confidence", F.round("confidence", 6)))
_CANDIDATES = _TITLED + """, reps AS (SELECT entity_type, norm, min(id) AS id FROM titled GROUP BY 1, 2),
cand AS (SELECT * FROM (
  SELECT id, canonical_id, 1.0 AS confidence, 'exact' AS strategy, 0 AS rank FROM (SELECT id, min(id) OVER (PARTITION BY entity_type, title) AS canonical_id FROM titled) WHERE id <> canonical_id
  UNION ALL SELECT id, canonical_id, 0.95, 'normalized', 1 FROM (SELECT id, min(id) OVER (PARTITION BY entity_type, norm) AS canonical_id FROM titled) WHERE id <> canonical_id
  UNION ALL SELECT greatest(x.id, y.id), least(x.id, y.id), confidence, 'fuzzy', 2 FROM near n JOIN reps x ON x.entity_type = n.entity_type AND x.norm = n.a JOIN reps y ON y.entity_type = n.entity_type AND y.norm = n.b WHERE confidence >= 0.95)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, confidence DESC, canonical_id) = 1)
"""
query("resolve_candidates", _CANDIDATES + "SELECT id, canonical_id, round(CAST(confidence AS DOUBLE), 6) AS confidence, strategy FROM cand")(lambda m: RS.candidates(RS.titled(m.flat)).withColumn("confidence", F.round("confidence", 6)))


_WORDS = r"list_distinct(list_filter(string_split_regex({0}.content, '\s+'), lambda w: w <> ''))"


@query("resolve_composite", _CANDIDATES + rf""", side AS (
  SELECT c.id, c.canonical_id, CASE WHEN a.norm = b.norm THEN 1.0 ELSE jaro_winkler_similarity(a.norm, b.norm) END AS t,
    CASE WHEN coalesce(a.content, '') = '' OR coalesce(b.content, '') = '' THEN 0.5 ELSE
      len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) / len(list_distinct(list_concat({_WORDS.format('a')}, {_WORDS.format('b')}))) END AS c,
    list_filter([CASE WHEN a.lang IS NOT NULL AND b.lang IS NOT NULL THEN CASE WHEN a.lang = b.lang THEN 1.0 ELSE 0.0 END END,
      CASE WHEN a.size IS NOT NULL AND b.size IS NOT NULL THEN CASE WHEN a.size / b.size BETWEEN 0.8 AND 1.25 THEN 1.0 WHEN a.size / b.size BETWEEN 0.5 AND 2 THEN 0.5 ELSE 0.0 END END,
      CASE WHEN a.day IS NOT NULL AND b.day IS NOT NULL THEN CASE WHEN a.day = b.day THEN 1.0 WHEN a.day[:7] = b.day[:7] THEN 0.5 ELSE 0.0 END END], lambda x: x IS NOT NULL) AS m
  FROM cand c JOIN titled a ON a.id = c.id JOIN titled b ON b.id = c.canonical_id),
score AS (SELECT *, CASE WHEN len(m) = 0 THEN 0.5 ELSE list_sum(m) / len(m) END AS meta FROM side)
SELECT id, canonical_id, round(t, 6) AS title_score, round(c, 6) AS content_score, round(meta, 6) AS metadata_score, round(0.4 * t + 0.3 * c + 0.2 * meta + 0.05, 6) AS confidence,
  CASE WHEN t = 1 OR 0.4 * t + 0.3 * c + 0.2 * meta + 0.05 >= 0.92 THEN 'merge' WHEN 0.4 * t + 0.3 * c + 0.2 * meta + 0.05 >= 0.78 THEN 'review' ELSE 'create' END AS zone FROM score""")
def resolve_composite(m: Model) -> DataFrame:
    t = RS.titled(m.flat)
    scores = RS.composite_scores(t, RS.candidates(t)).withColumn("zone", RS.decision(F.col("title_score"), F.col("confidence")))
    return scores.withColumns({c: F.round(c, 6) for c in ("title_score", "content_score", "metadata_score", "confidence")})


query("merge_rewire", _TITLED + """, map AS (SELECT id, canonical_id FROM (SELECT id, min(id) OVER (PARTITION BY entity_type, norm) AS canonical_id FROM titled) WHERE id <> canonical_id)
SELECT DISTINCT coalesce(s.canonical_id, source_id) AS source_id, coalesce(t.canonical_id, target_id) AS target_id, relationship_type
FROM edge LEFT JOIN map s ON s.id = source_id LEFT JOIN map t ON t.id = target_id WHERE coalesce(s.canonical_id, source_id) <> coalesce(t.canonical_id, target_id)""")(lambda m: RS.merged(m.edges, RS.classes(RS.titled(m.flat), "norm")))
query("normalize_titles", _TITLED + "SELECT id, norm FROM titled")(lambda m: RS.titled(m.flat).select("id", "norm"))
query("part_titles_fuzzy", """WITH d AS (SELECT DISTINCT p_name AS norm FROM part WHERE octet_length(encode(p_name)) >= 10),
  p AS (SELECT x.norm AS a, y.norm AS b FROM d x JOIN d y ON x.norm < y.norm)
  SELECT a, b, round(greatest(jaro_winkler_similarity(a, b), 1 - levenshtein(a, b) / greatest(octet_length(encode(a)), octet_length(encode(b)))), 6) AS confidence FROM p
  WHERE greatest(jaro_winkler_similarity(a, b), 1 - levenshtein(a, b) / greatest(octet_length(encode(a)), octet_length(encode(b)))) >= 0.6""", False)(
    lambda s, d: RS.near_titles(s.read.parquet(f"{d}/part.parquet").select(F.lit("").alias("entity_type"), F.col("p_name").alias("norm")), 0.6).select("a", "b", F.round("confidence", 6).alias("confidence"))
)
query("merge_log_jaccard", r"""SELECT DISTINCT id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (
  SELECT id, list_distinct(list_filter(string_split_regex(source_title, '\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(target_title, '\s+'), lambda w: w <> '')) AS b
  FROM resolution_log WHERE source_title IS NOT NULL AND target_title IS NOT NULL)""", False)(
    lambda s, d: s.read.parquet(f"{d}/resolution_log.parquet").filter("source_title is not null and target_title is not null").select("id", F.round(X.jaccard(X.words(F.col("source_title")), X.words(F.col("target_title"))), 6).alias("jaccard")).distinct()
)

# --- conversations and context ---------------------------------------------------------------
_HM = ", hm AS (SELECT DISTINCT source_id, target_id FROM edge WHERE relationship_type = 'HasMessage')\n"
query("conversations_list", _HM + r"""SELECT f.id AS conversation_id, f.title, count(*) AS messages, max(t.created_at) AS last_message_at,
  substr(regexp_replace(arg_max(t.message_text, (t.created_at, t.id)) FILTER (t.message_text IS NOT NULL), '\n', ' ', 'g'), 1, 100) AS preview
  FROM hm JOIN flat f ON f.id = source_id LEFT JOIN flat t ON t.id = target_id GROUP BY 1, 2""")(C.conversations_list)
query("conversation_messages", _HM + "SELECT source_id AS conversation_id, target_id AS message_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY t.created_at, target_id) AS INTEGER) AS position, message_text AS text FROM hm JOIN flat t ON t.id = target_id")(C.conversation_messages)
query("message_citations", f"""SELECT DISTINCT message_id, CAST(number AS INTEGER) AS number, f.id AS entity_id, f.entity_type, f.title, substr(coalesce(f.content, ''), 1, 200) AS snippet FROM (
  SELECT {sql_uuid('id')} AS message_id, unnest(range(1, len(entity_refs) + 1)) AS number, unnest(entity_refs) AS ref FROM message_details WHERE len(entity_refs) > 0) r JOIN flat f ON f.id = {sql_uuid('ref')}""")(C.cited)
query("citation_markers", r"SELECT DISTINCT id AS message_id, CAST(unnest(list_distinct(regexp_extract_all(text, '\[([0-9]{1,3})\]', 1))) AS INTEGER) AS number FROM message_details WHERE text IS NOT NULL", False)(
    lambda s, d: C.marker_citations(s.read.parquet(f"{d}/message_details.parquet").select(F.col("id").alias("message_id"), "text")).distinct()
)
_CONTEXT = """, rel AS (SELECT e.source_id AS id, array_to_string(list_sort(list(DISTINCT e.relationship_type || ' → ' || t.title || ' (' || t.entity_type || ')')), '; ') AS relationships
  FROM edge e JOIN flat t ON t.id = e.target_id GROUP BY 1)
SELECT f.id, f.entity_type, f.title, array_to_string(f.tags, ', ') AS tags, coalesce(f.content, '') AS content, coalesce(r.relationships, '') AS relationships FROM flat f LEFT JOIN rel r USING (id)"""
_ASKED = _index("harbour", "keeps", "ledger")
_QUESTION = "Which harbour keeps the ledger?"
_as_text = lambda c: c.withColumn("tags", F.array_join("tags", ", ")).withColumn("relationships", F.array_join("relationships", "; "))
query("chat_context", _ASKED + _CONTEXT + " WHERE f.id IN (SELECT entity_id FROM bm ORDER BY round(score, 9), entity_id LIMIT 10)")(lambda m: _as_text(C.search_context(m, _QUESTION)[0]))
query("chat_prompt", _ASKED + ", ctx AS (" + _CONTEXT.partition("SELECT f.id, f.entity")[0].replace(", rel AS (", "WITH rel AS (") + "SELECT f.id, f.entity" + _CONTEXT.partition("SELECT f.id, f.entity")[2] + """ WHERE f.id IN (SELECT entity_id FROM bm ORDER BY round(score, 9), entity_id LIMIT 10))
SELECT id, '  Type: ' || entity_type || chr(10) || '  Title: ' || title || chr(10) || '  Tags: ' || tags || chr(10) || '  Content: ' || CASE WHEN length(content) > 2000 THEN content[:2000] || '...' ELSE content END || chr(10)
  || CASE WHEN relationships <> '' THEN '  Relationships:' || chr(10) || '    - ' || replace(relationships, '; ', chr(10) || '    - ') || chr(10) ELSE '' END AS block FROM ctx""")(lambda m: C.prompt_blocks(C.search_context(m, _QUESTION)[0]))
query("entity_context", _CONTEXT)(lambda m: _as_text(C.context(m, m.active.select("id"))))

# --- imports ---------------------------------------------------------------------------------
_docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
query("markdown_refs", r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 2)) AS target FROM d)
SELECT DISTINCT doc_id, CASE WHEN regexp_matches(target, '^https?://') THEN 'url' WHEN contains(target, '#') THEN 'section' ELSE 'file' END AS kind, target FROM l WHERE regexp_matches(target, '^https?://') OR contains(target, '#') OR suffix(target, '.md')
UNION SELECT doc_id, 'wikilink', unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) FROM d
UNION SELECT doc_id, 'mention', unnest(regexp_extract_all(text, '@([a-zA-Z_][a-zA-Z0-9_]*)', 1)) FROM d""", False)(lambda s, d: XR.markdown_refs(_docs(s, d)))
# the notes' links as a page would have them
_page = lambda s, d: _docs(s, d).withColumn("text", F.regexp_replace("text", XR.LINK, '<a class="x" href="$2">$1</a>'))
query("html_links", r"""SELECT DISTINCT doc_id, CASE WHEN regexp_matches(target, '^https?://') THEN 'url' WHEN contains(target, '#') THEN 'section' ELSE 'file' END AS kind, target FROM (
  SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', '<a class="x" href="\2">\1</a>', 'g'), '<a\s[^>]*href\s*=\s*["'']?([^"''\s>]+)', 1)) AS target FROM documents WHERE text IS NOT NULL)
  WHERE NOT starts_with(target, 'mailto:') AND NOT starts_with(target, '#')""", False)(lambda s, d: XR.html_refs(_page(s, d)))
query("html_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL", False)(lambda s, d: _docs(s, d).filter("text is not null").select("doc_id", XR.strip_html(F.col("text")).alias("plain")))
_FRONT = r"""regexp_extract(text, '^\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)', 1, 's')"""
_at = lambda k: rf"""nullif(regexp_replace(trim(regexp_extract(fm, '(?m)^{k}:[ \t]*(.*?)[ \t]*\r?$', 1), ' '), '^["'']|["'']$', '', 'g'), '')"""
query("markdown_titles", rf"""WITH d AS (SELECT doc_id, {_FRONT} AS fm, regexp_replace(text, '^\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)', '', 's') AS body FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, coalesce({_at('title')}, nullif(regexp_extract(body, '(?m)^[ \t]*# +(\S.*?)[ \t]*\r?$', 1), ''), CAST(doc_id AS VARCHAR)) AS title, {_at('author')} AS author,
  regexp_replace(coalesce({_at('tags')}, ''), '^\[|\]$', '', 'g') AS tags FROM d""", False)(lambda s, d: XR.markdown_titles(_docs(s, d)))
# people by their first names, as the notes mention them
query("refs_resolved", r""", r AS (SELECT doc_id, 'wikilink' AS kind, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS target FROM documents UNION SELECT doc_id, 'mention', unnest(regexp_extract_all(text, '@([a-zA-Z_][a-zA-Z0-9_]*)', 1)) FROM documents)
SELECT DISTINCT doc_id, kind, target, e.id AS entity_id FROM r JOIN (SELECT lower(regexp_extract(title, '^(\S+)', 1)) AS k, min(id) AS id FROM flat GROUP BY 1) e ON e.k = lower(target)""")(
    lambda m: XR.resolved_refs(XR.markdown_refs(m.raw("documents")), m.flat.withColumn("title", F.regexp_extract("title", r"^(\S+)", 1)), m.edges)
)
_REFS = r""", r AS (SELECT doc_id, 'wikilink' AS kind, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS target FROM documents UNION SELECT doc_id, 'mention', unnest(regexp_extract_all(text, '@([a-zA-Z_][a-zA-Z0-9_]*)', 1)) FROM documents),
l AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 2)) AS target FROM documents)
"""
query("refs_contained", _REFS + "SELECT r.doc_id, r.kind, r.target, min(f.id) AS entity_id FROM r JOIN flat f ON contains(lower(f.title), lower(r.target)) WHERE regexp_matches(lower(f.title), '(^|[^\\p{L}\\p{N}])' || lower(regexp_extract(r.target, '([\\p{L}\\p{N}]+)', 1)) || '($|[^\\p{L}\\p{N}])') GROUP BY 1, 2, 3")(lambda m: XR.contained_refs(XR.markdown_refs(m.raw("documents")), m.flat))
query("content_hash_classes", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1", False)(
    lambda s, d: _docs(s, d).filter("text is not null").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1")
)
query("db_rows_as_entities", "SELECT 'customer:' || c_custkey AS id, 'DatabaseRecord' AS entity_type, CAST(c_custkey AS VARCHAR) AS title FROM customer", False)(
    lambda s, d: FS.rows_as_entities(s.read.parquet(f"{d}/customer.parquet"), "c_custkey", "customer").select("id", "entity_type", "title")
)
query("mapped_import", "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, unnest(['Title', 'Tags']) AS component_type, unnest([CAST(to_json(p_name) AS VARCHAR), CAST(to_json(string_split(p_type, ' ')) AS VARCHAR)]) AS data FROM part", False)(
    lambda s, d: FS.mapped(s.read.parquet(f"{d}/part.parquet"), {"p_name": ("Title",), "p_type": ("Tags", " ")}, key=F.col("p_partkey").cast("string")).select("entity_id", "component_type", "data")
)
query("archive_filter", "SELECT id FROM ent WHERE NOT is_active")(lambda m: m.entities.filter(~F.col("is_active")).select("id"))
query("hierarchical_counts", "SELECT relationship_type, count(*) AS n, count(DISTINCT source_id) AS sources FROM edge GROUP BY 1")(lambda m: m.edges.groupBy("relationship_type").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources")))
