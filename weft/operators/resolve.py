"""Entity resolution.

Equal and normalised-equal titles are classes, found by grouping: one row per entity with its
class's least id, no pairs. Near titles are searched among class representatives only: all pairs
of a type are compared in tiles by an upper bound of the similarity from the letters two titles
have in common, and those it admits are scored, so no pair is lost and copies never meet in pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import similarity as X
from weft.functions.keys import entity_key

AUTO, REVIEW, THRESHOLD, COMPOSITE = 0.92, 0.78, 0.95, 0.78
#: Titles on a side of a tile, and of a step within one.
TILE, STEP = 4_096, 512


def titled(flat: DataFrame) -> DataFrame:
    """(id, entity_type, title, norm, content, lang, size, day) of active entities with a title."""
    day = F.date_format("happened_at", "yyyy-MM-dd")
    return flat.filter("title != 'Untitled'").select("id", "entity_type", "title", X.normalize_title(F.col("title")).alias("norm"), "content", F.col("lang_code").alias("lang"), F.col("size_bytes").alias("size"), day.alias("day"))


def classes(t: DataFrame, key: str) -> DataFrame:
    """R02 (key title, confidence 1) and R03 (key norm, 0.95): (id, canonical_id, confidence)."""
    groups = t.groupBy("entity_type", key).agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1")
    return t.join(groups, ["entity_type", key]).filter("id != canonical_id").select("id", "canonical_id", F.lit(1.0 if key == "title" else 0.95).alias("confidence"))


def _letters(titles: list[str]) -> tuple[np.ndarray, ...]:
    """Counts of letters (those of equal code modulo 32 as one), lengths in characters and bytes, first four characters."""
    bags, first = np.zeros((len(titles), 32), np.uint16), np.full((len(titles), 4), -1)
    for k, t in enumerate(titles):
        codes = np.fromiter(map(ord, t), np.int64, len(t))
        bags[k] = np.minimum(np.bincount(codes % 32, minlength=32), 65_535)
        first[k, : min(4, len(t))] = codes[:4]
    return bags, np.array([len(t) for t in titles], float), np.array([len(t.encode()) for t in titles], float), first


def similarity_bound(x: tuple, y: tuple) -> np.ndarray:
    """At least the better of Jaro-Winkler and Levenshtein similarity of each title of x with each of y.

    With c letters in common at most c characters match, and at least the longer length less c are edited."""
    (bx, lx, ox, fx), (by, ly, oy, fy) = x, y
    c = np.zeros((len(lx), len(ly)))
    for k in range(bx.shape[1]):
        c += np.minimum(bx[:, k, None], by[None, :, k])
    # a bag holds at most 65,535 of a letter: longer titles are bounded by their lengths alone
    c = np.where(np.maximum(lx[:, None], ly) > 65_535, np.minimum(lx[:, None], ly), c)
    jaro = np.where(c > 0, (c / lx[:, None] + c / ly + 1) / 3, 0.0)
    prefix = np.cumprod((fx[:, None] == fy) & (fx[:, None] >= 0), axis=2).sum(2)
    winkler = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return np.maximum(winkler, 1 - (np.maximum(lx[:, None], ly) - c) / np.maximum(ox[:, None], oy))


def _admitted(threshold: float, thresholds: dict[str, float]) -> Callable:
    """The pairs of one tile that may reach the threshold."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kind, i, j = g["entity_type"].iloc[0], g["i"].iloc[0], g["j"].iloc[0]
        rows, columns = ([t for t, n in zip(g["norm"], g["own"], strict=True) if n == side] for side in (i, j))
        least = thresholds.get(kind, threshold) - 1e-9
        a, b = [], []
        for p in range(0, len(rows), STEP):
            x = _letters(rows[p : p + STEP])
            for q in range(0, len(columns), STEP):
                for m, n in np.argwhere(similarity_bound(x, _letters(columns[q : q + STEP])) >= least):
                    s, t = rows[p + m], columns[q + n]
                    if s != t and (i != j or s < t):
                        a.append(min(s, t))
                        b.append(max(s, t))
        return pd.DataFrame({"entity_type": np.full(len(a), kind, object), "a": np.array(a, object), "b": np.array(b, object)})

    return run


def near_titles(t: DataFrame, threshold: float = THRESHOLD, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(entity_type, a, b, confidence) of distinct normalised titles, a < b, both of
    at least 10 bytes, whose better of Jaro-Winkler and Levenshtein similarity reaches the threshold."""
    d = t.select("entity_type", "norm").filter((F.octet_length("norm") >= 10) & F.col("entity_type").isNotNull()).distinct()
    sizes = d.groupBy("entity_type").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # a row per type
    d = d.join(F.broadcast(sizes), "entity_type").withColumn("own", F.pmod(F.xxhash64("norm"), F.col("tiles")).cast("int"))
    other = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = other.select("entity_type", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "norm")
    pairs = tiled.groupBy("entity_type", "i", "j").applyInPandas(_admitted(threshold, thresholds or {}), "entity_type string, a string, b string")
    score = F.greatest(X.jaro_winkler_udf("a", "b"), X.levenshtein_similarity(F.col("a"), F.col("b")))
    least = F.lit(threshold)
    for k, v in (thresholds or {}).items():
        least = F.when(F.col("entity_type") == k, v).otherwise(least)
    return pairs.withColumn("confidence", score).filter(F.col("confidence") >= least)


def content_matches(t: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (id, canonical_id) whose contents' words overlap by at least the threshold; none where one is missing."""
    side = lambda p, c: t.filter("content is not null and content != ''").select(F.col("id").alias(p), X.words(F.col("content")).alias(c))
    score = X.jaccard(F.col("x"), F.col("y"))
    return pairs.select("id", "canonical_id").join(side("id", "x"), "id").join(side("canonical_id", "y"), "canonical_id").select("id", "canonical_id", score.alias("confidence")).filter(F.col("confidence") >= threshold)


def candidates(t: DataFrame, threshold: float = THRESHOLD, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(id, canonical_id, confidence, strategy): per entity the first strategy of exact,
    normalized and fuzzy with a hit, of its hits the best, then the least id."""
    exact = classes(t, "title").withColumn("strategy", F.lit("exact")).withColumn("rank", F.lit(0))
    norm = classes(t, "norm").withColumn("strategy", F.lit("normalized")).withColumn("rank", F.lit(1))
    reps = t.groupBy("entity_type", "norm").agg(F.min("id").alias("id"))
    near = near_titles(t, threshold, thresholds)
    a = reps.select("entity_type", F.col("norm").alias("a"), F.col("id").alias("ia"))
    b = reps.select("entity_type", F.col("norm").alias("b"), F.col("id").alias("ib"))
    both = near.join(a, ["entity_type", "a"]).join(b, ["entity_type", "b"])
    fuzzy = both.select(F.greatest("ia", "ib").alias("id"), F.least("ia", "ib").alias("canonical_id"), "confidence", F.lit("fuzzy").alias("strategy"), F.lit(2).alias("rank"))
    w = W.partitionBy("id").orderBy("rank", F.desc("confidence"), "canonical_id")
    every = exact.unionByName(norm).unionByName(fuzzy)
    return every.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "canonical_id", "confidence", "strategy")


def composite_scores(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sub-scores and composite of given pairs (id, canonical_id); t may have a number of pages."""
    t = t if "pages" in t.columns else t.withColumn("pages", F.lit(None).cast("bigint"))
    side = lambda p: t.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "norm", "content", "lang", "size", "day", "pages")])
    rows = pairs.select("id", "canonical_id").join(side("a"), F.col("id") == F.col("a_id")).join(side("b"), F.col("canonical_id") == F.col("b_id"))
    title = F.when(F.col("a_norm") == F.col("b_norm"), 1.0).otherwise(X.jaro_winkler_udf("a_norm", "b_norm"))
    missing = F.coalesce(F.col("a_content"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("b_content"), F.lit("")).eqNullSafe("")
    content = F.when(missing, 0.5).otherwise(X.jaccard(X.words(F.col("a_content")), X.words(F.col("b_content"))))
    pair = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    rows = rows.withColumn("title_score", title).withColumn("content_score", content).withColumn("metadata_score", X.metadata_overlap(pair("lang"), pair("size"), pair("day")))
    score = X.composite(F.col("title_score"), F.col("content_score"), F.col("metadata_score"), X.structural(F.col("a_pages"), F.col("b_pages")))
    return rows.select("id", "canonical_id", "title_score", "content_score", "metadata_score", score.alias("confidence"))


def decision(title: Column, confidence: Column, auto: float = AUTO, review: float = REVIEW) -> Column:
    """Merge, review or create."""
    return F.when((title == 1) | (confidence >= auto), "merge").when(confidence >= review, "review").otherwise("create")


def merged(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges rewired to canonical ids (mapping: id, canonical_id), self-links and repeats dropped."""
    s = mapping.select(F.col("id").alias("source_id"), F.col("canonical_id").alias("cs"))
    t = mapping.select(F.col("id").alias("target_id"), F.col("canonical_id").alias("ct"))
    out = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    out = out.select(F.coalesce("cs", "source_id").alias("source_id"), F.coalesce("ct", "target_id").alias("target_id"), "relationship_type")
    return out.filter("source_id != target_id").distinct()


def moved_components(components: DataFrame, mapping: DataFrame) -> DataFrame:
    """Components under the canonical entity."""
    m = mapping.select(F.col("id").alias("entity_id"), "canonical_id")
    return components.join(m, "entity_id", "left").withColumn("entity_id", F.coalesce("canonical_id", "entity_id")).drop("canonical_id")


_PART = "array<struct<id:string,component_type:string,data:string>>"
_EDGE = "array<struct<source_id:string,target_id:string,relationship_type:string>>"


def audit(mapping: DataFrame, components: DataFrame, at: str, strategy: str = "merge", edges: DataFrame | None = None) -> DataFrame:
    """A log row per merge with a snapshot of both sides' components and of the merged one's outgoing edges."""
    ids = mapping.select(F.explode(F.array("id", "canonical_id")).alias("entity_id")).distinct()
    c = components.join(ids, "entity_id", "left_semi").groupBy("entity_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "component_type", "data")))).alias("s"))
    both = mapping.join(c.select(F.col("entity_id").alias("id"), F.col("s").alias("sa")), "id", "left").join(c.select(F.col("entity_id").alias("canonical_id"), F.col("s").alias("sb")), "canonical_id", "left")
    if edges is None:
        both = both.withColumn("ea", F.lit(None).cast("string"))
    else:
        e = edges.join(mapping.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        e = e.groupBy(F.col("source_id").alias("id")).agg(F.to_json(F.sort_array(F.collect_set(F.struct("source_id", "target_id", "relationship_type")))).alias("ea"))
        both = both.join(e, "id", "left")
    return both.select(
        F.sha2(F.concat_ws("|", "id", "canonical_id"), 256).alias("id"), F.col("id").alias("source_id"), F.col("canonical_id").alias("target_id"), F.lit(strategy).alias("strategy"),
        "confidence", F.lit(at).cast("timestamp").alias("logged_at"), F.to_json(F.struct("sa", "sb", "ea")).alias("snapshot"),
    )


def undone(log: DataFrame, merge_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components of both sides as they were, outgoing edges of the merged one, the log without the merge)."""
    snap = log.filter(F.col("id") == merge_id).select("source_id", "target_id", F.from_json("snapshot", "struct<sa:string,sb:string,ea:string>").alias("s"))
    sides = [snap.select(F.col(own).alias("entity_id"), F.explode(F.from_json(f"s.{part}", _PART)).alias("c")) for own, part in (("source_id", "sa"), ("target_id", "sb"))]
    back = sides[0].unionByName(sides[1]).select("c.id", "entity_id", "c.component_type", "c.data")
    return back, snap.select(F.explode(F.from_json("s.ea", _EDGE)).alias("e")).select("e.*"), log.filter(F.col("id") != merge_id)


def import_merged(entities: DataFrame, components: DataFrame, incoming: DataFrame, mapping: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Imported entities that match one that is there (mapping: id of the import, canonical_id, confidence) replace
    all its components and raise its version. (entities, components, events, log rows)."""
    m = mapping.select(F.col("id").alias("entity_id"), "canonical_id")
    new = incoming.join(m, "entity_id").drop("entity_id").withColumnRenamed("canonical_id", "entity_id")
    hit = new.select("entity_id").distinct()
    kept = components.join(hit, "entity_id", "left_anti").unionByName(new.select(*components.columns))
    raised = entities.join(hit.select(F.col("entity_id").alias("id"), F.lit(True).alias("hit")), "id", "left")
    raised = raised.withColumn("version", F.col("version") + F.col("hit").isNotNull().cast("int")).withColumn("updated_at", F.when(F.col("hit"), F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))).drop("hit")
    when = F.lit(at).cast("timestamp")
    events = hit.select(F.sha2(F.concat_ws("|", "entity_id", F.lit("EntityUpdated"), F.lit(at)), 256).alias("id"), F.lit("EntityUpdated").alias("event_type"), "entity_id", when.alias("timestamp"), F.lit("{}").alias("data"))
    return raised.select(*entities.columns), kept, events, audit(mapping, components.unionByName(incoming.select(*components.columns)), at, "import")


def history(log: DataFrame, entity: str | None = None) -> DataFrame:
    """Newest first."""
    rows = log if entity is None else log.filter((entity_key(F.col("source_id")) == entity) | (entity_key(F.col("target_id")) == entity))
    return rows.orderBy(F.desc("logged_at"), "id")
