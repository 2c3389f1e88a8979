"""Vector search, fusion and the default embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def top_k(rows: DataFrame, vector: str, query: list[float], k: int, least: float | None = None, id_: str = "id") -> DataFrame:
    """The k rows nearest to a query vector; vectors of another length are refused."""
    scored = rows.filter(F.size(vector) == len(query)).withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    return scored.drop(vector).orderBy(F.desc("score"), id_).limit(k)


def search_entities(vectors: DataFrame, entities: DataFrame, query: list[float], k: int, least: float | None = None, kind: str | None = None) -> DataFrame:
    """(id, entity_type, title, score): the k active entities nearest to a query vector, of one type if
    given; vectors are (entity_id, vector) of one model, entities (id, entity_type, title)."""
    rows = entities if kind is None else entities.filter(F.lower("entity_type") == kind.lower())
    joined = vectors.select(F.col("entity_id").alias("id"), "vector").join(rows.select("id", "entity_type", "title"), "id")
    return top_k(joined, "vector", query, k, least)


def removed(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors without those of the given entities (column entity_id; with column model only of that model)."""
    return vectors.join(keys, [c for c in ("entity_id", "model") if c in keys.columns], "left_anti")


def rebuilt(docs: DataFrame, config: str = "fold") -> DataFrame:
    """(entity_id, model, vector, dimensions, error) for every entity with content; a text that cannot be
    embedded has an error instead of a vector and keeps no other from it."""
    made = docs.filter("content is not null and content != ''").select("entity_id", F.lit(config).alias("model"), provider(config)(F.col("content")).alias("vector"))
    return made.withColumn("dimensions", F.when(F.col("vector").isNotNull(), F.size("vector"))).withColumn("error", F.when(F.col("vector").isNull(), "no vector"))


def ranked(rows: DataFrame, score: str, best_first: str = "desc") -> DataFrame:
    """0-based rank of a top-k list (small by construction)."""
    key = F.desc(score) if best_first == "desc" else F.asc(score)
    return rows.withColumn("rank", F.row_number().over(W.orderBy(key, "id")) - 1)


def fuse(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank)."""
    every = a.select("id", "rank").unionByName(b.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def hybrid(keyword: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """Fused if both lists have rows, else the keyword list alone with its own scores."""
    if vector.isEmpty() or keyword.isEmpty():
        return keyword.select("id", "score")
    return fuse(ranked(keyword, "score", "asc"), ranked(vector, "score"), k)


def fold(text: str, d: int = 64) -> np.ndarray:
    """The byte-fold embedder: bytes folded on d slots by sines, then unit length."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.float64)
    i = np.arange(len(raw))
    v = np.bincount(i % d, raw / 255.0 * np.sin(0.7 * i + 1.3 * (i % d)), minlength=d)
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def embed(c: Column, d: int = 64) -> Column:
    """The default embedding of a text column as an Arrow UDF; null for empty texts."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fold(t.encode("utf-8", "replace").decode(), d).tolist() if t else None)

    return run(c)


def _seeded(c: Column, d: int) -> Column:
    """A mock: slots from the text's hash, unit length."""
    v = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.pmod(F.xxhash64(c, i), F.lit(256)) / 255.0)
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: (x / n).cast("float"))


PROVIDERS = {"fold": embed, "mock": _seeded}


def provider(config: str = "fold"):
    """An embedder by name; 'mock://128' gives its dimensions. Network providers are not built."""
    name, _, rest = config.partition("://")
    if name not in PROVIDERS:
        raise ValueError(f"no embedder {config!r}")
    d = int(rest) if rest else 64
    return lambda c: PROVIDERS[name](c, d)
