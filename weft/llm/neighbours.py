"""Problem 6: the most similar vectors for every vector.

An inverted file: unit vectors are assigned to coarse centroids and stored there with
product-quantised residuals. Each query visits its nearest lists, scores their codes
asymmetrically (exact query against quantised vector), and the best, `rerank` for each list visited, are
scored exactly from the stored vectors. How many lists are visited is measured for each model: ASKED
vectors are compared with all others, and as many lists are visited as hold the share COVER of
their true neighbours, at least `probes`. Lists share bins of about BLOCK vectors, near lists the same
bin, so a query is sent once to each of a few bins, where it meets only the lists it visits. Centroids and codebooks are fitted on a
sample of at most SAMPLE vectors per model and about SAMPLES of all models; every vector is indexed and every vector is
a query. Long bins are cut into blocks and their queries into chunks, so a task holds at most
BLOCK vectors and CHUNK queries however uneven the lists are. Exact copies are indexed once and
expanded afterwards, without forming all pairs of a group.

Defined results: of one (entity, model) the row with the latest created_at counts, of equal
times the larger vector; vectors of different lengths are not compared; it is left out if model or vector is null, the length differs from dimensions, or it is all
zero or not finite; entity ids are compared in canonical form; of equal similarities the
smaller entity id comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions.keys import entity_key
from weft.session import cut, table

K, MIN_COSINE = 5, 0.80
#: Most vectors of a model that the index is fitted on (and of all models, about), and most lists and codes of it.
SAMPLE, SAMPLES, LISTS, CODES, PARTS = 32_768, 1 << 18, 4_096, 256, 8
PROBES, RERANK, BLOCK, CHUNK = 10, 48, 16_384, 32_768
#: Queries a model that the number of lists to visit is measured with, and the share of their true neighbours in these lists.
ASKED, COVER = 512, 0.97


@dataclass
class Index:
    """Coarse centroids (lists x d), residual codebooks (parts x codes x d/parts) and the bin of each list."""

    centroids: np.ndarray
    books: np.ndarray
    bins: np.ndarray


def usable(rows: DataFrame) -> DataFrame:
    """(model, entity_id, vector): the row that counts of each entity and model, if it can be compared."""
    key = F.col("vector").isNotNull() & (F.size("vector") == F.col("dimensions"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    at = F.max(F.struct(F.col("created_at"), "vector", "dimensions")).alias("r")
    latest = rows.filter("model is not null").groupBy("model", entity_key(F.col("entity_id")).alias("entity_id")).agg(at)
    return latest.filter("entity_id is not null").select("model", "entity_id", "r.vector", "r.dimensions").filter(key).filter(finite).drop("dimensions")


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        c[own[order][starts]] = np.add.reduceat(x[order], starts, axis=0) / n[own[order][starts], None]
        gone = np.flatnonzero(n == 0)
        c[gone] = x[rng.integers(0, len(x), len(gone))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def _in_line(c: np.ndarray) -> np.ndarray:
    """An order in which near centroids mostly stand next to each other: halves along the main axis, again and again."""
    if len(c) <= 2:
        return np.arange(len(c))
    rest = c - c.mean(0)
    axis = rest[np.argmax((rest**2).sum(1))]
    for _ in range(8):
        axis = rest.T @ (rest @ axis)
        axis /= np.linalg.norm(axis) or 1.0
    order = np.argsort(rest @ axis, kind="stable")
    a, b = order[: len(order) // 2], order[len(order) // 2 :]
    return np.r_[a[_in_line(c[a])], b[_in_line(c[b])]]


def fit(x: np.ndarray, total: int, seed: int = 7) -> Index:
    """An index for `total` vectors from the sample x."""
    lists = int(np.clip(np.sqrt(total), 1, min(LISTS, max(1, len(x) // 8))))
    c = _kmeans(x, lists, 8, seed)
    c = c[_in_line(c)]
    own = _nearest(x, c)
    rest = x - c[own]
    size = np.bincount(own, minlength=len(c)) * (total / len(x))
    d = x.shape[1]
    parts = next(p for p in range(min(PARTS, d), 0, -1) if d % p == 0)
    books = np.stack([_kmeans(np.ascontiguousarray(rest[:, p * d // parts : (p + 1) * d // parts]), min(CODES, len(x)), 6, seed + p) for p in range(parts)])
    return Index(c, books, ((np.cumsum(size) - size / 2) / BLOCK).astype("int32"))


def _encode(x: np.ndarray, own: np.ndarray, ix: Index) -> np.ndarray:
    rest = x - ix.centroids[own]
    w = ix.books.shape[2]
    return np.stack([_nearest(rest[:, p * w : (p + 1) * w], b) for p, b in enumerate(ix.books)], axis=1).astype(np.uint8)


def _decoded(codes: np.ndarray, own: np.ndarray, ix: Index) -> np.ndarray:
    """The vectors that codes stand for: an inner product with one is the asymmetric score."""
    return ix.centroids[own] + np.concatenate([b[codes[:, p]] for p, b in enumerate(ix.books)], axis=1)


def _near(x: np.ndarray, ix: Index) -> np.ndarray:
    return x @ ix.centroids.T - (ix.centroids**2).sum(1) / 2


def _cuts(ix: Index, x: np.ndarray, total: int, probes: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the blocks its vectors and the chunks its queries are cut into, by the sample x
    of the total; few bins get more chunks, of at least 2,048 queries, so that there is work for `tasks`."""
    near = _near(x, ix)
    k = min(probes, near.shape[1])
    visit = np.zeros((len(x), int(ix.bins.max()) + 1), bool)
    visit[np.arange(len(x))[:, None], ix.bins[np.argpartition(-near, k - 1, axis=1)[:, :k]]] = True
    held = np.bincount(ix.bins[near.argmax(1)], minlength=visit.shape[1])
    share = total / len(x)
    asked = visit.sum(0) * share
    chunks = np.maximum(np.ceil(asked / (1.3 * CHUNK)), np.minimum(np.ceil(tasks / len(held)), asked // 2_048))
    return np.maximum(1, np.ceil(held * share / (1.3 * BLOCK))).astype(int), np.maximum(1, chunks).astype(int)


def _assign(indexes: dict, probes: dict, cuts: dict):
    """Rows of the search's groups (bin, block i of its vectors, chunk j of its queries): a vector
    stands once for each chunk, a query once for each block of each bin it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ixs = indexes.value
        for b in batches:
            for model, g in b.groupby("model", sort=False):
                ix = ixs[model]
                x = _unit(g["vector"])
                near = _near(x, ix)
                k = min(probes[model], near.shape[1])
                own = near.argmax(1).astype("int32")
                visit = np.argpartition(-near, k - 1, axis=1)[:, :k].astype("int32")
                codes = _encode(x, own, ix)
                ids = g["entity_id"].to_numpy()
                raw = np.array([r.tobytes() for r in x], dtype=object)
                h = pd.util.hash_array(ids)
                blocks, chunks = cuts[model]
                of = ix.bins[own]
                at = np.repeat(np.arange(len(x)), chunks[of])
                j = np.arange(len(at)) - np.repeat(np.cumsum(chunks[of]) - chunks[of], chunks[of])
                own_ = np.array([o.tobytes() for o in own], dtype=object)
                codes_ = np.array([c.tobytes() for c in codes], dtype=object)
                yield pd.DataFrame({"model": model, "bin": of[at], "i": (h % blocks[of].astype(np.uint64))[at].astype("int32"), "j": j.astype("int32"), "base": True, "entity_id": ids[at], "x": raw[at], "lists": own_[at], "codes": codes_[at]})
                for n in np.unique(ix.bins):
                    inside = ix.bins[visit] == n
                    at = np.flatnonzero(inside.any(1))
                    lists = [visit[i, inside[i]].tobytes() for i in at]
                    for i in range(blocks[n]):
                        yield pd.DataFrame({"model": model, "bin": n, "i": i, "j": (h[at] % np.uint64(chunks[n])).astype("int32"), "base": False, "entity_id": ids[at], "x": raw[at], "lists": lists, "codes": None})

    return run


def _search(indexes: dict, k: int, least: float, rerank: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        model = g["model"].iloc[0]
        base, query = g[g["base"]], g[~g["base"]]
        if base.empty or query.empty:
            return pd.DataFrame({"model": np.array([], object), "q": np.array([], object), "c": np.array([], object), "cosine": np.array([], float)})
        ix = indexes.value[model]
        x = np.frombuffer(b"".join(base["x"]), np.float32).reshape(len(base), -1)
        codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
        own = np.frombuffer(b"".join(base["lists"]), np.int32)
        q = np.frombuffer(b"".join(query["x"]), np.float32).reshape(len(query), -1)
        names, qn = base["entity_id"].to_numpy(), query["entity_id"].to_numpy()
        order = np.argsort(own, kind="stable")
        x, names, own = x[order], names[order], own[order]
        decoded = _decoded(codes[order], own, ix)
        at_name = {n: i for i, n in enumerate(names)}
        self_ = np.array([at_name.get(n, -1) for n in qn])
        # by list: its stretch of x and the queries that visit it
        ql = np.frombuffer(b"".join(query["lists"]), np.int32)
        qi = np.repeat(np.arange(len(query)), query["lists"].str.len() // 4)[np.argsort(ql, kind="stable")]
        here, begin = np.unique(np.sort(ql), return_index=True)
        keep = 8 * k
        score, place = np.full((len(q), keep), -2, np.float32), np.zeros((len(q), keep), np.int64)
        for n, visitors in zip(here, np.split(qi, begin[1:]), strict=True):
            lo, hi = np.searchsorted(own, [n, n + 1])
            if lo == hi:
                continue
            step = max(1, 4_000_000 // (hi - lo))
            for v in np.split(visitors, range(step, len(visitors), step)):
                part = q[v]
                s = part @ x[lo:hi].T
                top = np.broadcast_to(np.arange(hi - lo), s.shape)
                if hi - lo > rerank:
                    # the best by their codes, these exactly in single precision
                    top = np.argpartition(-(part @ decoded[lo:hi].T), rerank - 1, axis=1)[:, :rerank]
                    s = np.take_along_axis(s, top, 1)
                top = top + lo
                s[top == self_[v, None]] = -2
                s, top = np.hstack([score[v], s]), np.hstack([place[v], top])
                best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                score[v], place[v] = np.take_along_axis(s, best, 1), np.take_along_axis(top, best, 1)
        # the best of these in double precision
        rank = np.argsort(np.argsort(names))
        out = []
        step = 1 + 4_000_000 // (keep * q.shape[1])
        for i in range(0, len(q), step):
            top = place[i : i + step]
            exact = np.einsum("qrd,qd->qr", x[top].astype(np.float64), q[i : i + step].astype(np.float64))
            exact[score[i : i + step] <= -2] = -2
            order = np.lexsort((rank[top], -exact), axis=1)[:, :k]
            e = np.take_along_axis(exact, order, 1)
            at, of = np.nonzero(e >= max(least, -1.5))
            out.append(pd.DataFrame({"q": qn[i + at], "c": names[top[at, order[at, of]]], "cosine": e[at, of]}))
        res = pd.concat(out)
        res.insert(0, "model", model)
        return res

    return run


def _fitted(points: DataFrame, counts: dict) -> tuple[dict, dict, dict]:
    """Model to Index, from a sample by hash of the id of at most SAMPLE vectors a model; model to
    (ids, vectors) of at most ASKED of these; model to the sample."""
    most = max(64, min(SAMPLE, SAMPLES // len(counts)))
    share = points.sparkSession.createDataFrame([(m, min(1.0, 0.95 * most / n)) for m, n in counts.items()], "model string, share double")
    pick = F.pmod(F.xxhash64("entity_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003
    sample = points.join(F.broadcast(share), "model").filter(pick).select("model", "entity_id", "vector").toArrow().to_pandas()  # a row per model
    taken = {m: _unit(g["vector"])[:most] for m, g in sample.groupby("model")}
    few = {m: g.sample(min(ASKED, len(g)), random_state=7) for m, g in sample.groupby("model")}
    return {m: fit(x, counts[m]) for m, x in taken.items()}, {m: (g["entity_id"].to_numpy(), _unit(g["vector"])) for m, g in few.items()}, taken


def _measured(points: DataFrame, fits: dict, queries: dict, k: int, least: float, probes: int) -> dict:
    """Model to the number of lists to visit: the fewest, at least `probes`, that hold the share COVER
    of the k nearest of the queries, of those with a cosine of at least `least`."""
    shared = points.sparkSession.sparkContext.broadcast((fits, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ixs, asked = shared.value
        best: dict = {}
        for b in batches:
            for model, g in b.groupby("model", sort=False):
                x, (ids, q) = _unit(g["vector"]), asked[model]
                s = np.where(g["entity_id"].to_numpy() == ids[:, None], -2, q @ x.T)
                own = np.broadcast_to(_nearest(x, ixs[model].centroids), s.shape)
                if model in best:
                    s, own = np.hstack([best[model][0], s]), np.hstack([best[model][1], own])
                top = np.argsort(-s, axis=1)[:, :k]
                best[model] = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
        for model, (s, own) in best.items():
            yield pd.DataFrame({"model": model, "q": np.repeat(np.arange(len(s)), s.shape[1]), "list": own.ravel(), "cosine": s.ravel()})

    w = W.partitionBy("model", "q").orderBy(F.desc("cosine"))
    true = points.mapInPandas(run, "model string, q long, list long, cosine double").withColumn("rn", F.row_number().over(w))
    true = true.filter((F.col("rn") <= k) & (F.col("cosine") >= least)).toPandas()
    out = dict.fromkeys(fits, probes)
    for model, g in true.groupby("model"):
        near = _near(queries[model][1], fits[model])[g["q"].to_numpy()]
        places = (near >= np.take_along_axis(near, g["list"].to_numpy()[:, None], 1)).sum(1)
        out[model] = max(probes, int(np.quantile(places, COVER, method="inverted_cdf")))
    return out


def neighbours(rows: DataFrame, k: int = K, least: float = -1.0, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """(model, entity_id, other_id, cosine): up to k most similar others of each entity within
    its model, with a cosine of at least `least`; at least `probes` lists are visited for each."""
    spark = rows.sparkSession
    out = "model string, q string, c string, cosine double"
    # copies: members keeps each entity's group, firsts the k+1 least ids of each group
    # vectors of one model but different lengths cannot be compared: the length is part of the key
    every = usable(rows).withColumn("model", F.concat_ws("\u0001", "model", F.size("vector").cast("string")))
    every = cut(every.withColumn("h", F.xxhash64("vector")))
    w = W.partitionBy("model", "h", "vector").orderBy("entity_id")
    firsts = cut(every.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1))
    points = firsts.filter("rn = 1").select("model", "entity_id", "vector")
    counts = {r["model"]: r["count"] for r in points.groupBy("model").count().collect()}
    if not counts:
        return spark.createDataFrame([], out.replace("q string, c", "entity_id string, other_id"))
    fits, queries, sample = _fitted(points, counts)
    points = points.filter(F.col("model").isin(list(fits)))
    shared = spark.sparkContext.broadcast(fits)
    visits = _measured(points, fits, queries, k, least, probes)
    cuts = {m: _cuts(ix, sample[m], counts[m], visits[m], spark.sparkContext.defaultParallelism) for m, ix in fits.items()}
    split = points.mapInPandas(_assign(shared, visits, cuts), "model string, bin int, i int, j int, base boolean, entity_id string, x binary, lists binary, codes binary")
    found = split.groupBy("model", "bin", "i", "j").applyInPandas(_search(shared, k, least, rerank), out)
    best = W.partitionBy("model", "q").orderBy(F.desc("cosine"), "c")
    top = cut(found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn"))
    out = _expanded(every, firsts, top, k, least)
    return out.withColumn("model", F.regexp_extract("model", "(?s)^(.*)\u0001[0-9]+$", 1))


def _expanded(every: DataFrame, firsts: DataFrame, top: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours of all members from those of the groups of copies they belong to."""
    groups = ["model", "h", "vector"]
    several = firsts.filter("rn = 2").select(*groups)
    if several.isEmpty():
        return top.select("model", F.col("q").alias("entity_id"), F.col("c").alias("other_id"), "cosine")
    held = firsts.join(several, groups, "left_semi")
    reps = held.filter("rn = 1").select(*groups, F.col("entity_id").alias("rep"))
    of = held.join(reps, groups).select("model", "rep", "entity_id", "rn", F.lit(1.0).alias("one"))
    member = every.join(reps, groups).select("model", "rep", "entity_id")
    # within the group: the k least others of each member
    own = member.join(of.select("model", "rep", F.col("entity_id").alias("other_id")), ["model", "rep"]).filter("entity_id != other_id")
    own = own.select("model", "entity_id", "other_id", F.lit(1.0).alias("cosine")).filter(F.col("cosine") >= least)
    # between groups: only groups of at most k members still need others, and of each other group k
    full = of.filter(F.col("rn") > k).select("model", F.col("rep").alias("q"))
    few = of.select("model", F.col("rep").alias("q"), F.col("entity_id").alias("qm")).join(full, ["model", "q"], "left_anti")
    links = top.join(full, ["model", "q"], "left_anti").join(few, ["model", "q"], "left")
    links = links.join(of.filter(F.col("rn") <= k).select("model", F.col("rep").alias("c"), F.col("entity_id").alias("cm")), ["model", "c"], "left")
    between = links.select("model", F.coalesce("qm", "q").alias("entity_id"), F.coalesce("cm", "c").alias("other_id"), "cosine")
    w = W.partitionBy("model", "entity_id").orderBy(F.desc("cosine"), "other_id")
    return own.unionByName(between).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours(table(spark, d, "embedding_vectors"), K, MIN_COSINE)
    a, b = F.least("entity_id", "other_id"), F.greatest("entity_id", "other_id")
    return n.select("model", a.alias("entity_a"), b.alias("entity_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(table(spark, d, "embedding_vectors"))


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
_VECTORS = """
WITH v AS (SELECT * FROM (
    SELECT model, entity_id, CAST(vector AS DOUBLE[]) AS x, dimensions, row_number() OVER (PARTITION BY model, entity_id ORDER BY created_at DESC) AS rn
    FROM embedding_vectors WHERE model IS NOT NULL)
  WHERE rn = 1 AND x IS NOT NULL AND len(x) = dimensions AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND list_max(x) - list_min(x) + abs(list_max(x)) > 0),
sims AS (SELECT a.model, a.entity_id AS q, b.entity_id AS c, list_cosine_similarity(a.x, b.x) AS cosine
  FROM v a JOIN v b ON a.model = b.model AND a.dimensions = b.dimensions AND a.entity_id <> b.entity_id),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY model, q ORDER BY cosine DESC, c) <= 5)
"""
ORACLES = {"p6_found": _VECTORS + "SELECT DISTINCT model, least(q, c) AS entity_a, greatest(q, c) AS entity_b FROM top WHERE cosine >= 0.80"}
