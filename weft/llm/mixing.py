"""Problem 9: sources mixed to target weights.

Equal texts are one document, under the least doc_id of them, and documents are aggregated by
membership pattern: the target sources that hold a copy of the text. A min-cost flow routes the patterns' tokens to the sources' quotas; every pass over a
pattern is an arc of its tokens whose cost grows with the pass, so repeating is convexly dearer
and no document is used more than max_repeats times. Each pass of a pattern is then cut into
intervals of its tokens, one per source, and documents are taken by a seeded order: their
place on the token axis is a prefix sum over hash buckets, made without sorting a pattern
in one task.

Defined results: sources compare without case and outer blanks; documents of other sources,
without source, without doc_id or without tokens are not used; a target without documents or with
too few is filled as far as max_repeats allows and the shortfall reported, nothing is put in its
place; a target with null or negative share or no repeats gets nothing; of repeated rows of a doc_id one counts, and
copies of a text share its max_repeats; empty tables give no documents; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.tokens import TOKENIZER, with_token_counts
from weft.session import cut, spread, table

SEED = 13
#: Documents of one hash bucket of the prefix sums, about.
PER_BUCKET = 20_000


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Min-cost maximum flow by successive shortest paths (Bellman-Ford), whole numbers."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> _Arc:
        out = _Arc(b, room, cost, len(self.arcs[b]))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a])))
        self.arcs[a].append(out)
        return out

    def run(self, s: int, t: int) -> None:
        while True:
            far: list = [None] * len(self.arcs)
            far[s], came, queue = 0, {}, [s]
            while queue:
                step = []
                for a in queue:
                    for k, e in enumerate(self.arcs[a]):
                        if e.room and (far[e.to] is None or far[a] + e.cost < far[e.to]):
                            far[e.to], came[e.to] = far[a] + e.cost, (a, k)
                            step.append(e.to)
                queue = list(dict.fromkeys(step))
            if far[t] is None:
                return
            path, at = [], t
            while at != s:
                a, k = came[at]
                path.append(self.arcs[a][k])
                at = a
            push = min(e.room for e in path)
            for e in path:
                e.room -= push
                self.arcs[e.to][e.back].room += push


def plan(patterns: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[tuple]:
    """(pattern, pass, source, from, to): token intervals of the patterns' passes.

    patterns: tokens by pattern (its sources joined by newlines); targets: share and repeats by
    source; total: tokens of the mixture, the patterns' tokens if None."""
    total = sum(patterns.values()) if total is None else total
    ps, ss = sorted(patterns), sorted(s for s, (share, most) in targets.items() if share and share > 0 and most and most > 0)
    passes = [(p, r) for p in ps for r in range(1, max([targets[s][1] for s in ss if s in p.split("\n")], default=0) + 1)]
    flow = Flow(2 + len(passes) + len(ss))
    place = {s: 2 + len(passes) + k for k, s in enumerate(ss)}
    used = []
    for k, (p, r) in enumerate(passes):
        flow.arc(0, 2 + k, patterns[p], 0)
        for s in ss:
            if s in p.split("\n") and r <= targets[s][1]:
                used.append((p, r, s, patterns[p], flow.arc(2 + k, place[s], patterns[p], r - 1)))
    for s in ss:
        flow.arc(place[s], 1, int(targets[s][0] * total), 0)
    flow.run(0, 1)
    out, at = [], {}
    for p, r, s, room, e in used:
        if n := room - e.room:
            a = at.get((p, r), 0)
            out.append((p, r, s, a, a + n))
            at[p, r] = a + n
    return out


def usable(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, pattern) for each different text of a target source that has tokens."""
    wanted = targets.select(source_key(F.col("source")).alias("source")).filter("source is not null").distinct()
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("doc_id is not null and source is not null and text is not null")
    rows = spread(rows).join(F.broadcast(wanted), "source", "left_semi")  # the targets: a small fixed table
    counted = with_token_counts(rows.withColumn("h", F.sha2("text", 256)), tokenizer=tokenizer).filter("n_tokens > 0")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("h", "source", "n_tokens")).alias("d")).select("doc_id", "d.*")
    # a set of at most as many sources as there are targets, whatever the number of copies
    pattern = F.array_join(F.sort_array(F.collect_set("source")), "\n").alias("pattern")
    return one.groupBy("h", "n_tokens").agg(F.min("doc_id").alias("doc_id"), pattern).select("doc_id", "n_tokens", "pattern")


def _place(docs: DataFrame, seed: int) -> DataFrame:
    """docs with the token at which each begins in the seeded order of its pattern."""
    n = docs.count()
    buckets = max(1, n // PER_BUCKET)
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    keyed = docs.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("t")
    within = F.sum("n_tokens").over(W.partitionBy("pattern", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return keyed.withColumn("within", within).join(sums.select("pattern", "bucket", before.alias("before")), ["pattern", "bucket"]).withColumn("begins", F.col("before") + F.col("within")).drop("within", "before", "bucket", "h")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(source_key(F.col("source")).alias("s"), F.col("target_share").alias("w"), F.col("max_repeats").alias("m")).filter("s is not null")
    return {r["s"]: (r["w"] or 0.0, r["m"] or 0) for r in rows.groupBy("s").agg(F.max("w").alias("w"), F.max("m").alias("m")).collect()}


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, uses, n_tokens): how often each chosen document stands for a source."""
    return mixed(cut(usable(documents, targets, tokenizer)), targets, total, seed)


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """mixture of the documents that usable gives."""
    spark = docs.sparkSession
    sums = {r["pattern"]: r["t"] for r in docs.groupBy("pattern").agg(F.sum("n_tokens").alias("t")).collect()}
    parts = plan(sums, _targets(targets), total)
    spans = spark.createDataFrame(parts, "pattern string, pass int, target string, a bigint, b bigint")
    # a row per pattern, pass and source: as many as the targets allow, whatever the documents
    taken = _place(docs, seed).join(F.broadcast(spans), "pattern").filter("begins + n_tokens div 2 >= a and begins + n_tokens div 2 < b")
    return taken.groupBy("doc_id", F.col("target").alias("source")).agg(F.count("*").cast("int").alias("uses"), F.max("n_tokens").alias("n_tokens"))


def shares(chosen: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """(source, target_share, quota, documents, tokens, shortfall, actual_share, most_uses) of a mixture
    meant to have `total` tokens: quota is the source's share of them, shortfall what it lacks of
    it, and actual_share its part of the tokens reached."""
    spark = chosen.sparkSession
    by = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    every = spark.createDataFrame([(s, float(w), int(max(w, 0.0) * total)) for s, (w, _) in sorted(_targets(targets).items())], "source string, target_share double, quota bigint")
    whole = by.agg(F.sum("tokens").alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.join(by, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "quota", zero("documents").alias("documents"), zero("tokens").alias("tokens"), F.greatest(F.col("quota") - zero("tokens"), F.lit(0)).alias("shortfall"),
        F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), zero("most_uses").alias("most_uses"),
    )


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _reported(spark: SparkSession, d: str) -> tuple:
    targets = table(spark, d, "mix_targets")
    docs = cut(usable(table(spark, d, "documents"), targets))
    chosen = cut(mixed(docs, targets))
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return targets, docs, chosen, shares(chosen, targets, total)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _reported(spark, d)[3]


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mixture keeps its rules, per target: repeats within the cap, tokens within the quota
    (but for part of a document at the ends of each interval), every document held by the source,
    and a shortfall only if what the source alone holds is used up."""
    targets, docs, chosen, report = _reported(spark, d)
    caps = targets.select(source_key(F.col("source")).alias("source"), "max_repeats")
    has = F.array_contains(F.split("pattern", "\n"), F.col("source"))
    own = docs.filter(~F.contains("pattern", F.lit("\n"))).groupBy(F.col("pattern").alias("source")).agg(F.sum("n_tokens").alias("held"), F.max("n_tokens").alias("largest"))
    foreign = chosen.join(docs.select("doc_id", "pattern"), "doc_id").groupBy("source").agg(F.count_if(~has).alias("foreign"), F.max("n_tokens").alias("most"))
    rows = report.join(caps, "source").join(own, "source", "left").join(foreign, "source", "left")
    slack = F.coalesce(F.greatest("largest", "most"), F.lit(0)) * (F.col("max_repeats") + 1)
    scarce = F.least("quota", F.coalesce(F.col("held"), F.lit(0)) * F.col("max_repeats"))
    return rows.select(
        "source", "target_share", "max_repeats", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), (F.col("tokens") <= F.col("quota") + slack).alias("within_quota"),
        (F.coalesce("foreign", F.lit(0)) == 0).alias("held_by_source"), (F.col("tokens") + slack >= scarce).alias("used_up"),
    )


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_rules": p9_rules}
ORACLES = {
    "p9_rules": r"""SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, target_share, max_repeats, true AS within_repeats, true AS within_quota,
      true AS held_by_source, true AS used_up FROM mix_targets""",
}
