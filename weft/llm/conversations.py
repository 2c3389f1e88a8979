"""Problem 3: conversations rebuilt from message rows.

Rows of one message id are one message. Messages are range-sorted by channel, time and id over
all partitions, so a channel of any size is spread over several tasks; each task walks its run and makes one
summary per channel, and the few summaries of a channel (one per partition it touches) are
stitched: positions by prefix sums, turns and gaps across the seam by the ends of the runs. Within a channel,
sessions split at inactivity gaps longer than a limit, which may be calibrated from the
distribution of gaps. Unknown roles can be inferred from the turn before, across seams by the last turn of the earlier runs. Sessions without
reciprocal replies are dropped.

Defined results: a message without conversation id counts nowhere; of several rows of
one message id the earliest, then the least in all fields, holds; a conversation is dropped
if it lacks its row, has no message, or holds a message without time, known role or text, or if
its turns other than system are not user, assistant alternately, ending with assistant; equal
times are ordered by id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions.keys import entity_key, enum_key, sql_enum, sql_uuid, uuid_key
from weft.session import cut, table

ROLES = {"system": 0, "user": 1, "assistant": 2}
#: Gaps longer than this many times the median gap, and than the least, begin a new session.
GAP_FACTOR, GAP_LEAST_S = 24.0, 6 * 3600.0


def role_code(role: Column) -> Column:
    """0 system, 1 user, 2 assistant, -1 anything else."""
    k = enum_key(role)
    return F.when(k == "system", 0).when(k == "user", 1).when(k == "assistant", 2).otherwise(-1).cast("int")


def messages(rows: DataFrame, text: bool = False) -> DataFrame:
    """One row per message: message_id, channel, at, role, has_text (and text)."""
    has = F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S")
    base = rows.select(
        uuid_key(F.col("id")).alias("message_id"), entity_key(F.col("conversation_id")).alias("channel"),
        F.col("created_at").alias("at"), role_code(F.col("role")).alias("role"), has.alias("has_text"), *(["text"] if text else []),
    ).filter("channel is not null and message_id is not null")
    rest = [c for c in base.columns if c != "message_id"]
    first = F.min(F.struct(F.col("at").isNull().alias("z"), "at", *[c for c in rest if c != "at"])).alias("m")
    return base.groupBy("message_id").agg(first).select("message_id", *[F.col(f"m.{c}").alias(c) for c in rest])


def _runs(gap: float) -> tuple:
    """Walks one partition's sorted run; a row per session piece with what stitching needs."""
    schema = "part int, piece long, channel string, first_at double, last_at double, n long, bad long, turns long, head int, tail int, breaks long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, piece, open_ = TaskContext.get().partitionId(), 0, None
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            done = []
            at = b["at_s"].to_numpy(float)
            for channel, t, role, ok in zip(b["channel"], at, b["role"], b["ok"], strict=True):
                if open_ is None or channel != open_["channel"] or t - open_["last_at"] > gap:
                    if open_:
                        done.append(open_)
                    open_ = {"part": part, "piece": piece, "channel": channel, "first_at": t, "last_at": t, "n": 0, "bad": 0, "turns": 0, "head": 0, "tail": 0, "breaks": 0}
                    piece += 1
                open_["n"] += 1
                open_["last_at"] = t if t == t else open_["last_at"]
                if not ok:
                    open_["bad"] += 1
                if role > 0:
                    open_["turns"] += 1
                    open_["head"] = open_["head"] or role
                    open_["breaks"] += open_["tail"] == role
                    open_["tail"] = role
            if done:
                yield pd.DataFrame(done, columns=names)
        if open_:
            yield pd.DataFrame([open_], columns=names)

    return run, schema


def ordered(msgs: DataFrame) -> DataFrame:
    """Range-sorted by channel, time and id: a large channel spans several partitions."""
    n = max(2, int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return msgs.repartitionByRange(n, "channel", "at", "message_id").sortWithinPartitions("channel", "at", "message_id")


def sessions(msgs: DataFrame, gap: float | None = None) -> DataFrame:
    """One row per session: channel, session (from 0), n, bad, turns, breaks, head, tail,
    first_at, last_at; gap in seconds splits, None keeps each channel whole.

    The window below runs over pieces, of which a channel has one per partition and session."""
    run, schema = _runs(np.inf if gap is None else gap)
    slim = ordered(msgs).select("channel", F.col("at").cast("double").alias("at_s"), "role", (F.col("at").isNotNull() & (F.col("role") >= 0) & F.col("has_text")).alias("ok"))
    pieces = cut(slim.mapInPandas(run, schema))
    w = W.partitionBy("channel").orderBy("part", "piece")
    prior = F.lag("last_at").over(w)
    new = F.when(F.lag("n").over(w).isNull(), 0).when((F.lit(gap) if gap is not None else F.lit(None).cast("double")) < F.col("first_at") - prior, 1).otherwise(0)
    numbered = pieces.withColumn("session", F.sum(new).over(w))
    ws = W.partitionBy("channel", "session").orderBy("part", "piece")
    before = F.last(F.when(F.col("tail") > 0, F.col("tail")), True).over(ws.rowsBetween(W.unboundedPreceding, -1))
    seam = F.when((F.col("head") > 0) & (before == F.col("head")), 1).otherwise(0)
    s = numbered.withColumn("seam", seam).groupBy("channel", F.col("session").cast("int").alias("session"))
    return s.agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("turns").alias("turns"), F.sum(F.col("breaks") + F.col("seam")).alias("breaks"),
        F.min_by("head", F.when(F.col("head") > 0, F.struct("part", "piece"))).alias("head"), F.max_by("tail", F.when(F.col("tail") > 0, F.struct("part", "piece"))).alias("tail"),
        F.min("first_at").cast("timestamp").alias("first_at"), F.max("last_at").cast("timestamp").alias("last_at"),
    )


def reciprocal() -> Column:
    """user, assistant alternately, at least one pair, ending with assistant."""
    return (F.col("turns") >= 2) & (F.col("breaks") == 0) & (F.col("head") == 1) & (F.col("tail") == 2)


def dropped(details: DataFrame, rows: DataFrame) -> DataFrame:
    """(conversation_id, reason): conversations that are broken, empty or lack replies."""
    known = details.select(entity_key(F.col("id")).alias("channel")).filter("channel is not null").distinct().withColumn("known", F.lit(True))
    s = sessions(messages(rows))
    whole = known.join(s, "channel", "full_outer")
    reason = (
        F.when(F.col("known").isNull(), "no_row").when(F.col("n").isNull(), "empty").when(F.col("bad") > 0, "broken").when(~reciprocal(), "no_reply")
    )
    return whole.withColumn("reason", reason).filter("reason is not null").select(F.col("channel").alias("conversation_id"), "reason")


def conversations(details: DataFrame, rows: DataFrame) -> DataFrame:
    """The kept conversations message by message: conversation_id, position (from 1), message_id,
    role, text, created_at, in speaking order by position.

    A position is the place in the run plus the lengths of the channel's earlier runs."""
    msgs = messages(rows, text=True).join(dropped(details, rows).select(F.col("conversation_id").alias("channel")), "channel", "left_anti")
    run = cut(ordered(msgs).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    spans = run.groupBy("channel", "part").agg(F.count("*").alias("k"), F.min("place").alias("least"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("channel").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("channel", "part", (before - F.col("least") + 1).alias("shift"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("role") + 1)
    return run.join(spans, ["channel", "part"]).select(
        F.col("channel").alias("conversation_id"), (F.col("place") + F.col("shift")).alias("position"), "message_id", role.alias("role"), "text", F.col("at").alias("created_at")
    )


def calibrated_gap(msgs: DataFrame, factor: float = GAP_FACTOR, least: float = GAP_LEAST_S) -> float:
    """A gap limit from the data: factor times the median gap between neighbours of a channel,
    at least `least` seconds. The gaps come from the sorted runs, all of them: those across a seam
    from the ends of the runs, a row for each partition."""
    def gaps(batches):
        from pyspark import TaskContext

        first = last = None
        for b in batches:
            t = b["at_s"].to_numpy(float)
            c = b["channel"].to_numpy()
            if len(t):
                prior = np.r_[np.nan if last is None or last[0] != c[0] else last[1], np.where(c[1:] == c[:-1], t[:-1], np.nan)]
                g = t - prior
                g = g[~np.isnan(g)]
                yield pd.DataFrame({c: g if c == "gap" else np.full(len(g), None, object) for c in names})
                first, last = first or (c[0], t[0]), (c[-1], t[-1])
        if last:
            yield pd.DataFrame([(np.nan, TaskContext.get().partitionId(), *first, *last)], columns=names, dtype=object)

    schema = "gap double, part double, c1 string, t1 double, c2 string, t2 double"
    names = [c.split()[0] for c in schema.split(", ")]
    g = cut(ordered(msgs).select("channel", F.col("at").cast("double").alias("at_s")).mapInPandas(gaps, schema))
    ends = g.filter("c1 is not null").orderBy("part").collect()  # a row per partition
    seams = [(n["t1"] - e["t2"],) for e, n in zip(ends, ends[1:]) if n["c1"] == e["c2"] and n["t1"] is not None and e["t2"] is not None]
    inner = g.filter("c1 is null").select("gap").union(msgs.sparkSession.createDataFrame(seams, "gap double")).filter("gap is not null and not isnan(gap)")
    median = inner.agg(F.percentile_approx("gap", 0.5)).first()[0]
    return max(least, factor * (median or 0.0))


def inferred_roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Role codes with the unknown ones set to the other side of the turn before; the first of
    a run opens as user. Batches of one partition continue one another. leading: unknown
    ones with no known turn before them in the run."""
    channel, last, known = None, 2, False
    for b in batches:
        out, leading = [], []
        for c, r in zip(b["channel"], b["role"], strict=True):
            if c != channel:
                channel, last, known = c, 2, False
            leading.append(r < 0 and not known)
            known = known or r > 0
            if r < 0:
                r = 3 - last
            if r > 0:
                last = r
            out.append(r)
        yield b.assign(role=np.array(out, dtype="int32"), leading=np.array(leading, dtype=bool))


def with_roles(msgs: DataFrame) -> DataFrame:
    """channel, at, message_id, role, has_text with unknown roles inferred over all partitions.

    A run in which a role is known ends in a turn of its own; one of unknown roles only turns
    what comes in once for each. The leading unknown ones of a run were set as if assistant came
    in, and are turned if it is user."""
    slim = ordered(msgs).select("channel", "at", "message_id", "role", "has_text", F.spark_partition_id().alias("part"))
    run = cut(slim.mapInPandas(inferred_roles, "channel string, at timestamp, message_id string, role int, has_text boolean, part int, leading boolean"))
    own = (F.col("role") > 0) & ~F.col("leading")
    ends = run.groupBy("channel", "part").agg(F.count_if("leading").alias("turns"), F.max_by("role", F.when(own, F.struct("at", "message_id"))).alias("tail"))
    w = W.partitionBy("channel").orderBy("part")
    ends = ends.withColumn("turned", F.sum(F.when(F.col("tail").isNull(), F.col("turns")).otherwise(0)).over(w))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    known = F.coalesce(F.last(F.when(F.col("tail").isNotNull(), F.struct("tail", "turned")), True).over(before), F.struct(F.lit(2).alias("tail"), F.lit(0).cast("bigint").alias("turned")))
    ends = ends.withColumn("known", known).withColumn("since", F.coalesce(F.last("turned").over(before), F.lit(0)) - F.col("known.turned"))
    flip = ends.select("channel", "part", ((F.col("known.tail") == 1) != (F.col("since") % 2 == 1)).alias("flip"))
    role = F.when(F.col("leading") & F.col("flip"), 3 - F.col("role")).otherwise(F.col("role"))
    return run.join(flip, ["channel", "part"]).select("channel", "at", "message_id", role.alias("role"), "has_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dropped(table(spark, d, "conversation_details"), table(spark, d, "message_details")).select("conversation_id")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "conversation_details"), table(spark, d, "message_details"))


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions split at calibrated gaps, with inferred roles, and whether each is kept."""
    msgs = messages(table(spark, d, "message_details"))
    s = sessions(with_roles(msgs), calibrated_gap(msgs))
    return s.select("channel", "session", "n", "turns", "bad", "breaks", (F.coalesce(reciprocal(), F.lit(False)) & (F.col("bad") == 0)).alias("kept"))


QUERIES = {"p3_found": p3_found, "p3_conversations": p3_conversations, "p3_sessions": p3_sessions}
_CONV = f"""
WITH raw AS (
  SELECT {sql_uuid('id')} AS message_id, {sql_uuid('conversation_id')} AS channel, {sql_enum('role')} AS role, text, created_at AS at_ FROM message_details),
msgs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY at_ NULLS LAST) AS rn FROM raw WHERE channel IS NOT NULL) WHERE rn = 1),
conv AS (SELECT DISTINCT {sql_uuid('id')} AS channel FROM conversation_details),
bad AS (
  SELECT channel FROM msgs WHERE at_ IS NULL OR role IS NULL OR role NOT IN ('system', 'user', 'assistant') OR text IS NULL OR NOT regexp_matches(text, '\\S')
  UNION SELECT channel FROM msgs WHERE channel NOT IN (SELECT channel FROM conv)),
turns AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY at_, message_id) AS k, count(*) OVER (PARTITION BY channel) AS n FROM msgs WHERE role <> 'system'),
good AS (SELECT channel FROM turns WHERE channel NOT IN (SELECT channel FROM bad) GROUP BY 1
  HAVING count(*) >= 2 AND count(*) % 2 = 0 AND count(*) FILTER (role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) = 0)
"""
_SESSIONS = f"""
WITH raw AS (SELECT {sql_uuid('id')} AS message_id, {sql_uuid('conversation_id')} AS channel, CASE {sql_enum('role')} WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE -1 END AS role,
    coalesce(regexp_matches(text, '\\S'), false) AS has_text, created_at AS at_ FROM message_details),
msgs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY at_ NULLS LAST, channel, role, has_text) AS rn FROM raw WHERE channel IS NOT NULL) WHERE rn = 1),
-- times as seconds; messages without one stand first, as Spark sorts nulls
line AS (SELECT *, epoch_us(at_) / 1000000.0 AS s, row_number() OVER (PARTITION BY channel ORDER BY at_ NULLS FIRST, message_id) AS k FROM msgs),
gaps AS (SELECT *, s - lag(s) OVER w AS g, last_value(s IGNORE NULLS) OVER (PARTITION BY channel ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_s FROM line WINDOW w AS (PARTITION BY channel ORDER BY k)),
lim AS (SELECT greatest({GAP_LEAST_S}, {GAP_FACTOR} * coalesce(quantile_disc(g, 0.5), 0)) AS gap FROM gaps),
-- an unknown role is the other side of the turn before; a channel opens as user
run AS (SELECT *, sum(CASE WHEN role > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY k) AS block FROM gaps),
known AS (SELECT *, coalesce(max(CASE WHEN role > 0 THEN role END) OVER (PARTITION BY channel, block), 2) AS base, sum(CASE WHEN role < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel, block ORDER BY k) AS flips FROM run),
told AS (SELECT *, CASE WHEN role >= 0 THEN role WHEN flips % 2 = 1 THEN 3 - base ELSE base END AS r FROM known),
cutd AS (SELECT *, sum(CASE WHEN s - last_s > gap THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY k) AS session FROM told, lim),
turn AS (SELECT *, lag(r) OVER (PARTITION BY channel, session ORDER BY k) AS before FROM cutd WHERE r > 0),
t AS (SELECT channel, session, count(*) AS turns, count(*) FILTER (before = r) AS breaks, arg_min(r, k) AS head, arg_max(r, k) AS tail FROM turn GROUP BY 1, 2),
n AS (SELECT channel, session, count(*) AS n, count(*) FILTER (at_ IS NULL OR NOT has_text) AS bad FROM cutd GROUP BY 1, 2)
"""
ORACLES = {
    "p3_found": _CONV + "SELECT channel AS conversation_id FROM (SELECT channel FROM conv UNION SELECT channel FROM msgs) WHERE channel NOT IN (SELECT channel FROM good)",
    "p3_conversations": _CONV + """SELECT channel AS conversation_id, row_number() OVER (PARTITION BY channel ORDER BY at_, message_id) AS position,
      message_id, role, text, at_ AS created_at FROM msgs WHERE channel IN (SELECT channel FROM good)""",
    "p3_sessions": _SESSIONS + """SELECT channel, CAST(session AS INTEGER) AS session, n, coalesce(turns, 0) AS turns, bad, coalesce(breaks, 0) AS breaks,
      coalesce(turns >= 2 AND breaks = 0 AND head = 1 AND tail = 2, false) AND bad = 0 AS kept FROM n LEFT JOIN t USING (channel, session)""",
}
