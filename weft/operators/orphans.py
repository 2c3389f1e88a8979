"""References to records that do not exist.

References and records are change deltas: a reference adds 1 to the reference count of the key
it names and a withdrawn one takes 1, a record adds 1 to the existence count of its own and a
removed one takes 1. Summed per key (partial sums before the shuffle) they give the state of each
key, and a state is itself a set of deltas, so it is carried on by later ones. Keys with a positive
reference count and no existence are orphans. The state also holds from when to when the record
exists and the earliest and latest reference; these only widen, a withdrawal does not narrow them,
so they choose the keys with a possible violation, whose referring rows then decide.

Defined results: null and blank references count nowhere; a value that is no UUID refers to
nothing and is an orphan; the nil UUID names no entity; a null created_at of the row leaves only
the test of existence; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.keys import entity_key, is_blank
from weft.plans.skew import split_join
from weft.session import cut


def current_entities(entities: DataFrame) -> DataFrame:
    """One row per id: the highest version, then the latest updated_at."""
    top = F.max(F.struct(F.coalesce("version", F.lit(-1)).alias("version"), "updated_at", "created_at", "is_active", "entity_type")).alias("e")
    return entities.filter("id is not null").groupBy(entity_key(F.col("id")).alias("id")).agg(top).filter("id is not null").select("id", "e.*")


def references(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, field_name, record_id, at, key) for each non-blank reference; key is null
    where the value is no UUID."""
    parts = []
    for name, (df, fields) in tables.items():
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("r")
        rows = df.select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), F.col("created_at").alias("at"), each)
        parts.append(rows.filter(~is_blank(F.col("r.value"))).select("table_name", "r.field_name", "record_id", "at", entity_key(F.col("r.value")).alias("key")))
    return reduce(DataFrame.unionByName, parts)


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """A delta for each reference with a key: made (+1) or withdrawn (-1)."""
    when = F.lit(None).cast("timestamp")
    held = refs.filter("key is not null")
    return held.select("key", F.lit(sign).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("existence"), F.col("at").alias("first_at"), F.col("at").alias("last_at"), when.alias("born"), when.alias("gone"))


def record_deltas(entities: DataFrame, sign: int = 1) -> DataFrame:
    """A delta for each record: there (+1) or removed (-1)."""
    when, gone = F.lit(None).cast("timestamp"), F.when(~F.col("is_active"), F.col("updated_at"))
    held = current_entities(entities)
    return held.select(F.col("id").alias("key"), F.lit(0).cast("bigint").alias("refs"), F.lit(sign).cast("bigint").alias("existence"), when.alias("first_at"), when.alias("last_at"), F.col("created_at").alias("born"), gone.alias("gone"))


def key_state(*deltas: DataFrame) -> DataFrame:
    """Signed counts per key of deltas or earlier states: key, refs, existence, first_at, last_at, born, gone."""
    return reduce(DataFrame.unionByName, deltas).groupBy("key").agg(
        F.sum("refs").alias("refs"), F.sum("existence").alias("existence"), F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"), F.max("born").alias("born"), F.max("gone").alias("gone"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """(key, refs): keys that are referred to and do not exist."""
    return state.filter("refs > 0 and existence <= 0").select("key", "refs")


def orphans(tables: dict[str, tuple[DataFrame, list[str]]], entities: DataFrame) -> DataFrame:
    """(table_name, field_name, record_id, at, reason), one row per reference that does not hold;
    reason is no_key, missing, later or deleted."""
    refs = references(tables)
    state = cut(key_state(reference_deltas(refs), record_deltas(entities)))
    suspect = state.filter("refs > 0 and (existence <= 0 or born > first_at or gone < last_at)")
    total = state.agg(F.sum("refs")).first()[0] or 0
    met = split_join(refs.filter("key is not null"), suspect.select("key", "existence", "born", "gone", "refs"), ["key"], "refs", total, state.select("key", "refs"))
    reason = F.when(F.col("existence") <= 0, "missing").when(F.col("born") > F.col("at"), "later").when(F.col("gone") < F.col("at"), "deleted")
    held = met.withColumn("reason", reason).filter("reason is not null").drop("key", "existence", "born", "gone")
    bad = refs.filter("key is null").drop("key").withColumn("reason", F.lit("no_key"))
    return held.unionByName(bad).select("table_name", "field_name", "record_id", "at", "reason").distinct()


def orphan_report(tables: dict[str, tuple[DataFrame, list[str]]], entities: DataFrame) -> DataFrame:
    """Orphans per table, field and month of the referring row, by reason."""
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return (
        orphans(tables, entities)
        .groupBy("table_name", "field_name", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("orphans"), count("no_key"), count("missing"), count("later"), count("deleted"))
    )
