"""Attribute-value rows into one wide row per entity.

A log-structured table: every batch of rows becomes a run of sparse wide deltas (one row per
entity, one cell per attribute, each cell with its version), and runs are compacted by keeping
the latest version of each cell. Compaction is associative, so any split into batches gives
the same table, and a merged run can be compacted again with later ones.

Defined results: a row without a readable entity key or with a type the catalog lacks makes no
cell; a row whose data is null, blank, not strict JSON or without a value of the column's type
makes a cell without value, which never hides an older readable one; of equal versions the later
created_at, then the larger row id holds; repeated rows change nothing; an empty table gives no
rows. Extra columns are ignored. Texts of any length are carried whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.keys import entity_key, enum_key
from weft.session import spread

_END = "~weft end~"


def strict_json(data: Column) -> Column:
    """data as VARIANT at $.v, or null unless it is one strict JSON value.

    The parser alone would ignore what follows the first value, so the text is parsed inside
    an object whose last member must be there too, and no other."""
    v = F.try_parse_json(F.concat(F.lit('{"v":'), data, F.lit(f'\n,"{_END}":0}}')))
    whole = F.variant_get(v, f"$['{_END}']", "int") == 0
    sole = F.size(F.expr("map_keys(try_cast(__v AS MAP<STRING, VARIANT>))")) == 2
    return v, whole, sole


def _value(kind: str, path: str) -> Column:
    """The value of the column's type at a path of __v, as text; null if there is none."""
    at = "$.v" + path.strip()[1:]
    node = F.try_variant_get("__v", at, "variant")
    shape = F.schema_of_variant(node)
    text = F.try_variant_get("__v", at, "string")
    if kind == "string":
        return F.when((shape == "STRING") & text.rlike(r"(?U)\S"), text)
    if kind == "bigint":
        digits = (shape == "STRING") & text.rlike(r"^[0-9]+$")
        return F.when((shape == "BIGINT") | digits, text.try_cast("bigint").cast("string"))
    if kind == "timestamp":
        full = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
        when = F.upper(text).try_cast("timestamp")
        return F.when((shape == "STRING") & text.rlike(full) & when.isNotNull(), F.unix_micros(when).cast("string"))
    if kind == "array<string>":
        items = F.try_variant_get("__v", at, "array<string>")
        return F.when((shape == "ARRAY<STRING>") & ~F.exists(items, lambda x: x.isNull()), F.to_json(items))
    raise ValueError(f"no rule for column type {kind!r}")


def catalog_rows(catalog: DataFrame) -> list:
    """The catalog's rows: one per attribute type, so its size is the number of columns."""
    cols = ["component_type", "column_name", "column_type", "json_paths"]
    return sorted(catalog.select(*cols).distinct().collect(), key=lambda r: r["component_type"])


def month_of(at: Column) -> Column:
    """The batch a row belongs to: the month it was made in, 0 if unknown."""
    return F.coalesce(F.year(at) * 12 + F.month(at), F.lit(0))


def cells(rows: DataFrame, catalog: list, values: bool = True, batch: Column | None = None) -> DataFrame:
    """(entity_id, kind, cell) for each row, and its batch if one is given; kind is the place of
    the row's type in the catalog.

    cell is struct(has, version, created_at, id, value): has tells whether the row yields a value,
    and by the order of structs the greatest cell is the latest readable one. values=False leaves
    the values themselves out."""
    rows = spread(rows.select("entity_id", "component_type", "data", "version", "created_at", "id"))
    kinds = F.create_map(*[F.lit(x) for k, r in enumerate(catalog) for x in (r["component_type"].strip().lower(), k)])
    base = rows.select(
        entity_key(F.col("entity_id")).alias("entity_id"), kinds[enum_key(F.col("component_type"))].alias("kind"), "data", "version", "created_at", "id",
    ).filter("entity_id is not null and kind is not null")
    v, whole, sole = strict_json(F.col("data"))
    base = base.withColumn("__v", v)
    base = base.withColumn("__v", F.when(whole & sole, F.col("__v")))
    value = F.lit(None).cast("string")
    for k, r in enumerate(catalog):
        found = F.coalesce(*[_value(r["column_type"], p) for p in r["json_paths"]])
        value = F.when(F.col("kind") == k, found).otherwise(value)
    run = [] if batch is None else [batch.alias("run")]
    got = base.select(*run, "entity_id", "kind", "version", "created_at", "id", value.alias("value"))
    cell = F.struct(F.col("value").isNotNull().alias("has"), "version", "created_at", "id", *(["value"] if values else []))
    return got.select(*[c for c in ("run", "entity_id", "kind") if c in got.columns], cell.alias("cell"))


def sparse_deltas(rows: DataFrame, catalog: list, values: bool = True, batch: Column | None = None) -> DataFrame:
    """A run of sparse wide rows: entity_id and per catalog column a cell, null where the batch
    has no row. With a batch expression, one run for each of its values, told by column run.
    Rows are combined before the shuffle, so a hot entity costs one row per run and task."""
    each = cells(rows, catalog, values, batch)
    picked = [F.max(F.when(F.col("kind") == k, F.col("cell"))).alias(r["column_name"]) for k, r in enumerate(catalog)]
    return each.groupBy(*[c for c in ("run", "entity_id") if c in each.columns]).agg(*picked)


def compact(runs: list[DataFrame]) -> DataFrame:
    """Runs (frames, or one frame that holds several) as one: the latest version of each cell."""
    if len(runs) == 1 and "run" not in runs[0].columns:
        return runs[0]
    every = reduce(DataFrame.unionByName, [r.drop("run") for r in runs])
    return every.groupBy("entity_id").agg(*[F.max(c).alias(c) for c in every.columns if c != "entity_id"])


def typed(run: DataFrame, catalog: list) -> DataFrame:
    """A run's values with the catalog's types, one row per entity."""
    out = [F.col("entity_id")]
    for r in catalog:
        text = F.col(r["column_name"])["value"]
        kind = r["column_type"]
        if kind == "timestamp":
            text = F.timestamp_micros(text.cast("bigint"))
        elif kind == "array<string>":
            text = F.from_json(text, "array<string>")
        elif kind != "string":
            text = text.cast(kind)
        out.append(text.alias(r["column_name"]))
    return run.select(*out)


def wide_table(rows: DataFrame, catalog: DataFrame, batch: Column | None = None) -> DataFrame:
    """One typed row per entity, through a run for each batch if one is given."""
    kinds = catalog_rows(catalog)
    return typed(compact([sparse_deltas(rows, kinds, True, batch)]), kinds)


def unreadable(rows: DataFrame, catalog: DataFrame, batch: Column | None = None) -> DataFrame:
    """(entity_id, component_type): cells of the compacted table that some row has made and none
    has given a value."""
    kinds = catalog_rows(catalog)
    table = compact([sparse_deltas(rows, kinds, False, batch)])
    empty = F.array_compact(F.array(*[F.when(~F.col(r["column_name"])["has"], r["component_type"]) for r in kinds]))
    return table.filter(F.size(empty) > 0).select("entity_id", F.explode(empty).alias("component_type"))
