"""Tables as logs of immutable runs under one manifest: upserts, deletes, archive, versions.

A change writes only its own rows, as a new run, and then a manifest that lists the runs of all tables;
manifests are numbered files created once, so a reader or a crash sees all of a change or nothing of it, for
any number of tables, and of two writers one fails. FAN runs of one level are merged into one of the next, so a
row is rewritten once for each level. Files are reached through Hadoop, so a store may lie on any file system it knows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Runs of one level that are merged, and manifests that vacuum keeps the runs of.
FAN, KEEP = 8, 3


class Conflict(RuntimeError):
    """Another writer made the manifest first."""


class NotFound(KeyError):
    """No such row."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # --- manifests

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("manifest")):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(self._path("manifest")) if f.getPath().getName().endswith(".json"))

    def _load(self, n: int) -> dict | None:
        stream = self._fs.open(self._path("manifest", f"{n:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None  # its writer died: it never was
        finally:
            stream.close()

    def manifest(self) -> tuple[int, dict]:
        """(number, tables) of the newest whole manifest."""
        numbers = self._numbers()
        for n in reversed(numbers):
            found = self._load(n)
            if found is not None:
                return numbers[-1], found
        return numbers[-1] if numbers else 0, {}

    def _publish(self, n: int, tables: dict) -> None:
        where = self._path("manifest", f"{n:09d}.json")
        try:
            out = self._fs.create(where, False)
        except Exception as e:
            raise Conflict(where.toString()) from e
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()

    # --- reading

    def version(self, name: str) -> int | None:
        """Number of changes a table has had, None if there is none of that name."""
        found = self.manifest()[1].get(name)
        return found["v"] if found else None

    def _rows(self, runs: list[dict], keys: list[str] | None) -> DataFrame:
        """Runs in order: later rows replace those of the same key, a run of deleted keys removes them."""
        now = None
        for r in runs:
            rows = self.spark.read.parquet(f"{self.root.rstrip('/')}/{r['path']}")
            if r["on"]:
                now = now.join(rows, r["on"], "left_anti")
            elif now is None or not keys:
                now = rows if now is None else now.unionByName(rows)
            else:
                now = now.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
        return now

    def read(self, name: str) -> DataFrame:
        found = self.manifest()[1].get(name)
        if found is None:
            raise NotFound(name)
        return self._rows(found["runs"], found["keys"])

    # --- changes

    def _run(self, name: str, df: DataFrame, level: int = 0, on: list[str] | None = None) -> dict:
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root.rstrip('/')}/{path}")
        return {"path": path, "level": level, "on": on}

    def apply(self, *changes: tuple, merge: dict[str, Callable] | None = None) -> None:
        """Changes (kind, table, rows, columns) as one: write replaces a table, append adds rows, upsert replaces
        rows by key columns, delete removes the rows that match on columns. merge: by table, what
        makes one run of the rows of several appended ones."""
        n, tables = self.manifest()
        touched = []
        for kind, name, rows, columns in changes:
            held = tables.setdefault(name, {"v": 0, "keys": None, "runs": []})
            if name not in touched:
                held["v"] += 1
                touched.append(name)
            if kind == "write":
                held["runs"], held["keys"] = [self._run(name, rows)], None
            elif kind == "delete":
                if held["runs"]:
                    held["runs"].append(self._run(name, rows.select(*columns).distinct(), on=list(columns)))
            elif kind == "upsert":
                held["keys"] = list(columns)
                held["runs"].append(self._run(name, rows.dropDuplicates(list(columns))))
            elif kind == "append":
                held["runs"].append(self._run(name, rows))
            else:
                raise ValueError(kind)
        for name in touched:
            self._merged(name, tables[name], (merge or {}).get(name))
        self._publish(n + 1, tables)

    def _merged(self, name: str, held: dict, merge: Callable | None) -> None:
        """Merges the last FAN runs of a level, if they hold rows only; all runs if deletions have piled up."""
        while True:
            runs = held["runs"]
            last = runs[-FAN:]
            if len(last) == FAN and all(r["level"] == last[0]["level"] and not r["on"] for r in last):
                rows = self._rows(last, held["keys"])
                held["runs"] = [*runs[:-FAN], self._run(name, merge(rows) if merge else rows, last[0]["level"] + 1)]
            elif len(runs) > 4 * FAN:
                held["runs"] = [self._run(name, self._rows(runs, held["keys"]), max(r["level"] for r in runs))]
            else:
                return

    def write(self, name: str, df: DataFrame) -> None:
        self.apply(("write", name, df, None))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """New rows replace those of the same key; of repeated new rows one."""
        self.apply(("upsert", name, rows, keys))

    def delete(self, name: str, keys: DataFrame, on: list[str]) -> None:
        self.apply(("delete", name, keys, on))

    def append(self, name: str, rows: DataFrame, merge: Callable | None = None) -> None:
        """Events are only added."""
        self.apply(("append", name, rows, None), merge={name: merge} if merge else None)

    def commit(self, changes: dict[str, DataFrame]) -> None:
        """Several tables replaced as one."""
        self.apply(*[("write", name, df, None) for name, df in changes.items()])

    def vacuum(self) -> int:
        """Removes runs that none of the last KEEP manifests lists, and older manifests; how many runs went."""
        numbers = self._numbers()
        held = [m for n in numbers[-KEEP:] if (m := self._load(n)) is not None]
        used = {r["path"] for m in held for t in m.values() for r in t["runs"]}
        gone = 0
        for folder in self._fs.listStatus(self._path()):
            name = folder.getPath().getName()
            for run in self._fs.listStatus(folder.getPath()) if name != "manifest" and folder.isDirectory() else []:
                if f"{name}/{run.getPath().getName()}" not in used:
                    gone += self._fs.delete(run.getPath(), True)
        for n in numbers[:-KEEP]:
            self._fs.delete(self._path("manifest", f"{n:09d}.json"), False)
        return gone


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Latest wins; of repeated new rows one."""
    one = new.dropDuplicates(keys)
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)


def deleted(entities: DataFrame, components: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with their components and relationships in both directions removed."""
    k = ids.select("id")
    e = edges.join(k.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(k.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return entities.join(k, "id", "left_anti"), components.join(k.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti"), e.select(*edges.columns)


def updated_component(components: DataFrame, component: str, data: str) -> DataFrame:
    """The payload replaced and the version raised."""
    hit = F.col("id") == component
    return components.withColumn("data", F.when(hit, data).otherwise(F.col("data"))).withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")))


def incremented(entities: DataFrame, versions: DataFrame, ids: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(entities one version on, versions with a snapshot of the old rows)."""
    old = entities.join(ids.select("id"), "id", "left_semi")
    snap = old.select(F.col("id").alias("entity_id"), "version", F.to_json(F.struct(*entities.columns)).alias("snapshot"), F.lit(at).cast("timestamp").alias("created_at"))
    new = old.withColumn("version", F.col("version") + 1).withColumn("updated_at", F.lit(at).cast("timestamp"))
    return replaced(entities, new, ["id"]), versions.unionByName(snap)


def set_active(entities: DataFrame, events: DataFrame, ids: DataFrame, active: bool, at: str) -> tuple[DataFrame, DataFrame]:
    """Archive or restore, with an event for each."""
    kind = "EntityRestored" if active else "EntityArchived"
    hit = entities.join(ids.select("id"), "id", "left_semi")
    new = hit.withColumn("is_active", F.lit(active)).withColumn("updated_at", F.lit(at).cast("timestamp"))
    log = hit.select(F.sha2(F.concat_ws("|", "id", F.lit(kind), F.lit(at)), 256).alias("id"), F.lit(kind).alias("event_type"), F.col("id").alias("entity_id"), F.lit(at).cast("timestamp").alias("timestamp"), F.lit("{}").alias("data"))
    return replaced(entities, new, ["id"]), events.unionByName(log)


def removed_components(components: DataFrame, ids: DataFrame) -> DataFrame:
    """Components without those of the given ids."""
    return components.join(ids.select("id"), "id", "left_anti")


def collection_created(collections: DataFrame, ident: str, name: str, description: str | None, at: str) -> DataFrame:
    """One more collection; an id that is there already is an error."""
    if not collections.filter(F.col("id") == ident).isEmpty():
        raise ValueError(f"collection {ident} exists")
    new = collections.sparkSession.createDataFrame([(ident, name, description)], "id string, name string, description string")
    when = F.lit(at).cast("timestamp")
    return collections.unionByName(new.withColumn("created_at", when).withColumn("updated_at", when))


def collection_get(collections: DataFrame, ident: str) -> DataFrame:
    """The collection, no row if there is none."""
    return collections.filter(F.col("id") == ident)


def collections_listed(collections: DataFrame) -> DataFrame:
    """By name, in order of its bytes."""
    return collections.orderBy("name", "id")


def collection_updated(collections: DataFrame, ident: str, at: str, **values: str | None) -> DataFrame:
    """Name or description changed; a missing id is an error."""
    if collections.filter(F.col("id") == ident).isEmpty():
        raise NotFound(ident)
    hit = F.col("id") == ident
    changed = {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (values | {"updated_at": at}).items()}
    return collections.withColumns(changed | {"updated_at": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))})


def collection_deleted(collections: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A collection with its memberships."""
    return collections.join(ids.select("id"), "id", "left_anti"), members.join(ids.select(F.col("id").alias("collection_id")), "collection_id", "left_anti")


def member_added(members: DataFrame, new: DataFrame) -> DataFrame:
    """Adding a member again is an error."""
    keys = ["collection_id", "entity_id"]
    if not new.join(members, keys, "left_semi").isEmpty():
        raise ValueError("is a member already")
    return members.unionByName(new)


def member_removed(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Removing what is no member is silent."""
    return members.join(gone, ["collection_id", "entity_id"], "left_anti")


def latest_version(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc("version"), F.desc("updated_at"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
