"""Structured Streaming: watched folders, incremental index and embeddings, sparse deltas."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators import orphans, search, vectors, wide
from weft.operators.store import Store
from weft.sources.files import DEFAULT_IGNORES, is_ignored
from weft.sources.parsers import imported


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """New and changed files of a folder as a stream (path, modificationTime, length, content)."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + os.path.abspath(folder) + "/", "")
    return rows.filter(~is_ignored(relative, DEFAULT_IGNORES))


def import_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watched files parsed and stored; a content seen before is no new import. Batches
    are upserts by entity id, so a repeated batch after a failure changes nothing."""

    def batch(files: DataFrame, _: int) -> None:
        found = imported(files).filter("error is null").dropDuplicates(["entity_id"])
        if store.version("imports") is not None:
            found = found.join(store.read("imports").select("content_hash").distinct(), "content_hash", "left_anti")
        found = found.select("entity_id", "path", "entity_type", "components", "refs", "content_hash")
        found.persist()
        store.upsert("imports", found, ["entity_id"])
        found.unpersist()

    writer = watched(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def index_batch(store: Store):
    """foreachBatch maintenance of the index for batches of search documents."""

    def run(docs: DataFrame, _: int) -> None:
        postings, lengths = search.index(docs)
        ids = docs.select("entity_id")
        store.apply(*[c for n, rows in (("postings", postings), ("lengths", lengths)) for c in (("delete", n, ids, ["entity_id"]), ("append", n, rows, None))])

    return run


def embedding_batch(store: Store, config: str = "fold"):
    """Re-embeds the entities of a batch that was created or updated; empty contents are skipped."""
    make = vectors.provider(config)

    def run(docs: DataFrame, _: int) -> None:
        if "event_type" in docs.columns:
            docs = docs.filter(F.col("event_type").isin("EntityCreated", "EntityUpdated"))
        rows = docs.filter("content is not null and content != ''").select("entity_id", F.lit(config).alias("model"), make(F.col("content")).alias("vector"))
        store.upsert("embeddings", rows, ["entity_id", "model"])

    return run


def delta_batch(store: Store, catalog: list):
    """Problem 2 as a stream: each batch of component rows becomes a run of sparse wide deltas sorted by
    entity; runs of one level are compacted into one of the next. wide_now reads what they hold."""

    def merge(rows: DataFrame) -> DataFrame:
        return wide.compact([rows.withColumn("run", F.lit(0))]).sortWithinPartitions("entity_id")

    def run(rows: DataFrame, _: int) -> None:
        store.append("wide", wide.sparse_deltas(rows, catalog).sortWithinPartitions("entity_id"), merge)

    return run


def wide_now(store: Store, catalog: list) -> DataFrame:
    """The wide table of all runs so far."""
    return wide.typed(wide.compact([store.read("wide").withColumn("run", F.lit(0))]), catalog)


def orphan_batch(store: Store, sign: int = 1):
    """Problem 4 as a stream: each batch of references (as references() makes them) or of entities becomes
    a run of signed deltas; runs are summed up as they are merged."""

    def run(rows: DataFrame, _: int) -> None:
        deltas = orphans.reference_deltas(rows, sign) if "key" in rows.columns else orphans.record_deltas(rows, sign)
        store.append("orphan_state", orphans.key_state(deltas), orphans.key_state)

    return run


def orphans_now(store: Store) -> DataFrame:
    """(key, refs) of the keys that are referred to and do not exist."""
    return orphans.orphan_keys(orphans.key_state(store.read("orphan_state")))


class Views:
    """Views by name."""

    def __init__(self):
        self.views: dict = {}

    def register(self, name: str, view: Callable, on_event: Callable | None = None) -> None:
        self.views[name] = (view, on_event)

    def names(self) -> list[str]:
        return sorted(self.views)

    def render(self, name: str, *args, **options) -> DataFrame:
        if name not in self.views:
            raise KeyError(f"no view {name!r}")
        return self.views[name][0](*args, **options)

    def notify(self, batch: DataFrame) -> None:
        notify(batch, [h for _, h in self.views.values() if h])


def notify(batch: DataFrame, handlers: list) -> None:
    """Fans a batch of events out to handlers; one that fails does not stop the others."""
    for h in handlers:
        try:
            h(batch)
        except Exception:  # noqa: BLE001
            continue
