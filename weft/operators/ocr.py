"""Recognition of scanned files into components and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions.keys import entity_key


def plain_text(raw: bytes) -> tuple[str, float]:
    """The provider for tests: the bytes as text, sure if they are UTF-8."""
    try:
        return raw.decode("utf-8"), 1.0
    except UnicodeDecodeError:
        return raw.decode("latin-1"), 0.5


#: Recognisers by name: bytes of a page to its text and confidence. Engines register here.
PROVIDERS: dict[str, Callable[[bytes], tuple[str, float]]] = {"plain": plain_text}


def recognised(pages: DataFrame, provider: str = "plain") -> DataFrame:
    """(entity_id, page_no, text, confidence, error) of pages (entity_id, page_no, content); a page that cannot be
    read has an error and stops no other."""
    if provider not in PROVIDERS:
        raise ValueError(f"no recogniser {provider!r}")
    read = PROVIDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["content"]:
                try:
                    out.append((*read(bytes(raw)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, None, f"{type(e).__name__}: {e}"[:300]))
            yield b[["entity_id", "page_no"]].assign(text=[x[0] for x in out], confidence=pd.array([x[1] for x in out], "Float64"), error=[x[2] for x in out])

    return pages.select("entity_id", "page_no", "content").mapInPandas(run, "entity_id string, page_no int, text string, confidence double, error string")


def best_pages(results: DataFrame) -> DataFrame:
    """(entity_id, page_no, text, confidence): of each page the surest recognition, confidences in 0..1."""
    c = F.col("confidence")
    conf = F.when(c.isNull() | F.isnan(c), 0.5).when(c > 1, F.least(c / 100, F.lit(1.0))).otherwise(F.greatest(c, F.lit(0.0)))
    rows = results.select(entity_key(F.col("entity_id")).alias("entity_id"), "page_no", "text", conf.alias("confidence")).filter("entity_id is not null and page_no is not null and text is not null")
    w = W.partitionBy("entity_id", "page_no").orderBy(F.desc("confidence"), "text")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def content_components(results: DataFrame) -> DataFrame:
    """(entity_id, component_type, data, page_no): a Content component for each page, to be upserted."""
    data = F.to_json(F.struct(F.col("text").alias("markdown"), "page_no"))
    return best_pages(results).select("entity_id", F.lit("Content").alias("component_type"), data.alias("data"), "page_no")


def events(results: DataFrame) -> DataFrame:
    """(entity_id, event_type, pages, confidence): an event for each entity with the mean confidence of its pages."""
    rows = best_pages(results).groupBy("entity_id").agg(F.count("*").alias("pages"), F.avg("confidence").alias("confidence"))
    return rows.select("entity_id", F.lit("ComponentUpdated").alias("event_type"), "pages", "confidence")
