"""File sources: listing, ignore rules, detection, hashes, previews."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import sqlite3
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is ignored where no ignore file says otherwise.
DEFAULT_IGNORES = [
    ".git/", "node_modules/", "__pycache__/", ".pdm-build/", ".venv/", "venv/", "target/", "dist/", "build/", "*.pyc", ".DS_Store", "Thumbs.db",
]


def ignore_patterns(root: str, global_file: str | None = None, names: tuple = (".gitignore",)) -> list[str]:
    """The first ignore file of these names in the root, else a global file, else the defaults."""
    for path in (*[os.path.join(root, n) for n in names], global_file):
        if path and os.path.isfile(path):
            with open(path) as f:
                return [x.strip() for x in f if x.strip() and not x.lstrip().startswith("#")]
    return DEFAULT_IGNORES


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether a path relative to the root is ignored; a pattern with / at its end is a folder, later ! patterns restore."""
    parts, out = path.split("/"), False
    for p in patterns:
        keep, p = p.startswith("!"), p.removeprefix("!")
        if p.endswith("/"):
            hit = any(fnmatch.fnmatch(x, p[:-1].lstrip("/")) for x in parts[:-1])
        elif "/" in p:
            hit = fnmatch.fnmatch(path, p.lstrip("/"))
        else:
            hit = any(fnmatch.fnmatch(x, p) for x in parts)
        out = (not keep) if hit else out
    return out


def _glob(pattern: str, any_: str) -> str:
    """A shell pattern as a regular expression in which * is any_."""
    out, k = "", 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        end = pattern.find("]", k + 1) if c == "[" else -1
        if end > 0:
            inner, k = pattern[k:end].replace("\\", "\\\\"), end + 1
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
        else:
            out += any_ if c == "*" else any_[:-1] if c == "?" else re.escape(c)
    return out


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """ignored() as an expression: one match for each run of patterns of one kind."""
    out = F.lit(False)
    for keep, run in groupby(patterns, lambda p: p.startswith("!")):
        each = []
        for p in run:
            p = p.removeprefix("!")
            if p.endswith("/"):
                each.append(f"(?:^|/){_glob(p[:-1].lstrip('/'), '[^/]*')}/")
            elif "/" in p:
                each.append(f"^{_glob(p.lstrip('/'), '.*')}$")
            else:
                each.append(f"(?:^|/){_glob(p, '[^/]*')}(?:/|$)")
        out = F.when(path.rlike("(?s)" + "|".join(each)), not keep).otherwise(out)
    return out


def files(spark: SparkSession, root: str, recursive: bool = True, patterns: list[str] | None = None) -> DataFrame:
    """Path, modificationTime, length and content of the files below a folder, without the ignored
    ones. Contents are only read if a later step needs the column."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rules = ignore_patterns(root) if patterns is None else patterns
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + os.path.abspath(root) + "/", "")
    return rows.filter(~is_ignored(relative, rules))


def extension(path: Column) -> Column:
    e = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(e == "", "unknown").otherwise(e)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", "")


def magic(content: Column) -> Column:
    """The format by the first bytes; zip containers by what they hold."""
    head = F.hex(F.substring(content, 1, 8))
    inner = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    office = F.when(inner.contains("word/"), "docx").when(inner.contains("xl/"), "xlsx").when(inner.contains("ppt/"), "pptx").otherwise("zip")
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), office)


def preview(rows: DataFrame) -> DataFrame:
    """Files and bytes per extension."""
    return rows.groupBy(extension(F.col("path")).alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def hashed(rows: DataFrame) -> DataFrame:
    """Path and SHA-256 of the content."""
    return rows.select("path", F.sha2("content", 256).alias("content_hash"))


def conflicts(new: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose content the import log knows already."""
    return new.join(log.select("content_hash").distinct(), "content_hash", "left_semi")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and text columns."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def csv_preview(spark: SparkSession, path: str, n: int = 5) -> dict:
    df = csv(spark, path)
    return {"columns": [(c, "text", True) for c in df.columns], "rows": [tuple(r) for r in df.limit(n).collect()], "row_count": df.count()}


def mapped(rows: DataFrame, mapping: dict[str, tuple] | None = None, skip: tuple = (), entity_type: str = "Article", key: Column | None = None) -> DataFrame:
    """Component rows (entity_id, entity_type, component_type, data) of a table.

    mapping: column to ('Title',), ('Description',), ('Content',), ('Tags', separator), ('TimelineDate',) or
    ('CustomComponent', name); without one the first column is the title, the second the content."""
    if mapping is None:
        mapping = dict(zip(rows.columns, (("Title",), ("Content",)), strict=False))
    ident = key if key is not None else F.sha2(F.concat_ws("\u0001", *rows.columns), 256)
    parts = []
    for column, (kind, *more) in mapping.items():
        if column in skip:
            continue
        c = F.col(f"`{column}`").cast("string")
        if kind == "Tags":
            data = F.to_json(F.filter(F.transform(F.split(c, f"\\Q{more[0] if more else ','}\\E"), F.trim), lambda t: t != ""))
        elif kind == "TimelineDate":
            kind, data = "Timeline", F.to_json(F.struct(c.alias("created_at")))
        elif kind == "CustomComponent":
            kind, data = "Provenance", F.to_json(F.struct(F.lit(more[0]).alias("field"), c.alias("value")))
        else:
            data = F.get(F.split(F.to_json(F.array(c)), r"^\[|\]$"), F.lit(1))
        parts.append(F.when(c.isNotNull(), F.struct(F.lit(kind).alias("component_type"), data.alias("data"))))
    each = F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("c")
    return rows.select(ident.alias("entity_id"), F.lit(entity_type).alias("entity_type"), each).select("entity_id", "entity_type", "c.component_type", "c.data")


def rows_as_entities(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """One DatabaseRecord per row: title the first column, content the row as JSON."""
    return rows.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit("DatabaseRecord").alias("entity_type"), F.col(rows.columns[0]).cast("string").alias("title"), F.to_json(F.struct(*rows.columns)).alias("content"))


# --- databases -------------------------------------------------------------------------------


def sqlite_tables(path: str) -> list[dict]:
    """Tables with their columns and number of rows."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        return [{"name": n, "columns": [(c[1], c[2]) for c in con.execute(f"PRAGMA table_info({quoted(n)})")], "rows": con.execute(f"SELECT count(*) FROM {quoted(n)}").fetchone()[0]} for n in names]


def sqlite_table(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table read in ranges of its rowid by the tasks; all values as text like the preview's."""
    known = {t["name"]: t for t in sqlite_tables(path)}
    if name not in known:
        raise KeyError(name)
    columns = [c for c, _ in known[name]["columns"]]
    q = '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        low, high = con.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {q}").fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    spans = spark.createDataFrame([(a, a + step) for a in range(low, high + 1, step)] or [(0, 0)], "a bigint, b bigint").repartition(parts)

    def read(batches):
        import pandas as pd

        for b in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                for a, z in zip(b["a"], b["b"], strict=True):
                    got = con.execute(f"SELECT * FROM {q} WHERE rowid >= ? AND rowid < ?", (int(a), int(z))).fetchall()
                    yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in got], columns=columns, dtype=object)

    return spans.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """PostgreSQL or MySQL by their drivers, if they are on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


# --- import log ------------------------------------------------------------------------------


def recorded(log: DataFrame, import_id: str, source: str, ids: list[str], at: str, kind: str, content_hash: str | None = None) -> DataFrame:
    """One more import."""
    new = log.sparkSession.createDataFrame([(import_id, source, ids, kind, content_hash)], "id string, source_path string, entity_ids array<string>, format string, content_hash string")
    return log.unionByName(new.withColumn("imported_at", F.lit(at).cast("timestamp")))


IMPORT_LOG = "id string, source_path string, entity_ids array<string>, format string, content_hash string, imported_at timestamp"


def undo_import(log: DataFrame, entities: DataFrame, import_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, entities) without an import, the newest by default."""
    target = log.filter(F.col("id") == import_id) if import_id else log.orderBy(F.desc("imported_at"), F.desc("id")).limit(1)
    gone = target.select(F.explode("entity_ids").alias("id"))
    return log.join(target.select("id"), "id", "left_anti"), entities.join(gone, "id", "left_anti")


def import_actions(files: DataFrame, log: DataFrame) -> DataFrame:
    """(path, content_hash, action): error for files without content, merged for contents the log knows or
    another file of the import has (the least path makes the entity), created for the others."""
    bad = files.filter("content_hash is null").select("path", "content_hash", F.lit("error").alias("action"))
    good = files.filter("content_hash is not null")
    first = good.groupBy("content_hash").agg(F.min("path").alias("first"))
    known = log.select("content_hash").distinct().withColumn("known", F.lit(True))
    rows = good.join(first, "content_hash").join(known, "content_hash", "left")
    action = F.when(F.col("known").isNotNull() | (F.col("path") != F.col("first")), "merged").otherwise("created")
    return rows.select("path", "content_hash", action.alias("action")).unionByName(bad)


def import_counts(actions: DataFrame) -> DataFrame:
    """(action, n)."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def vault(spark: SparkSession, folder: str) -> DataFrame:
    """The notes of a vault: Markdown files of the folder itself, parsed; a bad file is a row with its error."""
    from weft.sources.parsers import imported

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "false").load(folder)
    return imported(rows.select("path", "content"))


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)
