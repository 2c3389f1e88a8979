"""Cross references in texts (X01-X06) and Markdown structure (S01-S04) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
WIKI = r"\[\[([^\]]+)\]\]"
MENTION = r"@([a-zA-Z_][a-zA-Z0-9_]*)"
HREF = r"<a\s[^>]*href\s*=\s*[\"']?([^\"'\s>]+)"


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.explode(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def kind_of(target: Column, html: bool = False) -> Column:
    """Url, section or file; null for what is no reference."""
    skip = target.startswith("mailto:") | target.startswith("#") if html else F.lit(False)
    rest = F.lit("file") if html else F.when(target.endswith(".md"), "file")
    return F.when(target.rlike("^https?://"), "url").when(skip, None).when(target.contains("#"), "section").otherwise(rest)


def markdown_refs(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, kind, target) of links, wiki links and mentions, each once per document."""
    base = docs.filter(F.col(text).isNotNull())
    links = base.select(id_, _all(F.col(text), LINK, 2).alias("target")).withColumn("kind", kind_of(F.col("target"))).filter("kind is not null")
    wiki = base.select(id_, _all(F.col(text), WIKI, 1).alias("target")).withColumn("kind", F.lit("wikilink"))
    at = base.select(id_, _all(F.col(text), MENTION, 1).alias("target")).withColumn("kind", F.lit("mention"))
    return links.unionByName(wiki).unionByName(at).select(id_, "kind", "target").distinct()


def html_refs(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Links of HTML."""
    rows = docs.filter(F.col(text).isNotNull()).select(id_, _all(F.col(text), HREF, 1).alias("target"))
    return rows.withColumn("kind", kind_of(F.col("target"), True)).filter("kind is not null").select(id_, "kind", "target").distinct()


def front_matter(text: Column) -> tuple[Column, Column]:
    """(front matter or null, body)."""
    pattern = r"(?s)^\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    block = F.regexp_extract(text, pattern, 1)
    return F.when(block != "", block), F.regexp_replace(text, pattern, "")


def front_value(block: Column, key: str) -> Column:
    value = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*\r?$", 1))
    return F.when(value != "", F.regexp_replace(value, "^[\"']|[\"']$", ""))


def first_heading(body: Column) -> Column:
    """The first line that is a level-one heading."""
    h = F.regexp_extract(body, r"(?m)^[ \t]*# +(\S.*?)[ \t]*\r?$", 1)
    return F.when(h != "", h)


def markdown_titles(docs: DataFrame) -> DataFrame:
    """Title of each document: front matter, else heading, else its id; author and tags."""
    block, body = front_matter(F.col("text"))
    rows = docs.filter("text is not null").select("doc_id", block.alias("fm"), body.alias("body"))
    tags = F.regexp_replace(F.coalesce(front_value(F.col("fm"), "tags"), F.lit("")), r"^\[|\]$", "")
    return rows.select("doc_id", F.coalesce(front_value(F.col("fm"), "title"), first_heading(F.col("body")), F.col("doc_id").cast("string")).alias("title"), front_value(F.col("fm"), "author").alias("author"), tags.alias("tags"))


def strip_html(c: Column) -> Column:
    """The plain fallback: tags to blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def resolved_refs(refs: DataFrame, flat: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, kind, target, entity_id): the least entity whose title (wiki links, mentions)
    is the name, without case. An equality join: the theta join of containment is contained_refs."""
    names = refs.filter(F.col("kind").isin("wikilink", "mention")).withColumn("key", F.lower("target"))
    by = flat.groupBy(F.lower("title").alias("key")).agg(F.min("id").alias("entity_id"))
    return names.join(by, "key").select("doc_id", "kind", "target", "entity_id")


def contained_refs(refs: DataFrame, flat: DataFrame) -> DataFrame:
    """The name within a title whose words hold the name's first word: joined on the rarest of
    the words that must stand whole in the title (all but the last), then verified."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    names = refs.filter(F.col("kind").isin("wikilink", "mention")).withColumn("ws", words(F.col("target"))).filter(F.size("ws") > 0)
    titles = flat.select("id", F.lower("title").alias("t"), F.array_distinct(words(F.col("title"))).alias("tw"))
    held = titles.select("id", "t", "tw", F.explode("tw").alias("w"))
    often = held.groupBy("w").agg(F.count("*").alias("n"))
    each = names.select("doc_id", "kind", "target", F.col("ws")[0].alias("first"), F.explode(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1)))).alias("w"))
    rare = each.join(often, "w", "left").groupBy("doc_id", "kind", "target", "first").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))["w"].alias("w"))
    hit = rare.join(held, "w").filter(F.contains("t", F.lower("target")) & F.array_contains("tw", F.col("first")))
    return hit.groupBy("doc_id", "kind", "target").agg(F.min("id").alias("entity_id"))


def path_refs(refs: DataFrame, flat: DataFrame) -> DataFrame:
    """(doc_id, kind, target, entity_id): the least entity whose source path holds the path of a file or
    section reference, without case. Joined on the path's last part, then verified."""
    path = F.lower(F.regexp_replace(F.regexp_replace("target", "#.*$", ""), r"^(\./|/)+", ""))
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    asked = refs.filter(F.col("kind").isin("file", "section")).withColumn("path", path).filter("path != ''").withColumn("last", last(F.col("path")))
    # a path that holds the reference ends in its last part or goes on after it; ends first, by key
    held = flat.filter("source_path is not null").select("id", F.lower("source_path").alias("source"), last(F.lower("source_path")).alias("last"))
    hit = asked.join(held, "last").filter(F.contains("source", F.col("path")))
    return hit.groupBy("doc_id", "kind", "target").agg(F.min("id").alias("entity_id"))


def url_edges(refs: DataFrame, owner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, events) of external links: a References edge of the document's entity to itself (owner: doc_id,
    entity_id) and an event with the address for each."""
    rows = refs.filter("kind = 'url'").join(owner, "doc_id").select("entity_id", "target").distinct()
    edges = rows.select(F.col("entity_id").alias("source_id"), F.col("entity_id").alias("target_id"), F.lit("References").alias("relationship_type")).distinct()
    data = F.to_json(F.struct(F.col("target").alias("url"), F.lit(True).alias("external")))
    return edges, rows.select(F.lit("RelationshipCreated").alias("event_type"), "entity_id", data.alias("data"))


def new_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id) not yet linked."""
    return pairs.distinct().join(edges.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
