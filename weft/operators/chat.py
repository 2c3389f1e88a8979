"""Conversations and retrieval context."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.operators.search import chat_terms, search, search_docs
from weft.operators.store import Store
from weft.plans.model import Model


def message_edges(m: Model) -> DataFrame:
    return m.edges.filter(F.col("relationship_type") == "HasMessage").select("source_id", "target_id").distinct()


def conversations_list(m: Model) -> DataFrame:
    """Active parents of HasMessage edges: number of messages (archived too), time of the last
    active one and its text's first 100 characters on one line. Three aggregates, no subqueries."""
    e = message_edges(m)
    live = m.flat.select(F.col("id").alias("target_id"), F.col("created_at").alias("at"), "message_text")
    last = F.max_by("message_text", F.when(F.col("message_text").isNotNull(), F.struct("at", "target_id")))
    agg = e.join(live, "target_id", "left").groupBy("source_id").agg(F.count("*").alias("messages"), F.max("at").alias("last_message_at"), last.alias("text"))
    rows = agg.join(m.flat.select(F.col("id").alias("source_id"), "title"), "source_id")
    return rows.select(F.col("source_id").alias("conversation_id"), "title", "messages", "last_message_at", F.substring(F.regexp_replace("text", "\n", " "), 1, 100).alias("preview"))


def conversation_messages(m: Model) -> DataFrame:
    """(conversation_id, message_id, position, text) in order of time."""
    live = m.flat.select(F.col("id").alias("target_id"), "created_at", "message_text")
    rows = message_edges(m).join(live, "target_id")
    w = W.partitionBy("source_id").orderBy("created_at", "target_id")
    return rows.select(F.col("source_id").alias("conversation_id"), F.col("target_id").alias("message_id"), F.row_number().over(w).alias("position"), F.col("message_text").alias("text"))


def conversation_view(m: Model) -> DataFrame:
    """(conversation_id, message_id, position, role, text, rating) of active messages in order of time: role and
    text from the MessageContent payload, rating the latest feedback on the message, null if there is none."""
    node = F.try_parse_json("data")
    at = lambda c, *paths: F.coalesce(*[F.try_variant_get(c, p, "string") for p in paths])
    last = lambda kind: m.components.filter(F.col("component_type") == kind)
    newest = F.struct("version", "created_at", "id")
    told = last("MessageContent").select("entity_id", "version", "created_at", "id", at(node, "$.role").alias("role"), at(node, "$.content", "$.text").alias("text")).filter("text is not null")
    told = told.groupBy("entity_id").agg(F.max_by(F.struct("role", "text"), newest).alias("m")).select(F.col("entity_id").alias("message_id"), "m.role", "m.text")
    rated = last("Provenance").select("entity_id", "version", "created_at", "id", at(node, "$.rating").alias("rating")).filter("rating is not null")
    rated = rated.groupBy("entity_id").agg(F.max_by("rating", F.struct("created_at", "version", "id")).alias("rating")).withColumnRenamed("entity_id", "message_id")
    rows = conversation_messages(m).select("conversation_id", "message_id", "position")
    return rows.join(told, "message_id", "left").join(rated, "message_id", "left").select("conversation_id", "message_id", "position", "role", "text", "rating")


def cited(m: Model) -> DataFrame:
    """(message_id, number, entity_id, entity_type, title, snippet) of references to active entities."""
    from weft.functions.keys import entity_key

    refs = m.raw("message_details").select(entity_key(F.col("id")).alias("message_id"), F.posexplode("entity_refs").alias("i", "ref")).distinct()
    refs = refs.select("message_id", (F.col("i") + 1).alias("number"), entity_key(F.col("ref")).alias("entity_id"))
    e = m.flat.select(F.col("id").alias("entity_id"), "entity_type", "title", F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("snippet"))
    return refs.join(e, "entity_id").select("message_id", "number", "entity_id", "entity_type", "title", "snippet").distinct()


def renamed(components: DataFrame, conversation: str, title: str, at: str) -> DataFrame:
    """The Title payload replaced or added."""
    is_it = (F.col("entity_id") == conversation) & (F.col("component_type") == "Title")
    new = components.sparkSession.createDataFrame([(f"title:{conversation}", conversation, "Title")], "id string, entity_id string, component_type string")
    new = new.select("id", "entity_id", "component_type", F.to_json(F.struct(F.lit(title).alias("name"))).alias("data"), F.lit(at).cast("timestamp").alias("created_at"), F.lit(1).cast("bigint").alias("version"))
    return components.filter(~is_it).unionByName(new)


def archived(entities: DataFrame, edges: DataFrame, conversation: str) -> DataFrame:
    """The conversation and every message linked to it deactivated."""
    gone = edges.filter((F.col("source_id") == conversation) & (F.col("relationship_type") == "HasMessage")).select(F.col("target_id").alias("id"))
    gone = gone.union(edges.sparkSession.createDataFrame([(conversation,)], "id string")).distinct().withColumn("hit", F.lit(True))
    return entities.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("hit").isNull()).drop("hit")


def context(m: Model, ids: DataFrame) -> DataFrame:
    """(id, entity_type, title, tags, content, relationships) of the given entities; the outgoing
    relationships as 'type → title (type)', sorted."""
    to = m.flat.select(F.col("id").alias("target_id"), F.col("title").alias("t"), F.col("entity_type").alias("k"))
    line = F.concat_ws("", "relationship_type", F.lit(" → "), "t", F.lit(" ("), "k", F.lit(")")).alias("line")
    own = m.edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(to, "target_id").select(F.col("source_id").alias("id"), line).distinct()
    own = own.groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("relationships"))
    return m.flat.join(ids.select("id"), "id", "left_semi").join(own, "id", "left").select("id", "entity_type", "title", "tags", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("relationships", F.array().cast("array<string>")).alias("relationships"))


def search_context(m: Model, query: str, limit: int = 10) -> tuple[DataFrame, str]:
    """The entities retrieved for a question, or the most recent ones; with which it was."""
    terms = m.spark.range(1).select(chat_terms(F.lit(query)).alias("t")).first()["t"]
    if terms:
        hits = search(search_docs(m.flat), " OR ".join(terms), limit=limit, held=(m.postings, m.lengths))
        if not hits.isEmpty():
            return context(m, hits.select(F.col("entity_id").alias("id"))), "retrieved"
    from weft.operators.repository import recent

    return context(m, recent(m, limit, ("Conversation", "Message"))), "recent"


def truncate(c: Column, n: int = 2000) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prompt_blocks(ctx: DataFrame) -> DataFrame:
    """Per entity its block of the prompt, without its number."""
    head = F.concat(F.lit("  Type: "), "entity_type", F.lit("\n  Title: "), "title", F.lit("\n  Tags: "), F.array_join("tags", ", "), F.lit("\n  Content: "), truncate(F.col("content")), F.lit("\n"))
    tail = F.when(F.size("relationships") > 0, F.concat(F.lit("  Relationships:\n    - "), F.array_join("relationships", "\n    - "), F.lit("\n"))).otherwise("")
    return ctx.select("id", F.concat(head, tail).alias("block"))


def citations(answer: str, ctx: list) -> list[dict]:
    """Source i for each marker [i] in the answer; ctx rows in order."""
    return [{"number": i, "entity_id": r["id"], "title": r["title"], "snippet": (r["content"] or "")[:200]} for i, r in enumerate(ctx, 1) if f"[{i}]" in answer]


def marker_citations(messages: DataFrame) -> DataFrame:
    """W04, M09 over a table: (message_id, number) for each marker in the text."""
    numbers = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)))).alias("number")
    return messages.select("message_id", numbers).withColumn("number", F.col("number").cast("int"))


def prompt(ctx: list, question: str, how: str = "retrieved") -> str:
    """The whole prompt: rules, the entities by number with their blocks (rows with column block), the question."""
    rules = "Answer from the entities below only. Name your sources by number, as [1]. Say so if they do not answer the question."
    found = "\n".join(f"[{i}]\n{r['block']}" for i, r in enumerate(ctx, 1)) or "(no entities)\n"
    note = "Nothing matched the question; these are the entities changed last.\n" if how == "recent" and ctx else ""
    return f"{rules}\n\n{note}Entities:\n{found}\nQuestion: {question}\n"


def mock_answer(text: str, ctx: list) -> Iterator[str]:
    """The deterministic provider, word by word."""
    if ctx:
        answer = f"Based on [1], the entity '{ctx[0]['title']}' is relevant."
    else:
        answer = "There is no entity to refer to. Ask about something in the graph."
    yield from re.findall(r"\S+\s*", answer)


#: Providers by name: prompt and context rows to the parts of an answer as they come. Networked ones register here.
PROVIDERS: dict[str, Callable[[str, list], Iterator[str]]] = {"mock": mock_answer}


def retrieved(m: Model, question: str, limit: int = 10) -> tuple[list, str]:
    """At most `limit` context rows in order of id, with their prompt blocks, and how they were found."""
    ctx, how = search_context(m, question, limit)
    blocks = prompt_blocks(ctx)
    return ctx.join(blocks, "id").orderBy("id").limit(limit).collect(), how


def chat_stream(m: Model, question: str, limit: int = 10, provider: str = "mock", cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple]:
    """Status, the answer's parts as the provider makes them, done with answer and citations; stops when cancelled."""
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r}")
    yield "status", "retrieving"
    rows, how = retrieved(m, question, limit)
    yield "status", how
    answer = ""
    for part in PROVIDERS[provider](prompt(rows, question, how), rows):
        if cancelled():
            yield "cancelled", answer
            return
        answer += part
        yield "delta", part
    yield "done", {"answer": answer, "context": how, "citations": citations(answer, rows)}


def chat(m: Model, question: str, limit: int = 10, provider: str = "mock", store: Store | None = None, conversation: str | None = None, at: str | None = None) -> dict:
    """Retrieve, prompt, answer, cite. With a store, the turn is kept as one change: the conversation if it is
    new (titled by the question), both messages with their texts and citations, their edges and events."""
    out = [x for kind, x in chat_stream(m, question, limit, provider) if kind == "done"][0]
    out["messages"] = [("user", question), ("assistant", out["answer"])]
    if store is None:
        return out
    spark, when = m.spark, F.coalesce(F.lit(at).cast("timestamp"), F.current_timestamp())
    new = conversation is None
    conversation = conversation or str(uuid.uuid4())
    ids = [str(uuid.uuid4()) for _ in out["messages"]]
    refs = [c["entity_id"] for c in out["citations"]]
    entities = [(i, "Message") for i in ids] + ([(conversation, "Conversation")] if new else [])
    parts = [(i, "MessageContent", json.dumps({"role": role, "content": text})) for i, (role, text) in zip(ids, out["messages"], strict=True)]
    parts += [(ids[1], "EntityRefs", json.dumps(refs))] if refs else []
    parts += [(conversation, "Title", json.dumps({"name": question[:80]}))] if new else []
    kinds = [(i, "MessageCreated") for i in ids] + ([(conversation, "ConversationCreated")] if new else [])
    # the answer after the question, also where both have one time
    later = F.when(F.col("id") == ids[1], when + F.expr("interval 1 microsecond")).otherwise(when)
    e = spark.createDataFrame(entities, "id string, entity_type string").select("id", "entity_type", F.lit(True).alias("is_active"), later.alias("created_at"), later.alias("updated_at"), F.lit(1).cast("bigint").alias("version"))
    key = F.sha2(F.concat_ws("|", "entity_id", "kind"), 256).alias("id")
    c = spark.createDataFrame(parts, "entity_id string, kind string, data string").select(key, "entity_id", F.col("kind").alias("component_type"), "data", when.alias("created_at"), F.lit(1).cast("bigint").alias("version"))
    r = spark.createDataFrame([(conversation, i) for i in ids], "source_id string, target_id string")
    r = r.select(F.sha2(F.concat_ws("|", "source_id", "target_id"), 256).alias("id"), "source_id", "target_id", F.lit("HasMessage").alias("relationship_type"), F.lit(True).alias("is_active"), when.alias("created_at"))
    v = spark.createDataFrame(kinds, "entity_id string, kind string").select(key, F.col("kind").alias("event_type"), "entity_id", when.alias("timestamp"), F.lit("{}").alias("data"))
    store.apply(("append", "entities", e, None), ("append", "components", c, None), ("append", "relationships", r, None), ("append", "events", v, None))
    return out | {"conversation_id": conversation, "message_ids": ids}


def feedback(components: DataFrame, message: str, rating: str, reason: str | None, at: str) -> DataFrame:
    """Feedback as one more Provenance component of the message."""
    row = (f"feedback:{message}:{at}", message, "Provenance", json.dumps({"rating": rating, "reason": reason}), 1)
    new = components.sparkSession.createDataFrame([row], "id string, entity_id string, component_type string, data string, version bigint")
    return components.unionByName(new.withColumn("created_at", F.lit(at).cast("timestamp")))


