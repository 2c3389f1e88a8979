"""Names and types of the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entity types with a canonical spelling; others are kept as they are.
KNOWN_TYPES = [
    "Concept", "Person", "Organization", "Project", "Book", "Paper", "Video", "Article", "Tool", "Technology", "Question",
    "Idea", "Event", "Skill", "Location", "Dataset", "Collection", "Workspace", "Decision", "Note", "Conversation", "Message",
]
COMPONENT_TYPES = [
    "Title", "Description", "Content", "BinaryContent", "Tags", "Author", "Embedding", "Summary", "Timeline", "Language",
    "Provenance", "MessageContent", "EntityRefs",
]
RELATIONSHIP_TYPES = ["References", "HasMessage", "ReferencedBy"]
EVENT_TYPES = [
    "EntityCreated", "EntityUpdated", "EntityArchived", "EntityRestored", "EntityResolved", "ComponentAdded", "ComponentUpdated",
    "ComponentRemoved", "RelationshipCreated", "RelationshipArchived", "ConversationCreated", "MessageCreated", "EntityReferenced", "ChatContextRetrieved",
]
UNTITLED = "Untitled"

ENTITY = "id string, entity_type string, is_active boolean, created_at timestamp, updated_at timestamp, version bigint"
COMPONENT = "id string, entity_id string, component_type string, data string, created_at timestamp, version bigint"
RELATIONSHIP = "id string, source_id string, target_id string, relationship_type string, is_active boolean, created_at timestamp"
EVENT = "id string, event_type string, entity_id string, timestamp timestamp, data string"


def canonical(c: Column, known: list[str]) -> Column:
    """A known name in its canonical case, without outer blanks and quotes; others only trimmed."""
    bare = F.regexp_replace(c, r'^[\s"]+|[\s"]+$', "")
    names = F.create_map(*[F.lit(x) for k in known for x in (k.lower(), k)])
    return F.coalesce(F.try_element_at(names, F.lower(bare)), bare)


def sql_canonical(c: str, known: list[str]) -> str:
    bare = rf"""regexp_replace({c}, '^[\s"]+|[\s"]+$', '', 'g')"""
    return f"CASE lower({bare}) " + " ".join(f"WHEN '{k.lower()}' THEN '{k}'" for k in known) + f" ELSE {bare} END"
