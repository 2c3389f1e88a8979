"""Keys and enumerations as the tables spell them, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL = "00000000-0000-0000-0000-000000000000"
_HEX = r"([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})"
#: Bare, urn:uuid: or in braces; all hyphens or none; outer blanks.
_ANY = (
    r"(?i)^\s*(?=(?:urn:uuid:)?[0-9a-f-]+\s*$|\{[0-9a-f-]+\}\s*$)"
    r"(?=(?:urn:uuid:|\{)?(?:[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\}?\s*$)"
    r"(?:urn:uuid:|\{)?" + _HEX + r"\}?\s*$"
)
_CANONICAL = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def trimmed(c: Column) -> Column:
    """c without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def _key(c: Column, shape: str) -> Column:
    one_form = F.lower(F.regexp_replace(c, _ANY, "$1-$2-$3-$4-$5"))
    return F.get(F.regexp_extract_all(one_form, F.lit(shape), F.lit(0)), F.lit(0))


def uuid_key(c: Column) -> Column:
    """Lower-case hyphenated UUID of any standard spelling (upper case, 32 digits,
    braces, urn:uuid:, outer blanks); null for anything else."""
    return _key(c, _CANONICAL)


def entity_key(c: Column) -> Column:
    """uuid_key without the nil UUID, which names nothing."""
    return _key(c, "^(?!" + NIL + ")" + _CANONICAL[1:])


def enum_key(c: Column) -> Column:
    """Enumeration value without letter case, outer blanks and outer double quotes."""
    return F.lower(F.regexp_replace(c, r'^[\s"]+|[\s"]+$', ""))


#: The same in DuckDB's SQL, for the oracles.
SQL_HEX = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^urn:uuid:|[{{}}-]', '', 'g')"


def sql_uuid(c: str) -> str:
    h = SQL_HEX.format(c)
    return (
        f"(CASE WHEN regexp_matches({h}, '^[0-9a-f]{{32}}$') THEN "
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) END)"
    )


def sql_enum(c: str) -> str:
    return rf"""lower(regexp_replace({c}, '^[\s"]+|[\s"]+$', '', 'g'))"""
