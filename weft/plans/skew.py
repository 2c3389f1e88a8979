"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least 1/HEAVY of all rows is heavy, so there are at most HEAVY of them.
HEAVY = 512


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join rows with facts (one row per key, with the key's number of rows in column
    `weight`, `total` over all keys). Facts of heavy keys are broadcast: by the definition
    of HEAVY these are at most HEAVY rows at any size of the data. Rows of other keys
    are joined by an ordinary shuffle, in which none can be large. hot: the weights of all keys, if facts has
    only some of them; rows of a heavy key that has no facts then stay out of the shuffle."""
    least = max(1, total // HEAVY)
    heavy = facts.filter(F.col(weight) > least).drop(weight)
    light = facts.filter(F.col(weight) <= least).drop(weight)
    known = F.broadcast((facts if hot is None else hot).filter(F.col(weight) > least).select(*keys))
    parts = [rows.join(F.broadcast(heavy), keys, how), rows.join(known, keys, "left_anti").join(light, keys, how)]
    return reduce(DataFrame.unionByName, parts)


def salted(buckets: int, *columns: str):
    """A salt that spreads the rows of one key over `buckets` parts, the same at each run."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
