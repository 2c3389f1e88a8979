"""Similarities of titles and contents."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"title": 0.40, "content": 0.30, "metadata": 0.20, "structural": 0.10}


def normalize_title(c: Column) -> Column:
    """ASCII lower case, runs of anything but letters and digits to one blank, trimmed."""
    low = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(low, r"[^\p{IsAlphabetic}\p{N}]+", " "))


def jaro_winkler(a: str, b: str, boost: float = 0.7) -> float:
    """Jaro-Winkler with prefix up to 4, weight 0.1, and the bonus only above `boost`."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hit_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hit_a.append(ch)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    hit_b = [ch for ch, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(hit_a, hit_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= boost:
        return jaro
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


def jaro_winkler_udf(a: str, b: str) -> Column:
    """jaro_winkler of two columns as an Arrow UDF; null where either is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """Distance in characters over length in bytes, as the quirk list has it."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.octet_length(a), F.octet_length(b))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def band(a: Column, b: Column) -> Column:
    """1 for a ratio within [0.8, 1.25], 0.5 within [0.5, 2], else 0."""
    r = a / b
    return F.when(r.between(0.8, 1.25), 1.0).when(r.between(0.5, 2.0), 0.5).otherwise(0.0)


def structural(a: Column, b: Column) -> Column:
    """Of two numbers of pages, 0.5 if one is missing."""
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(band(a, b))


def metadata_overlap(language: tuple, size: tuple, date: tuple) -> Column:
    """Mean of the signals both sides have, 0.5 if there are none."""
    lang = F.when(language[0].isNotNull() & language[1].isNotNull(), (language[0] == language[1]).cast("double"))
    length = F.when(size[0].isNotNull() & size[1].isNotNull(), band(size[0], size[1]))
    day = F.when(date[0].isNotNull() & date[1].isNotNull(), F.when(date[0] == date[1], 1.0).when(F.substring(date[0], 1, 7) == F.substring(date[1], 1, 7), 0.5).otherwise(0.0))
    got = F.filter(F.array(lang, length, day), lambda x: x.isNotNull())
    return F.when(F.size(got) == 0, 0.5).otherwise(F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(got))


def composite(title: Column, content: Column, metadata: Column, structural: Column, weights: dict | None = None) -> Column:
    """Weighted mean of the four scores."""
    w = weights or WEIGHTS
    return (title * w["title"] + content * w["content"] + metadata * w["metadata"] + structural * w["structural"]) / sum(w.values())
