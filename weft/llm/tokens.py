"""Token counts by a public byte-level BPE tokenizer, given as a rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A parameter of every operator that counts tokens; never copied into the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the rank file (a fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str = TOKENIZER) -> bytes:
    """The rank file's bytes, read on the driver; tasks get them with their closure (1 MB, fixed)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    """(tiktoken encoding, byte length of each token id); one per worker process."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


def clean(text: str | None) -> str:
    """text as it can be encoded: lone surrogates replaced."""
    return (text or "").encode("utf-8", "replace").decode("utf-8", "replace")


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the text column replaced by its number of tokens; null counts 0. Whole texts
    are encoded; other columns pass through."""
    ranks = vocabulary(tokenizer)
    kept = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + [f"`{out}` bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, _ = encoding(ranks)
        for b in batches:
            yield b[kept].assign(**{out: [len(enc.encode_ordinary(clean(t))) if t else 0 for t in b[text]]})

    return df.mapInPandas(run, schema)
