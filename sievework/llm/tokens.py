"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.ship import local_file, ship_file

#: rank file of the tokenizer, on the driver; tasks read the copy it serves them
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(path: str = RANKS):
    """The tokenizer, loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(local_file(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(path: str = RANKS):
    """A Column function: tokens of a text column over its whole length; 0 for null and empty text."""
    ship_file(path)

    @F.pandas_udf("long")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in s], index=s.index, dtype="int64")

    return apply


def sized(df: DataFrame, id_col: str, column: str, *keep: str, path: str = RANKS) -> DataFrame:
    """(id, keep.., n_tokens) of every row of ``df``."""
    return df.select(F.col(id_col).alias("doc_id"), *keep, token_count(path)(F.col(column)).alias("n_tokens"))
