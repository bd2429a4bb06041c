"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("FACTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level tokenizer whose ranks are in the file `path`; special tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Token ids of a text; none for NULL and empty ones."""
    return np.asarray(encoding(path).encode_ordinary(text), np.int64) if text else np.empty(0, np.int64)


def with_sizes(df: DataFrame, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """`df` without its text but with `tokens`, the size of the text; NULL and empty texts have 0."""

    @F.pandas_udf("long")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([len(encoding(path).encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return df.withColumn("tokens", size(text_col)).drop(text_col)
