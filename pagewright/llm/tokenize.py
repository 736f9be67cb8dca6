"""Sizes of texts in tokens of a public tokenizer whose files are given by a path."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file: a parameter of every function here; the folder can be set in the environment.
VOCABULARY = os.path.join(os.environ.get("PAGEWRIGHT_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):  # noqa: ANN201
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of each text; null for null, 0 for empty text. Marks of special tokens count as ordinary text."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            yield pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in batch], dtype="Int64")

    return run(text)
