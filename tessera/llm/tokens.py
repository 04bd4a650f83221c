"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; its default is the folder that
``TESSERA_TOKENIZERS`` names, or ``/opt/tokenizers``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = os.path.join(os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: how a text is cut before merges, of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def encoding(path: str = DEFAULT):
    """The encoder of a vocabulary of ranks; loaded once in a process."""
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(c: Column, path: str = DEFAULT) -> Column:
    """Number of tokens of a text; NULL for NULL, 0 for ''."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(path)
        for s in batches:
            yield pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in s], dtype="Int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, T.LongType())(c)
