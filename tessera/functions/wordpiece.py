"""WordPiece token ids."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN, FIRST, LAST, MOST = 100, 101, 102, 512
_DROP = str.maketrans("", "", string.punctuation)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def load_vocab(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to line number from 0. The vocabulary is a small file that the driver reads whole."""
    return {r["value"].rstrip("\r"): k for k, r in enumerate(spark.read.text(path).coalesce(1).collect())}


def encode(text: str | None, vocab: dict[str, int], most: int = MOST) -> list[int]:
    """Ids between the first and the last marker, at most ``most`` in all. ASCII letters are lowered, ASCII punctuation is deleted, a
    word above 100 bytes or without a cover by pieces is unknown."""
    ids = [FIRST]
    for word in (text or "").translate(_LOWER).split():
        word = word.translate(_DROP)
        if not word:
            continue
        if len(word.encode("utf-8", "surrogatepass")) > 100:
            ids.append(vocab.get("[UNK]", UNKNOWN))
        else:
            pieces, at = [], 0
            while at < len(word):
                end = len(word)
                while end > at and ("##" if at else "") + word[at:end] not in vocab:
                    end -= 1
                if end == at:
                    pieces = [UNKNOWN]
                    break
                pieces.append(vocab[("##" if at else "") + word[at:end]])
                at = end
            ids += pieces
        if len(ids) >= most - 1:
            break
    return [*ids[: most - 1], LAST]


def encode_column(text: Column, vocab: dict[str, int], most: int = MOST) -> Column:
    shared = SparkSession.getActiveSession().sparkContext.broadcast(vocab)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: encode(t, shared.value, most))

    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)
