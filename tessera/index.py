"""Indexing: files to chunks, links and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.embedders import Embedder, embed_column
from tessera.functions.symbols import extract_calls, extract_symbols
from tessera.operators.chunking import recursive_chunks
from tessera.schema import CHUNK_SIZE
from tessera.session import materialize

_SYMBOLS = "path string, ordinal int, content string, start_line int, end_line int, symbol_name string, symbol_type string, language string, project_root string"


def symbol_table(files: DataFrame) -> DataFrame:
    """(path, ordinal, content, start_line, end_line, symbol_name, symbol_type, language, project_root) of (path, text, language, project_root)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, s.content, s.start_line, s.end_line, s.symbol_name, s.symbol_type, lang, root) for p, t, lang, root in b.itertuples(index=False, name=None) for k, s in enumerate(extract_symbols(t, lang))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SYMBOLS.split(", ")])

    return files.select("path", "text", "language", "project_root").mapInPandas(run, _SYMBOLS)


def call_table(files: DataFrame, key: str = "path", kind: str = "string") -> DataFrame:
    """(key, line, name) of the calls of bare identifiers, one row a call."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, t.count("\n", 0, at) + 1, name) for p, t, lang in b.itertuples(index=False, name=None) for at, name in extract_calls(t, lang)]
            yield pd.DataFrame(rows, columns=[key, "line", "name"])

    return files.select(key, "text", "language").mapInPandas(run, f"{key} {kind}, line int, name string")


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of files (path, text, project_root): symbols where the language has them and some are found, packed pieces otherwise; files of
    other types than the indexed ones have none."""
    f = files.filter(X.is_indexed_type(F.col("path"))).withColumn("language", X.language(F.col("path")))
    symbols = materialize(symbol_table(f.filter(X.has_symbols(F.col("path")))), "symbols")
    rest = f.join(symbols.select("path").distinct(), "path", "left_anti")
    packed = rest.select("path", "language", "project_root", F.posexplode(recursive_chunks(F.col("text"), size)).alias("ordinal", "c"))
    packed = packed.select("path", "ordinal", "c.content", "c.start_line", "c.end_line", F.lit("").alias("symbol_name"), F.lit("").alias("symbol_type"), "language", "project_root")
    return symbols.unionByName(packed)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    return chunks.withColumn("embedding", embed_column(F.col("content"), embedder))
