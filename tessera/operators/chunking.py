"""Texts cut into chunks: recursive pieces packed with overlap, windows of lines, cuts at breakpoints."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import newlines
from tessera.schema import CHUNK_OVERLAP, CHUNK_SIZE

SEPARATORS = ("\n\n", "\n", " ")


def overlap_size(size: int, share: float) -> int:
    """Overlap in characters: the share of the size in single precision, cut to a whole number."""
    return int(np.float32(size) * np.float32(share))


def _split(c: Column, sep: str) -> Column:
    """Parts of a text, each ending with the separator but the last."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(.*?{sep}|.+)"), 1)


def pieces(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters where the separators allow it; the separator stays at the piece's end."""

    def cut(c: Column, seps: tuple[str, ...]) -> Column:
        if not seps:
            return F.array(c)
        return F.when(F.length(c) <= size, F.array(c)).otherwise(F.flatten(F.transform(_split(c, seps[0]), lambda x: cut(x, seps[1:]))))

    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(cut(text, SEPARATORS))


def recursive_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int | None = None) -> Column:
    """array<struct<content, start_line, end_line>> of a text.

    Pieces are packed until the next does not fit; a chunk begins with the last ``overlap`` characters of the one before. A
    chunk that begins with an overlap may exceed the size, as a piece that cannot be split does. '' and NULL give no chunks."""
    overlap = overlap_size(size, CHUNK_OVERLAP) if overlap is None else overlap
    chunk = "struct<content:string,start_line:int,end_line:int>"
    zero = F.struct(F.array().cast(f"array<{chunk}>").alias("out"), F.lit("").alias("buf"), F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(1).alias("ln"))

    def add(s: Column, p: Column) -> Column:
        end = (s["ln"] + newlines(p)).cast("int")
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p) > size)
        tail = F.right(s["buf"], F.least(F.lit(overlap), F.length(s["buf"]))) if overlap else F.lit("")
        fresh = F.concat(tail, p)
        start = F.greatest(F.lit(1), s["b"] - newlines(tail)).cast("int")
        emitted = F.concat(s["out"], F.array(F.struct(s["buf"].alias("content"), s["a"].alias("start_line"), s["b"].alias("end_line"))))
        return F.when(full, F.struct(emitted.alias("out"), fresh.alias("buf"), start.alias("a"), (start + newlines(fresh)).cast("int").alias("b"), end.alias("ln"))).otherwise(
            F.struct(s["out"].alias("out"), F.concat(s["buf"], p).alias("buf"), F.when(s["buf"] == "", s["ln"]).otherwise(s["a"]).alias("a"), end.alias("b"), end.alias("ln"))
        )

    def done(s: Column) -> Column:
        last = F.array(F.struct(s["buf"].alias("content"), s["a"].alias("start_line"), s["b"].alias("end_line")))
        return F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], last))

    return F.aggregate(pieces(text, size), zero, add, done)


def chunk_table(df: DataFrame, id_col: str, text: str, size: int = CHUNK_SIZE, overlap: int | None = None) -> DataFrame:
    """(id, ordinal, content, start_line, end_line), one row a chunk."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(recursive_chunks(F.col(text), size, overlap)).alias("ordinal", "c")).select("id", "ordinal", "c.*")


def line_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """array<struct<content, start_line, end_line>>: windows of ``size`` lines, ``size - overlap`` apart, ending with the text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)

    def windows(lines: Column) -> Column:
        n = F.size(lines)
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(F.concat(F.array_join(F.slice(lines, k * step + 1, F.lit(size)), "\n"), F.lit("\n")).alias("content"), (k * step + 1).alias("start_line"), F.least(k * step + size, n).alias("end_line")),
        )

    return F.when(text.isNull() | (text == ""), F.array().cast("array<struct<content:string,start_line:int,end_line:int>>")).otherwise(F.element_at(F.transform(F.array(F.split(body, "\n")), windows), 1))


def cut_at(text: str, breakpoints: list[int], size: int, overlap: int) -> list[str]:
    """Chunks that end at the last breakpoint before the size is reached, unless that is in the first half; each begins
    ``overlap`` characters before the end of the one before. The overlap must be below half the size."""
    if overlap * 2 >= size:
        raise ValueError("the overlap must be below half the size")
    bps, out, start = sorted(breakpoints), [], 0
    while start < len(text):
        ideal = start + size
        if ideal >= len(text):
            out.append(text[start:])
            break
        k = bisect_left(bps, ideal)
        end = bps[k - 1] if k else ideal
        if end < start + size // 2:
            end = ideal
        out.append(text[start:end])
        start = end - overlap if end > overlap else 0
    return out


def breakpoint_chunks(df: DataFrame, id_col: str, text: str, breakpoints: str, size: int, overlap: int) -> DataFrame:
    """(id, ordinal, content) of texts with an array column of breakpoints (character offsets); NULLs count as none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t, p in b.itertuples(index=False, name=None) for k, c in enumerate(cut_at(t or "", [] if p is None else list(p), size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "content"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"), F.col(breakpoints).cast("array<int>").alias("p")).mapInPandas(run, "id long, ordinal int, content string")
