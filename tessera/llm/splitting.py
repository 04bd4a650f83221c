"""Pieces of oversized items, cut at natural boundaries and overlapping (problem 3).

An item longer than the limit is cut by a hierarchy of separators: sections, paragraphs, lines, sentences, words, and
characters where nothing else is left. The parts are packed greedily; each piece but the first begins with the last
``overlap`` bytes of the piece before it (fewer only where a character or a line end would be cut in two, or the piece
before is shorter). Sizes are in UTF-8 bytes, and no piece exceeds the limit.

Items within the limit stay in the JVM; only longer ones go to Python, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Each pattern matches a separator; the cut is after it (before it for the first: a heading opens its section).
_LEVELS = [
    re.compile(r"(?m)\n(?=\s*\n#{1,6} )|\n(?:[ \t\r]*\n){2,}"),
    re.compile(r"\n(?:[ \t\r]*\n)+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…。！？][\"')\]]*\s+"),
    re.compile(r"\s+"),
]
PIECES = "id long, piece_no int, n_pieces int, content string, start_line int, end_line int, n_bytes int, overlap_bytes int"


def _size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


def _parts(text: str, most: int, level: int = 0) -> Iterator[str]:
    """Consecutive parts of ``text``, each of at most ``most`` bytes, cut at the coarsest separators that do."""
    if _size(text) <= most:
        if text:
            yield text
        return
    if level == len(_LEVELS):
        raw = text.encode("utf-8", "surrogatepass")
        at = 0
        while at < len(raw):
            to = _whole(raw, min(at + most, len(raw)), at)
            yield raw[at:to].decode("utf-8", "surrogatepass")
            at = to
        return
    at = 0
    for m in _LEVELS[level].finditer(text):
        if m.end() > at:
            yield from _parts(text[at : m.end()], most, level + 1)
            at = m.end()
    if at < len(text):
        yield from _parts(text[at:], most, level + 1)


def _whole(raw: bytes, to: int, least: int = 0) -> int:
    """The last place up to ``to`` that cuts no character and no CR LF; after ``least`` unless there is none."""
    p = to
    while p < len(raw) and p > least and (raw[p] & 0xC0 == 0x80 or raw[p - 1 : p + 1] == b"\r\n"):
        p -= 1
    if p > least:
        return p
    while to < len(raw) and raw[to] & 0xC0 == 0x80:
        to += 1
    return to


def split_text(text: str, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    """Pieces (content, offset in characters, bytes of overlap). Dropping each piece's overlap gives ``text`` again."""
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("the limit must be at least 8 bytes and the overlap at most half of it")
    if _size(text) <= limit:
        return [(text, 0, 0)]
    pieces: list[tuple[str, int, int]] = []
    head, body, size, at = "", [], 0, 0  # overlap, parts, bytes of both, offset of the piece
    for part in _parts(text, limit - overlap):
        n = _size(part)
        if body and size + n > limit:
            whole = head + "".join(body)
            pieces.append((whole, at, _size(head)))
            raw = whole.encode("utf-8", "surrogatepass")
            cut = max(0, len(raw) - overlap)
            while cut < len(raw) and (raw[cut] & 0xC0 == 0x80 or raw[max(cut - 1, 0) : cut + 1] == b"\r\n"):
                cut += 1
            head = raw[cut:].decode("utf-8", "surrogatepass")
            at += len(whole) - len(head)
            body, size = [], len(raw) - cut
        body.append(part)
        size += n
    pieces.append((head + "".join(body), at, _size(head)))
    return pieces


def _splitter(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, start in b.itertuples(index=False, name=None):
                pieces = split_text(text, limit, overlap)
                line, seen = int(start), 0
                for k, (p, at, over) in enumerate(pieces):
                    line += text.count("\n", seen, at)
                    seen = at
                    n = p.count("\n")
                    out.append((i, k, len(pieces), p, line, line + n - p.endswith("\n"), _size(p), over))
            yield pd.DataFrame(out, columns=["id", "piece_no", "n_pieces", "content", "start_line", "end_line", "n_bytes", "overlap_bytes"])

    return run


def split_oversized(df: DataFrame, id_col: str = "id", text: str = "content", start_line: str = "start_line", limit: int = 4000, overlap: int = 600) -> DataFrame:
    """Pieces (id, piece_no from 0, n_pieces, content, start_line, end_line, n_bytes, overlap_bytes) of the items longer
    than ``limit`` bytes. Items within the limit, NULL texts and NULL ids give no rows; a NULL start line counts as 1; an
    item delivered twice with the same text is split once; extra columns are ignored.

    A piece that ends with a line end ends on that line, not on the next."""
    over = df.filter((F.octet_length(F.col(text)) > limit) & F.col(id_col).isNotNull())
    over = over.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("content"), F.coalesce(F.col(start_line).cast("int"), F.lit(1)).alias("start_line"))
    return over.dropDuplicates(["id", "start_line", "content"]).mapInPandas(_splitter(limit, overlap), PIECES)


def pieces_of_all(df: DataFrame, id_col: str = "id", text: str = "content", start_line: str = "start_line", limit: int = 4000, overlap: int = 600) -> DataFrame:
    """``split_oversized`` and, as one piece each, the items within the limit."""
    c = F.col(text)
    short = df.filter((F.octet_length(c) <= limit) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), c.alias("content"),
        F.coalesce(F.col(start_line).cast("int"), F.lit(1)).alias("start_line"),
        (F.coalesce(F.col(start_line).cast("int"), F.lit(1)) + F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) - F.when(c.endswith("\n"), 1).otherwise(0)).cast("int").alias("end_line"),
        F.octet_length(c).alias("n_bytes"), F.lit(0).alias("overlap_bytes"),
    ).dropDuplicates(["id"])
    return short.unionByName(split_oversized(df, id_col, text, start_line, limit, overlap))


def audited(df: DataFrame, limit: int = 4000, overlap: int = 600) -> DataFrame:
    """(id, within, complete, lines) of the oversized items of ``df`` (id, content, start_line): whether all pieces are within the limit, are
    together the text when each one's overlap is dropped, and stand on the lines that line ends counted in the text give. Computed from the
    pieces alone; a window holds the pieces of one item."""
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    p = split_oversized(df, limit=limit, overlap=overlap).withColumnRenamed("content", "piece").withColumnRenamed("start_line", "first")
    raw, n = F.encode("piece", "UTF-8"), F.col("overlap_bytes")
    p = p.withColumn("rest", F.decode(F.substring(raw, n + 1, F.octet_length("piece")), "UTF-8")).withColumn("head", F.decode(F.substring(raw, F.lit(1), n), "UTF-8"))
    before = F.coalesce(F.sum(lines(F.col("rest"))).over(Window.partitionBy("id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("line", before - lines(F.col("head")))
    last = F.col("first") + lines(F.col("piece")) - F.when(F.endswith("piece", F.lit("\n")), 1).otherwise(0)
    g = p.groupBy("id").agg(
        F.max("n_bytes").alias("most"), F.bool_and(F.octet_length("piece") == F.col("n_bytes")).alias("told"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "rest"))), lambda x: x["rest"]), "").alias("whole"),
        F.min(F.col("first") - F.col("line")).alias("lo"), F.max(F.col("first") - F.col("line")).alias("hi"), F.bool_and(last == F.col("end_line")).alias("ends"),
    )
    items = df.filter(F.col("id").isNotNull()).select("id", F.col("content"), F.coalesce(F.col("start_line").cast("int"), F.lit(1)).alias("start_line")).filter(F.octet_length("content") > limit).dropDuplicates(["id"])
    j = items.join(g, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return j.select("id", yes((F.col("most") <= limit) & F.col("told")).alias("within"), yes(F.col("whole") == F.col("content")).alias("complete"), yes((F.col("lo") == F.col("start_line")) & (F.col("hi") == F.col("start_line")) & F.col("ends")).alias("lines"))
