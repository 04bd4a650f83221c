"""Hybrid search: the keyword and the vector ranking fused by reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fulltext import search_postings, search_texts, top
from tessera.operators.vectors import nearest
from tessera.schema import LIMIT, OVERFETCH, RRF_K
from tessera.session import pinned


@dataclass(frozen=True)
class Filters:
    """'' or None means no filter."""

    type_filter: str | None = None
    language: str | None = None
    scope: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for c, v in (("symbol_type", self.type_filter), ("language", self.language), ("project_root", self.scope)):
            if v:
                df = df.filter(F.col(c) == v)
        return df


def rank_positions(df: DataFrame, *order) -> DataFrame:
    """(id, rn) of a short ranked list (it was cut to a limit before, so one task may number it)."""
    return df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn"))


def reciprocal_rank_fusion(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) of ranked lists (id, rn): the sum of 1 / (k + rn) over the lists an id is in."""
    u = lists[0].select("id", "rn")
    for x in lists[1:]:
        u = u.unionByName(x.select("id", "rn"))
    return u.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rn"))).alias("score"))


def keyword_search(chunks: DataFrame, query: str, limit: int = LIMIT, filters: Filters = Filters(), index: tuple[DataFrame, DataFrame] | None = None, once: bool = True) -> DataFrame:
    """(id, rank) of the best ``limit`` chunks that pass the filters; the statistics are those of all chunks. ``once``: chunks have each id
    once."""
    hits = search_postings(index[0], index[1], query) if index else search_texts(chunks, query, once=once)
    if filters != Filters():
        hits = hits.join(filters.apply(chunks).select("id"), "id", "left_semi")
    return top(hits, limit)


def hybrid_search(
    chunks: DataFrame, query: str, vector: list[float] | None, limit: int = LIMIT, filters: Filters = Filters(), prefilter: bool = False, vectors: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None, once: bool = True
) -> DataFrame:
    """(id, content, start_line, end_line, symbol_name, symbol_type, score, type): the best ``limit`` chunks of both rankings.

    Each ranking gives 2 x limit candidates; filters hold for the keyword ranking before its cut and for the fused list after
    it, so fewer than ``limit`` can be left (``prefilter`` applies them to the vector ranking too). If nothing is left, or
    there is no vector, the keyword ranking alone answers (type 'keyword', its rank as score).

    The two rankings run here, once, as they are cut to 2 x limit rows; the chunks are then fetched by their ids, which
    reaches the scan as a filter."""
    fields = ["id", "content", "start_line", "end_line", "symbol_name", "symbol_type"]
    words = pinned(keyword_search(chunks, query, OVERFETCH * limit if vector else limit, filters, index, once))

    def fetch(ranked: DataFrame, kind: str, some: Filters) -> DataFrame:
        ranked = pinned(ranked)
        rows = some.apply(chunks).filter(F.col("id").isin([r["id"] for r in ranked.collect()])).select(*fields)
        return (rows if once else rows.dropDuplicates(["id"])).join(F.broadcast(ranked), "id").select(*fields, "score", F.lit(kind).alias("type"))

    if vector:
        pool = chunks if vectors is None else vectors
        near = pinned(nearest(filters.apply(pool) if prefilter else pool, vector, OVERFETCH * limit))
        fused = reciprocal_rank_fusion(rank_positions(near, "distance", "id"), rank_positions(words, "rank", "id")).orderBy(F.desc("score"), "id").limit(limit)
        hybrid = pinned(fetch(fused, "hybrid", filters))
        if not hybrid.isEmpty():
            return hybrid
    return fetch(top(words, limit).withColumnRenamed("rank", "score"), "keyword", Filters())
