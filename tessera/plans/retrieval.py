"""Queries of full-text, vector and hybrid search, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import find_references, get_definition, list_symbols
from tessera.functions.embedders import ZeroEmbedder, embed_column
from tessera.functions.text import terms
from tessera.operators import fulltext as T
from tessera.operators import vectors as V
from tessera.operators.fusion import Filters, hybrid_search, keyword_search, rank_positions, reciprocal_rank_fusion
from tessera.session import shared_dir
from tessera.sources.tables import table

_FIELDS = ["id", "content", "start_line", "end_line", "symbol_name", "symbol_type", "project_root", "language"]


def chunks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Chunks, each once."""
    return table(spark, d, "chunks").select(*_FIELDS, *more).dropDuplicates(["id"])


def deliveries(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Chunks as delivered, some twice: searches reduce them after reading, when rows are small."""
    return table(spark, d, "chunks").select(*_FIELDS, *more)


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").dropDuplicates(["id"])


_INDEX: dict[tuple[str, str], str] = {}


def text_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the chunks of a folder, as they are written at ingest: the postings sorted by term, so that a query's terms
    are found by the statistics of few row groups, and one row of statistics. Built at the first query of an application, read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEX:
        path = f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
        p, lengths = T.build_postings(table(spark, d, "chunks").select("id", "content"))
        p.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        T.corpus_stats(lengths).write.parquet(f"{path}/statistics")
        _INDEX[key] = path
    return spark.read.parquet(f"{_INDEX[key]}/postings"), spark.read.parquet(f"{_INDEX[key]}/statistics")


_C = "c AS (SELECT DISTINCT id, content, start_line, end_line, symbol_name, symbol_type, project_root, language FROM chunks)"
_T = _C + r", t AS (SELECT id, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS w FROM c)"


def _term(t: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{t}'))"


def _prefix(t: str) -> str:
    return f"len(list_filter(w, lambda x: starts_with(x, '{t}')))"


def _phrase(*ts: str) -> str:
    return "len(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(ts)) + "))"


def _near(a: str, b: str, n: int) -> str:
    at = lambda t: f"list_filter(range(1, len(w) + 1), lambda i: w[i] = '{t}')"
    return f"len(list_filter({at(a)}, lambda p: len(list_filter({at(b)}, lambda q: abs(q - p) <= {n + 1})) > 0))"


def bm25(phrases: list[str], where: str, hits: list[str] | None = None) -> str:
    """CTEs ending in r (id, rank): ``phrases`` give occurrences, ``where`` tests f0, f1, ..., ``hits`` give what document frequencies count."""
    n = range(len(phrases))
    hits = hits or phrases
    score = " + ".join(f"(CASE WHEN ln((n_docs - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n_docs - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) END) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for k in n)
    return f"""{_T},
 f AS (SELECT id, len(w) AS dl, {", ".join(f"{p} AS f{k}" for k, p in enumerate(phrases))}, {", ".join(f"{p} AS h{k}" for k, p in enumerate(hits))} FROM t),
 s AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl, {", ".join(f"sum((h{k} > 0)::INT) AS n{k}" for k in n)} FROM f),
 r AS (SELECT id, -({score}) AS rank FROM f, s WHERE {where})"""


def _all(phrases: list[str], where: str, hits: list[str] | None = None) -> str:
    return f"WITH {bm25(phrases, where, hits)} SELECT id, round(rank, 6) AS rank FROM r"


_SEARCHES = {
    # name: (query, SQL)
    "fts_term": ("watcher", _all([_term("watcher")], "f0 > 0")),
    "fts_and": ("cache AND segment", _all([_term("cache"), _term("segment")], "f0 > 0 AND f1 > 0")),
    "fts_implicit_and": ("cache segment", _all([_term("cache"), _term("segment")], "f0 > 0 AND f1 > 0")),
    "fts_or": ("lease OR vault", _all([_term("lease"), _term("vault")], "f0 > 0 OR f1 > 0")),
    "fts_not": ("token NOT cache", _all([_term("token")], "f0 > 0 AND NOT h1 > 0").replace(" FROM t)", f", {_term('cache')} AS h1 FROM t)", 1)),
    "fts_phrase": ('"keyword search"', _all([_phrase("keyword", "search")], "f0 > 0")),
    "fts_bareword_phrase": ("keyword_search", _all([_phrase("keyword", "search")], "f0 > 0")),
    "fts_plus_phrase": ("search + returns", _all([_phrase("search", "returns")], "f0 > 0")),
    "fts_prefix": ("vec*", _all([_prefix("vec")], "f0 > 0")),
    "fts_near": ("NEAR(daemon segment, 4)", _all([_near("daemon", "segment", 4), _near("segment", "daemon", 4)], "f0 > 0 AND f1 > 0", [_term("daemon"), _term("segment")])),
    "fts_initial": ("^import", _all(["CASE WHEN w[1] = 'import' THEN 1 ELSE 0 END"], "f0 > 0")),
    "fts_column": ("content : watcher", _all([_term("watcher")], "f0 > 0")),
    "fts_grouping": ("(lease OR vault) AND cache", _all([_term("lease"), _term("vault"), _term("cache")], "(f0 > 0 OR f1 > 0) AND f2 > 0")),
    "fts_syntax_error_empty": ("What does the watcher do?", "SELECT 0::BIGINT AS id, 0.0::DOUBLE AS rank WHERE false"),
    "fts_other_column_empty": ("title : watcher", "SELECT 0::BIGINT AS id, 0.0::DOUBLE AS rank WHERE false"),
    "fts_blank_empty": ("  ", "SELECT 0::BIGINT AS id, 0.0::DOUBLE AS rank WHERE false"),
}
_BM = bm25([_term("cache"), _term("segment")], "f0 > 0 OR f1 > 0")
_QUERY = "cache OR segment"
_GOOD = "len(embedding) = 64 AND NOT isnan(list_sum(embedding)) AND isfinite(list_sum(embedding))"
_V = f"v AS (SELECT id, any_value(embedding) AS e FROM chunks WHERE {_GOOD} GROUP BY id), q AS (SELECT e AS qe FROM v ORDER BY id LIMIT 1), n AS (SELECT id, list_sum(list_transform(list_zip(e, qe), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance FROM v, q)"


def _search(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return T.search_postings(*text_index(spark, d), query).select("id", F.round("rank", 6).alias("rank"))

    return run


def fts_scan(spark, d):
    """A full-text query without an index: one pass over the texts."""
    return T.search_texts(deliveries(spark, d).select("id", "content"), _QUERY, once=False).select("id", F.round("rank", 6).alias("rank"))


def fts_tokens(spark, d):
    # counted in each text before anything is moved; a text delivered twice is counted once
    t = deliveries(spark, d).select("id", F.explode(terms(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    twice = table(spark, d, "chunks").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    return t.join(twice, "id").groupBy("term").agg(F.sum((F.col("n") / F.col("times")).cast("long")).alias("n"), F.count(F.lit(1)).alias("n_docs"))


def fts_postings(spark, d):
    p, _ = T.build_postings(table(spark, d, "chunks").select("id", "content"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("positions")).alias("n"), F.min(F.element_at("positions", 1)).alias("first_at"))


def bm25_topk(spark, d):
    return keyword_search(deliveries(spark, d), _QUERY, 10, index=text_index(spark, d), once=False).select("id", F.round("rank", 6).alias("rank"))


def bm25_index(spark, d):
    """The index built and read in one plan."""
    p, n = T.build_postings(table(spark, d, "chunks").select("id", "content"))
    return T.search_postings(p, T.corpus_stats(n), _QUERY).select("id", F.round("rank", 6).alias("rank"))


def bm25_filtered(spark, d):
    return keyword_search(deliveries(spark, d), _QUERY, 10, Filters("function", "python"), text_index(spark, d), once=False).select("id", F.round("rank", 6).alias("rank"))


def filter_counts(spark, d):
    """Chunks that pass each row of the filter table; '' filters nothing."""
    f = F.broadcast(table(spark, d, "filters").select("type_filter", F.col("language").alias("lang"), "scope"))  # 8 rows, fixed
    c = chunks(spark, d)
    ok = ((F.col("type_filter") == "") | (F.col("symbol_type") == F.col("type_filter"))) & ((F.col("lang") == "") | (F.col("language") == F.col("lang"))) & ((F.col("scope") == "") | (F.col("project_root") == F.col("scope")))
    g = c.groupBy("symbol_type", "language", "project_root").agg(F.count(F.lit(1)).alias("m"))  # counted before the filters meet it
    return f.join(g, ok, "left").groupBy("type_filter", F.col("lang").alias("language"), "scope").agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n"))


def _usable(spark, d):
    v = table(spark, d, "chunks").select("id", "embedding").dropDuplicates(["id"])
    return v.filter((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _probe(spark, d):
    """The query vector: that of the smallest usable id."""
    r = _usable(spark, d).orderBy("id").limit(1).collect()
    return [float(x) for x in r[0]["embedding"]] if r else []


def knn_l2(spark, d):
    q = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return V.nearest(table(spark, d, "embeddings"), list(q["embedding"]) if q else [], 10, "vec_id").select("id", F.round("distance", 6).alias("distance"))


def knn_chunks(spark, d):
    return V.nearest(_usable(spark, d), _probe(spark, d), 10).select("id", F.round("distance", 6).alias("distance"))


def knn_dim_guard(spark, d):
    return V.nearest(_usable(spark, d), [0.0] * 32, 10).select("id", F.round("distance", 6).alias("distance"))


def knn_lsh(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()
    return V.approximate(v, list(map(float, q["embedding"])), 10, "vec_id").select("id", F.round("distance", 6).alias("distance"))


def _newest(mode):
    def run(spark, d):
        return V.searchable(chunks(spark, d, "file_id", "embedding"), files(spark, d), mode).select("id", "last_modified")

    return run


def stored_dimension(spark, d):
    return V.stored_dimension(table(spark, d, "embeddings"), "embedding")


def l2_normalise(spark, d):
    n = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.normalised(F.col("embedding"))).alias("pos", "x"))
    return n.select("vec_id", "pos", F.round("x", 6).alias("x"))


def mean_pool(spark, d):
    p = V.mean_pooled(table(spark, d, "embeddings"), "label", "embedding")
    return p.select("label", F.posexplode("pooled").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def dummy_embed(spark, d):
    e = embed_column(F.col("content"), ZeroEmbedder())
    return chunks(spark, d).select("id", F.size(e).alias("dimension"), F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


def _legs(spark, d, k):
    near = V.nearest(_usable(spark, d), _probe(spark, d), k)
    words = keyword_search(deliveries(spark, d), _QUERY, k, index=text_index(spark, d), once=False)
    return rank_positions(near, "distance", "id"), rank_positions(words, "rank", "id")


def rrf(spark, d):
    return reciprocal_rank_fusion(*_legs(spark, d, 20)).select("id", F.round("score", 9).alias("score"))


def _hybrid(spark, d, query=_QUERY, vector=None, filters=Filters(), prefilter=False, limit=10):
    h = hybrid_search(deliveries(spark, d, "embedding"), query, _probe(spark, d) if vector is None else vector, limit, filters, prefilter, vectors=_usable(spark, d).join(filters.apply(deliveries(spark, d)).select("id", "symbol_type", "language", "project_root").dropDuplicates(["id"]), "id") if prefilter else _usable(spark, d), index=text_index(spark, d), once=False)
    return h.select("id", "start_line", "end_line", "symbol_name", "symbol_type", F.round("score", 6).alias("score"), "type")


def hybrid(spark, d):
    return _hybrid(spark, d)


def hybrid_scan(spark, d):
    """Hybrid search whose keyword leg reads the texts."""
    h = hybrid_search(deliveries(spark, d, "embedding"), _QUERY, _probe(spark, d), 10, vectors=_usable(spark, d), once=False)
    return h.select("id", "start_line", "end_line", "symbol_name", "symbol_type", F.round("score", 6).alias("score"), "type")


def hybrid_postfilter(spark, d):
    return _hybrid(spark, d, filters=Filters(language="python"))


def hybrid_prefilter(spark, d):
    return _hybrid(spark, d, filters=Filters(language="python"), prefilter=True)


def hybrid_fallback(spark, d):
    return _hybrid(spark, d, vector=[])


def hybrid_keyword_error(spark, d):
    """A keyword leg with a syntax error adds nothing."""
    return _hybrid(spark, d, query="What is cached?")


def references(spark, d):
    links = table(spark, d, "symbol_links").dropDuplicates(["id"])
    return find_references(chunks(spark, d), links, "emit_metric").select("id", "start_line", "end_line", "symbol_name")


def reference_counts(spark, d):
    links = table(spark, d, "symbol_links").select("id", "from_chunk_id", "to_symbol_name").dropDuplicates(["id"]).filter("to_symbol_name <> ''")
    # counted per (chunk, symbol) before the join, so a symbol that a third of the links name is small when it is shuffled
    n = links.groupBy("from_chunk_id", "to_symbol_name").agg(F.count(F.lit(1)).alias("n")).join(chunks(spark, d).select(F.col("id").alias("from_chunk_id")), "from_chunk_id", "left_semi")
    return n.groupBy("to_symbol_name").agg(F.sum("n").alias("n_calls"), F.count(F.lit(1)).alias("n_chunks"))


_SYMBOL = "SELECT min(symbol_name) AS s FROM c WHERE symbol_type = 'function' AND regexp_matches(symbol_name, '^[a-z]+_[a-z]+_[a-z]+_[a-z]+$')"


def definition(spark, d):
    c = chunks(spark, d)
    s = c.filter((F.col("symbol_type") == "function") & F.col("symbol_name").rlike("^[a-z]+_[a-z]+_[a-z]+_[a-z]+$")).agg(F.min("symbol_name")).first()[0]
    return get_definition(c, s or "", text_index(spark, d)).select("id", "start_line", "symbol_name", "symbol_type", F.round("rank", 6).alias("rank"))


def outline(spark, d):
    f = files(spark, d)
    path = f.filter(F.col("path").endswith(".py")).agg(F.min("path")).first()[0]
    return list_symbols(chunks(spark, d, "file_id"), f, path)


QUERIES = {n: _search(q) for n, (q, _) in _SEARCHES.items()}
QUERIES |= {
    "fts_scan": fts_scan, "fts_tokens": fts_tokens, "fts_postings": fts_postings, "bm25_topk": bm25_topk, "bm25_index": bm25_index, "bm25_filtered": bm25_filtered, "filter_counts": filter_counts,
    "knn_l2": knn_l2, "knn_chunks": knn_chunks, "knn_dim_guard": knn_dim_guard, "knn_lsh": knn_lsh, "vectors_ram": _newest("RAM"), "vectors_hybrid": _newest("HYBRID"), "vectors_disk": _newest("DISK"),
    "stored_dimension": stored_dimension, "l2_normalise": l2_normalise, "mean_pool": mean_pool, "dummy_embed": dummy_embed, "rrf": rrf, "hybrid_search": hybrid, "hybrid_scan": hybrid_scan, "hybrid_postfilter": hybrid_postfilter,
    "hybrid_prefilter": hybrid_prefilter, "hybrid_fallback": hybrid_fallback, "hybrid_keyword_error": hybrid_keyword_error, "references": references, "reference_counts": reference_counts, "definition": definition, "list_symbols": outline,
}

_RRF = f"""WITH {_BM}, {_V},
 a AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rn FROM (SELECT * FROM n ORDER BY distance, id LIMIT 20)),
 b AS (SELECT id, row_number() OVER (ORDER BY rank, id) AS rn FROM (SELECT * FROM r ORDER BY rank, id LIMIT 20)),
 u AS (SELECT id, sum(1.0::DOUBLE / (60 + rn)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)"""
_HYBRID = _RRF + """, h AS (SELECT * FROM u ORDER BY score DESC, id LIMIT 10)
SELECT c.id, start_line, end_line, symbol_name, symbol_type, round(score, 6) AS score, 'hybrid' AS type FROM h JOIN c ON c.id = h.id"""
_LANG = "SELECT DISTINCT id FROM chunks WHERE language = 'python'"
_ORDER = "FROM (SELECT id, any_value(file_id) AS file_id, any_value(embedding) AS embedding FROM chunks GROUP BY id) c JOIN (SELECT DISTINCT id, last_modified FROM files) f ON f.id = c.file_id WHERE len(embedding) > 0 ORDER BY last_modified DESC, c.id LIMIT"
_DEF = f"{_T}, y AS ({_SYMBOL}), z AS (SELECT string_split(s, '_') AS p FROM y), f AS (SELECT id, len(w) AS dl, len(list_filter(range(1, len(w) + 1), lambda i: w[i] = p[1] AND w[i + 1] = p[2] AND w[i + 2] = p[3] AND w[i + 3] = p[4])) AS f0 FROM t, z), s AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl, sum((f0 > 0)::INT) AS n0 FROM f), r AS (SELECT id, -(ln((n_docs - n0 + 0.5::DOUBLE) / (n0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS rank FROM f, s WHERE f0 > 0)"

ORACLE_SQL = {n: sql for n, (_, sql) in _SEARCHES.items()}
ORACLE_SQL |= {
    "fts_tokens": f"WITH {_T} SELECT term, count(*) AS n, count(DISTINCT id) AS n_docs FROM (SELECT id, unnest(w) AS term FROM t) GROUP BY term",
    "fts_postings": f"WITH {_T} SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n, min(pos) AS first_at FROM (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t) GROUP BY term",
    "bm25_topk": f"WITH {_BM} SELECT id, round(rank, 6) AS rank FROM (SELECT * FROM r ORDER BY rank, id LIMIT 10)",
    "bm25_index": f"WITH {_BM} SELECT id, round(rank, 6) AS rank FROM r",
    "fts_scan": f"WITH {_BM} SELECT id, round(rank, 6) AS rank FROM r",
    "bm25_filtered": f"WITH {_BM} SELECT id, round(rank, 6) AS rank FROM (SELECT r.* FROM r JOIN c ON c.id = r.id WHERE symbol_type = 'function' AND language = 'python' ORDER BY rank, id LIMIT 10)",
    "filter_counts": f"WITH {_C} SELECT type_filter, filters.language, scope, count(c.id) AS n FROM filters LEFT JOIN c ON (type_filter = '' OR symbol_type = type_filter) AND (filters.language = '' OR c.language = filters.language) AND (scope = '' OR project_root = scope) GROUP BY 1, 2, 3",
    "knn_l2": "SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY d, vec_id LIMIT 10)",
    "knn_chunks": f"WITH {_V} SELECT id, round(distance, 6) AS distance FROM n ORDER BY n.distance, id LIMIT 10",
    "knn_dim_guard": "SELECT 0::BIGINT AS id, 0.0::DOUBLE AS distance WHERE false",
    "vectors_ram": f"SELECT c.id, last_modified {_ORDER} 100000",
    "vectors_hybrid": f"SELECT c.id, last_modified {_ORDER} 1000",
    "vectors_disk": "SELECT 0::BIGINT AS id, 0::BIGINT AS last_modified WHERE false",
    "stored_dimension": "SELECT coalesce(max(len(embedding)), 0)::INT AS dimension FROM embeddings",
    "l2_normalise": "SELECT vec_id, (pos - 1)::INT AS pos, round(x / (n + 1e-9), 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM embeddings)",
    "mean_pool": "SELECT label, (pos - 1)::INT AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos",
    "dummy_embed": "SELECT DISTINCT id, 384 AS dimension, 0.0::DOUBLE AS total FROM chunks",
    "rrf": _RRF + " SELECT id, round(score, 9) AS score FROM u",
    "hybrid_search": _HYBRID,
    "hybrid_scan": _HYBRID,
    "hybrid_postfilter": _HYBRID.replace("FROM r ORDER", f"FROM r WHERE id IN ({_LANG}) ORDER") + " WHERE language = 'python'",
    "hybrid_prefilter": _HYBRID.replace("FROM n ORDER", f"FROM n WHERE id IN ({_LANG}) ORDER").replace("FROM r ORDER", f"FROM r WHERE id IN ({_LANG}) ORDER"),
    "hybrid_fallback": f"WITH {_BM} SELECT c.id, start_line, end_line, symbol_name, symbol_type, round(rank, 6) AS score, 'keyword' AS type FROM (SELECT * FROM r ORDER BY rank, id LIMIT 10) k JOIN c ON c.id = k.id",
    "hybrid_keyword_error": f"WITH {_C}, {_V}, a AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rn FROM n) SELECT c.id, start_line, end_line, symbol_name, symbol_type, round(1.0::DOUBLE / (60 + rn), 6) AS score, 'hybrid' AS type FROM a JOIN c ON c.id = a.id WHERE rn <= 10",
    "references": f"WITH {_C} SELECT c.id, start_line, end_line, symbol_name FROM (SELECT DISTINCT id, from_chunk_id FROM symbol_links WHERE to_symbol_name = 'emit_metric') l JOIN c ON c.id = l.from_chunk_id",
    "reference_counts": f"WITH {_C} SELECT to_symbol_name, count(*) AS n_calls, count(DISTINCT from_chunk_id) AS n_chunks FROM (SELECT DISTINCT id, from_chunk_id, to_symbol_name FROM symbol_links WHERE to_symbol_name <> '') l JOIN c ON c.id = l.from_chunk_id GROUP BY 1",
    "definition": f"WITH {_DEF}, b AS (SELECT c.*, rank, CASE WHEN symbol_type = 'function' THEN 0 ELSE 1 END AS k FROM r JOIN c ON c.id = r.id WHERE symbol_type IN ('function', 'class') ORDER BY k, rank, c.id LIMIT 1) SELECT id, start_line, symbol_name, symbol_type, round(rank, 6) AS rank FROM b",
    "list_symbols": "SELECT symbol_name AS name, symbol_type AS type, start_line AS line FROM (SELECT DISTINCT id, file_id, symbol_name, symbol_type, start_line FROM chunks) c WHERE symbol_name <> '' AND file_id = (SELECT id FROM files WHERE path = (SELECT min(path) FROM files WHERE path LIKE '%.py') LIMIT 1)",
}
