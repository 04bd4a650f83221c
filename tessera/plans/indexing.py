"""Queries of scans, changes, chunks, symbols and events, and their SQL twins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import status
from tessera.functions import text as X
from tessera.functions.wordpiece import encode_column
from tessera.index import call_table, chunk_files, symbol_table
from tessera.operators import chunking as K
from tessera.operators import store as S
from tessera.plans.retrieval import chunks, deliveries, files
from tessera.schema import CHUNKS, FILES
from tessera.session import shared_dir
from tessera.sources.scan import assign_root, scan_tree, snapshot_events, with_hash
from tessera.sources.tables import table
from tessera.streaming import ingest as I


_FIRST, _SECOND, _UNWATCHED = "2025-09-01", "2026-03-01", "/srv/code/ledger"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, path, project_root, text): files put together from their chunks."""
    c = table(spark, d, "chunks").filter("file_id is not null").groupBy("file_id").agg(F.collect_list(F.struct("start_line", "id", "content")).alias("p"))
    c = c.select("file_id", F.array_join(F.transform(F.array_sort(F.array_distinct("p")), lambda x: x["content"]), "\n").alias("text"))
    return c.join(files(spark, d).select(F.col("id").alias("file_id"), "path", "project_root", "hash"), "file_id")


def _observed(spark, d):
    """What the last event until a day says of each path that lives: (path, size, last_modified, hash, project_root)."""
    e = I.live_paths(table(spark, d, "file_events").filter(F.col("ts") < F.lit(_SECOND).cast("timestamp_ntz"))).select("path", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("last_modified"))
    f = files(spark, d).select("path", "size", "project_root")
    return e.join(f, "path", "left").select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "last_modified", F.sha2("path", 256).alias("hash"), "project_root")


def _deleted(spark, d):
    """Paths that events end, and those of a project that is no longer watched."""
    gone = I.latest_events(table(spark, d, "file_events")).filter(F.col("event_type").isin(*I.GONE)).select("path")
    return gone.unionByName(files(spark, d).filter(F.col("project_root") == _UNWATCHED).select("path"))


def _state(spark, d, until):
    e = I.live_paths(table(spark, d, "file_events").filter(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return e.select("path", F.lit(0).cast("long").alias("size"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("last_modified"))


def _tables(spark, d):
    return {"files": files(spark, d), "chunks": chunks(spark, d, "file_id"), "symbol_links": table(spark, d, "symbol_links").dropDuplicates(["id"])}


def scan_binary_hash(spark, d):
    """Digests of the folder's own parquet files, read as binary."""
    return with_hash(scan_tree(spark, d, [])).select(X.file_name(F.col("path")).alias("name"), "size", "hash")


def list_files(spark, d):
    return files(spark, d).select("path")


def point_lookup(spark, d):
    p = table(spark, d, "files").agg(F.min("path")).first()[0]
    return files(spark, d).filter(F.col("path") == p).select("id", "size", "last_modified", "hash")


def chunk_lookup(spark, d):
    i = table(spark, d, "chunks").agg(F.max("id")).first()[0]
    return chunks(spark, d).filter(F.col("id") == i)


def read_resource(spark, d):
    p = table(spark, d, "files").filter("is_indexed = 1").agg(F.min("path")).first()[0]
    return _texts(spark, d).filter(F.col("path") == p).select(X.uri(F.col("path")).alias("uri"), "text")


def sha256(spark, d):
    return _texts(spark, d).select("file_id", F.sha2("text", 256).alias("hash"))


def ext_language(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", X.language(p).alias("language"), X.has_symbols(p).alias("has_symbols"))


def ext_whitelist(spark, d):
    return files(spark, d).filter(X.is_indexed_type(F.col("path"))).select("path")


_GLOBS = [*X.IGNORED, "docs", "*_test.*", "vendor*", "config", "?.txt"]


def ignore_glob(spark, d):
    return files(spark, d).filter("project_root is not null").filter(X.ignored(F.col("path"), F.col("project_root"), _GLOBS)).select("path")


def project_root_prefix_join(spark, d):
    """Roots are tried in the order of their names; at most some hundred of them."""
    r = table(spark, d, "files").filter("project_root is not null").select("project_root").distinct()
    r = S.number_rows(r, ["project_root"], "ordinal").select("ordinal", F.col("project_root").alias("root"))
    return assign_root(table(spark, d, "file_events").select("path").distinct(), r).select("path", "project_root")


def metadata_change(spark, d):
    return S.changed_by_metadata(_observed(spark, d), files(spark, d)).select("path", "size", "last_modified")


def hash_change(spark, d):
    o = _texts(spark, d).select("path", F.sha2(F.concat("text", F.when(F.length("text") % 7 == 0, F.lit("\n")).otherwise(F.lit(""))), 256).alias("hash"))
    return S.changed_by_hash(o, files(spark, d)).select("path", "hash")


def upsert_files(spark, d):
    return S.upsert_files(files(spark, d), _observed(spark, d))


def insert_chunks(spark, d):
    new = S.number_rows(table(spark, d, "files").select("path").distinct(), ["path"], "n").select("path", F.lit(0).alias("ordinal"), F.concat(F.lit("# "), "path").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return S.insert_chunks(chunks(spark, d, "file_id"), files(spark, d), new, replace=False).select("id", "file_id", "content", "start_line", "end_line")


def delete_file_anti(spark, d):
    return S.delete_files(_tables(spark, d), _deleted(spark, d))["files"].select("id", "path")


def delete_chunks_anti(spark, d):
    return S.delete_files(_tables(spark, d), _deleted(spark, d))["chunks"].select("id", "file_id")


def delete_links_anti(spark, d):
    return S.delete_files(_tables(spark, d), _deleted(spark, d))["symbol_links"].select("id", "from_chunk_id")


def delete_fts_semi(spark, d):
    """Chunks whose index entries go when the files do."""
    gone = files(spark, d).join(_deleted(spark, d), "path", "left_semi").select(F.col("id").alias("file_id"))
    return chunks(spark, d, "file_id").join(gone, "file_id", "left_semi").select("id")


def set_indexed(spark, d):
    p = table(spark, d, "files").filter("is_indexed = 0").agg(F.min("path")).first()[0]
    return S.set_indexed(files(spark, d), p or "").select("id", "is_indexed")


def wipe(spark, d):
    w = S.wipe_chunks(_tables(spark, d))
    return w["files"].agg(F.count(F.lit(1)).alias("n_files"), F.sum("is_indexed").alias("n_indexed")).crossJoin(w["chunks"].agg(F.count(F.lit(1)).alias("n_chunks"))).crossJoin(w["symbol_links"].agg(F.count(F.lit(1)).alias("n_links")))  # one row each


def status_counts(spark, d):
    v = table(spark, d, "chunks").select("id", "embedding").dropDuplicates(["id"]).filter(F.size("embedding") > 0)
    return status(files(spark, d), chunks(spark, d), v).drop("watch_paths")


def migrate_schema(spark, d):
    old = table(spark, d, "chunks").select("id", "file_id", "content", "start_line", "end_line").dropDuplicates(["id"])
    return S.migrate(old, CHUNKS).select("id", "file_id", "symbol_name", "symbol_type", "project_root", "language")


def migrate_files(spark, d):
    return S.migrate(files(spark, d).drop("project_root"), FILES)


def newline_count(spark, d):
    return deliveries(spark, d).select("id", X.newlines(F.col("content")).alias("n")).distinct()  # counts are moved, not texts


def line_span(spark, d):
    """Chunks whose lines disagree with their newlines."""
    return deliveries(spark, d).filter(F.col("end_line") - F.col("start_line") != X.newlines(F.col("content"))).select("id").distinct()


def chunk_recursive(spark, d):
    return K.chunk_table(table(spark, d, "documents"), "doc_id", "text")


def chunk_recursive_small(spark, d):
    return K.chunk_table(table(spark, d, "documents"), "doc_id", "text", 200, 30)


def chunk_lines(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(K.line_chunks(F.col("text"), 20, 5)).alias("ordinal", "c"))
    return c.select("doc_id", "ordinal", "c.start_line", "c.end_line", "c.content")


def chunk_breakpoints(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.length("text") / 150)).cast("int")), lambda k: k * 150).alias("bps"))
    return K.breakpoint_chunks(t, "doc_id", "text", "bps", 1000, 100)


_WORDS = ["[PAD]", *[f"[unused{k}]" for k in range(99)], "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz0123456789", *["##" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789"], "token", "##token", "cache", "search", "##ing", "##er", "##ed", "##s", "the"]
_VOCABULARY = {w: k for k, w in enumerate(_WORDS)}


def wordpiece(spark, d):
    """Ids over a vocabulary of the alphabet and common endings."""
    ids = encode_column(F.col("content"), _VOCABULARY)
    return deliveries(spark, d).select("id", F.size(ids).alias("n"), F.hash(ids).alias("h")).distinct()


def wordpiece_bounds(spark, d):
    """What holds of any text's ids: the markers at both ends, at most 512 ids, none of a piece that is not in the vocabulary."""
    ids = F.col("ids")
    e = deliveries(spark, d).select("id", encode_column(F.col("content"), _VOCABULARY).alias("ids"))
    ok = (F.element_at(ids, 1) == 101) & (F.element_at(ids, -1) == 102) & (F.size(ids) <= 512) & F.forall(ids, lambda x: (x >= 100) & (x < len(_WORDS)))
    return e.select("id", ok.alias("ok")).distinct()


def chunk_recursive_bounds(spark, d):
    """What holds of any text's pieces: each is in the text, the first begins it, the last ends it, and lines go up."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text <> ''")
    p = docs.select("doc_id", "text", F.explode(K.recursive_chunks(F.col("text"), 200, 30)).alias("c"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    g = p.groupBy("doc_id").agg(
        F.bool_and(F.contains(F.col("text"), F.col("c.content"))).alias("inside"), F.bool_and((F.col("c.start_line") >= 1) & (F.col("c.end_line") >= F.col("c.start_line"))).alias("lines"),
        F.max(F.col("c.end_line")).alias("last"), F.first(X.newlines(F.rtrim(F.col("text"))) + 1).alias("n"), F.first(bare(F.col("text"))).alias("t"), F.array_join(F.collect_list(bare(F.col("c.content"))), "").alias("all"),
    )
    return g.select("doc_id", (F.col("inside") & F.col("lines") & (F.length("all") >= F.length("t"))).alias("ok"))


def symbols_extract(spark, d):
    f = _texts(spark, d).withColumn("language", X.language(F.col("path")))
    return symbol_table(f).select("path", "ordinal", "symbol_name", "symbol_type", "start_line", "end_line")


def calls_extract(spark, d):
    f = _texts(spark, d).withColumn("language", X.language(F.col("path")))
    return call_table(f).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))


def index_files(spark, d):
    """The fallback chain: symbols, else packed pieces."""
    return chunk_files(_texts(spark, d)).select("path", "ordinal", "start_line", "end_line", "symbol_name", "symbol_type", "language")


def first_chunk_links(spark, d):
    f = _texts(spark, d).withColumn("language", X.language(F.col("path")))
    return S.first_chunk_links(chunks(spark, d, "file_id"), call_table(f, "file_id", "long")).groupBy("from_chunk_id", "to_symbol_name").agg(F.count(F.lit(1)).alias("n"))


def event_latest_state(spark, d):
    return I.latest_events(table(spark, d, "file_events"))


def event_windows(spark, d):
    return I.event_counts(table(spark, d, "file_events"))


def snapshot_diff(spark, d):
    """Between the states of two days."""
    return snapshot_events(_state(spark, d, _FIRST), _state(spark, d, _SECOND))


def stream_ingest(spark, d):
    """The event file as a stream, batch by batch into a state that the last writer wins. The state is committed to a store together with
    the batch's number, so that a batch that is repeated after a restart changes nothing."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = f"{d}/file_events.parquet"
    stream = I.event_stream(spark, src if os.path.isdir(src) else os.path.join(d, "file_events.parque[t]"), 4)
    store = S.Store(spark, f"{base}/store")
    empty = spark.createDataFrame([], "path string, event_type string, ts timestamp_ntz")

    def apply(batch: DataFrame, number: int) -> None:
        state = store.table("state") if "state" in store.versions() else empty
        store.commit({"state": I.merge_state(state, batch)}, ("events", number))

    I.run_stream(stream, f"{base}/checkpoint", apply)
    return store.table("state") if "state" in store.versions() else empty


QUERIES = {
    f.__name__: f
    for f in (
        scan_binary_hash, list_files, point_lookup, chunk_lookup, read_resource, sha256, ext_language, ext_whitelist, ignore_glob, project_root_prefix_join, metadata_change, hash_change, upsert_files, insert_chunks, delete_file_anti, delete_chunks_anti,
        delete_links_anti, delete_fts_semi, set_indexed, wipe, status_counts, migrate_schema, migrate_files, newline_count, line_span, chunk_recursive, chunk_recursive_small, chunk_lines, chunk_breakpoints, chunk_recursive_bounds, wordpiece, wordpiece_bounds, symbols_extract, calls_extract,
        index_files, first_chunk_links, event_latest_state, event_windows, snapshot_diff, stream_ingest,
    )
}

_F = "f AS (SELECT DISTINCT * FROM files)"
_TXT = "x AS (SELECT file_id, string_agg(content, chr(10) ORDER BY start_line) AS text FROM (SELECT DISTINCT id, file_id, start_line, content FROM chunks) GROUP BY file_id)"
_until = lambda name, day: f"{name} AS (SELECT path, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, coalesce(received_at, ts) DESC, (event_type IN ('Deleted', 'Renamed')) DESC, event_type DESC) AS rn FROM file_events WHERE path IS NOT NULL AND ts < '{day}') WHERE rn = 1)"
_EV = _until("e", "9999-01-01")
_OBS = f"{_F}, {_until('e', _SECOND)}, o AS (SELECT e.path, coalesce(f.size, 0) AS size, epoch_ms(ts) AS last_modified, sha256(e.path) AS hash, f.project_root FROM e LEFT JOIN f ON f.path = e.path WHERE event_type NOT IN ('Deleted', 'Renamed'))"
_GONE = f"{_F}, {_EV}, g AS (SELECT f.id FROM f LEFT JOIN e ON e.path = f.path WHERE event_type IN ('Deleted', 'Renamed') OR project_root = '{_UNWATCHED}')"
_EXT = r"regexp_extract(path, '\.([^./]+)$', 1)"
_CASE = f"CASE WHEN {_EXT} = '' THEN 'unknown' " + " ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + f" ELSE {_EXT} END"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_IGN = "^(?:" + "|".join(X.glob_regex(g) for g in _GLOBS) + ")$"
ORACLE_SQL = {
    "list_files": "SELECT DISTINCT path FROM files",
    "point_lookup": "SELECT DISTINCT id, size, last_modified, hash FROM files WHERE path = (SELECT min(path) FROM files)",
    "chunk_lookup": "SELECT DISTINCT id, content, start_line, end_line, symbol_name, symbol_type, project_root, language FROM chunks WHERE id = (SELECT max(id) FROM chunks)",
    "read_resource": f"WITH {_F}, {_TXT} SELECT 'tessera://' || path AS uri, text FROM f JOIN x ON x.file_id = f.id WHERE path = (SELECT min(path) FROM files WHERE is_indexed = 1)",
    "sha256": f"WITH {_F} SELECT id AS file_id, hash FROM f WHERE id IN (SELECT file_id FROM chunks)",
    "ext_language": f"SELECT DISTINCT path, {_CASE} AS language, {_EXT} IN {_in(X.WITH_SYMBOLS)} AS has_symbols FROM files",
    "ext_whitelist": f"SELECT DISTINCT path FROM files WHERE {_EXT} IN {_in(X.INDEXED)}",
    "ignore_glob": f"SELECT DISTINCT path FROM files WHERE len(list_filter(string_split(substr(path, length(project_root) + 2), '/'), lambda p: regexp_matches(p, '{_IGN}'))) > 0",
    "project_root_prefix_join": "WITH p AS (SELECT DISTINCT path FROM file_events), r AS (SELECT DISTINCT project_root FROM files WHERE project_root IS NOT NULL) SELECT p.path, min(project_root) AS project_root FROM p LEFT JOIN r ON starts_with(p.path, project_root) GROUP BY 1",
    "metadata_change": f"WITH {_OBS} SELECT o.path, o.size, o.last_modified FROM o LEFT JOIN f ON f.path = o.path WHERE f.path IS NULL OR f.size IS DISTINCT FROM o.size OR f.last_modified IS DISTINCT FROM o.last_modified OR coalesce(f.is_indexed, 0) <> 1",
    "hash_change": f"WITH {_F}, {_TXT}, o AS (SELECT path, hash AS old, sha256(text || CASE WHEN length(text) % 7 = 0 THEN chr(10) ELSE '' END) AS hash FROM f JOIN x ON x.file_id = f.id) SELECT path, hash FROM o WHERE old IS DISTINCT FROM hash",
    "upsert_files": f"WITH {_OBS} SELECT f.path, coalesce(o.hash, f.hash) AS hash, coalesce(o.last_modified, f.last_modified) AS last_modified, coalesce(o.size, f.size) AS size, CASE WHEN o.path IS NULL THEN is_indexed ELSE 0 END AS is_indexed, f.project_root, f.id FROM f LEFT JOIN o ON o.path = f.path UNION ALL SELECT path, hash, last_modified, size, 0, project_root, (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path) FROM o WHERE path NOT IN (SELECT path FROM f)",
    "insert_chunks": f"WITH {_F} SELECT DISTINCT id, file_id, content, start_line, end_line FROM chunks UNION ALL SELECT (SELECT max(id) FROM chunks) + row_number() OVER (ORDER BY path), id, '# ' || path, 1, 1 FROM f",
    "delete_file_anti": f"WITH {_GONE} SELECT id, path FROM f WHERE id NOT IN (SELECT id FROM g)",
    "delete_chunks_anti": f"WITH {_GONE} SELECT DISTINCT id, file_id FROM chunks WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g)",
    "delete_links_anti": f"WITH {_GONE} SELECT DISTINCT id, from_chunk_id FROM symbol_links WHERE from_chunk_id IS NULL OR from_chunk_id NOT IN (SELECT id FROM chunks WHERE file_id IN (SELECT id FROM g))",
    "delete_fts_semi": f"WITH {_GONE} SELECT DISTINCT id FROM chunks WHERE file_id IN (SELECT id FROM g)",
    "set_indexed": f"WITH {_F} SELECT id, CASE WHEN path = (SELECT min(path) FROM files WHERE is_indexed = 0) THEN 1 ELSE is_indexed END AS is_indexed FROM f",
    "wipe": "SELECT count(DISTINCT id) AS n_files, 0::BIGINT AS n_indexed, 0::BIGINT AS n_chunks, 0::BIGINT AS n_links FROM files",
    "status_counts": "SELECT (SELECT count(DISTINCT id) FROM files) AS total_files, (SELECT count(DISTINCT id) FROM chunks) AS total_chunks, (SELECT count(DISTINCT id) FROM chunks WHERE len(embedding) > 0) AS memory_items, 0::BIGINT AS queue_size",
    "migrate_schema": "SELECT DISTINCT id, file_id, NULL::VARCHAR AS symbol_name, NULL::VARCHAR AS symbol_type, NULL::VARCHAR AS project_root, NULL::VARCHAR AS language FROM chunks",
    "migrate_files": "SELECT DISTINCT path, hash, last_modified, size, is_indexed, NULL::VARCHAR AS project_root, id FROM files",
    "newline_count": "SELECT DISTINCT id, (length(content) - length(replace(content, chr(10), '')))::INT AS n FROM chunks",
    "wordpiece_bounds": "SELECT DISTINCT id, true AS ok FROM chunks",
    "chunk_recursive_bounds": "SELECT doc_id, true AS ok FROM documents WHERE text <> ''",
    "line_span": "SELECT DISTINCT id FROM chunks WHERE end_line - start_line <> length(content) - length(replace(content, chr(10), ''))",
    "chunk_lines": "WITH l AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE text <> ''), w AS (SELECT doc_id, l, unnest(range(0, greatest(0, ceil((len(l) - 20) / 15.0))::BIGINT + 1)) AS k FROM l) SELECT doc_id, k::INT AS ordinal, (k * 15 + 1)::INT AS start_line, least(k * 15 + 20, len(l))::INT AS end_line, array_to_string(l[k * 15 + 1 : k * 15 + 20], chr(10)) || chr(10) AS content FROM w",
    "event_latest_state": f"WITH {_EV} SELECT * FROM e",
    "stream_ingest": "SELECT path, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, (event_type IN ('Deleted', 'Renamed')) DESC, event_type) AS rn FROM file_events WHERE path IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM (SELECT DISTINCT path, event_type, ts FROM file_events WHERE ts IS NOT NULL) GROUP BY 1, 2",
    "snapshot_diff": f"WITH {_until('a', _FIRST)}, {_until('b', _SECOND)}, x AS (SELECT * FROM a WHERE event_type NOT IN ('Deleted', 'Renamed')), y AS (SELECT * FROM b WHERE event_type NOT IN ('Deleted', 'Renamed')) SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'Created' WHEN y.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS event_type FROM x FULL JOIN y ON x.path = y.path WHERE x.path IS NULL OR y.path IS NULL OR epoch_ms(x.ts) <> epoch_ms(y.ts)",
}
