"""The engine's methods, a JSON-RPC adapter for tools and a command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as X
from tessera.functions.embedders import Embedder, ZeroEmbedder, embedder_of
from tessera.index import call_table, chunk_files, embed_chunks
from tessera.operators import store as S
from tessera.operators.fulltext import build_postings, corpus_stats
from tessera.operators.fusion import Filters, hybrid_search, keyword_search
from tessera.operators.vectors import searchable, stored_dimension
from tessera.session import materialize, stages
from tessera.sources.scan import ignore_globs, list_tree, read_files, stat_files, with_hash, with_text
from tessera.streaming.ingest import GONE, latest_events, run_stream, tick_stream

_LOG = logging.getLogger("tessera")


def find_references(chunks: DataFrame, links: DataFrame, symbol: str) -> DataFrame:
    """(id, content, start_line, end_line, symbol_name): one row a call of ``symbol``."""
    return links.filter(F.col("to_symbol_name") == symbol).select(F.col("from_chunk_id").alias("id")).join(chunks.select("id", "content", "start_line", "end_line", "symbol_name"), "id")


def get_definition(chunks: DataFrame, symbol: str, index=None) -> DataFrame:
    """The best chunk of type function that the keyword query ``symbol`` finds, else the best of type class."""
    both = None
    for k, kind in enumerate(("function", "class")):
        hit = keyword_search(chunks, symbol, 1, Filters(type_filter=kind), index).withColumn("_k", F.lit(k))
        both = hit if both is None else both.unionByName(hit)
    best = both.orderBy("_k").limit(1).drop("_k")
    return chunks.join(F.broadcast(best), "id").select("id", "content", "start_line", "end_line", "symbol_name", "symbol_type", "rank")


def list_symbols(chunks: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(name, type, line) of a file's symbols by line."""
    f = files.filter(F.col("path") == path).select(F.col("id").alias("file_id"))
    s = chunks.filter(F.col("symbol_name") != "").join(F.broadcast(f.limit(1)), "file_id")
    return s.select(F.col("symbol_name").alias("name"), F.col("symbol_type").alias("type"), F.col("start_line").alias("line"), "id").orderBy("line", "id").drop("id")


def status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, pending: int = 0, watch_paths: list[str] = ()) -> DataFrame:
    one = files.agg(F.count(F.lit(1)).alias("total_files")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("total_chunks"))).crossJoin(vectors.agg(F.count(F.lit(1)).alias("memory_items")))  # one row each
    return one.withColumn("queue_size", F.lit(pending).cast("long")).withColumn("watch_paths", F.array(*map(F.lit, watch_paths)).cast("array<string>"))


class Engine:
    """An index under a folder. Methods that answer with rows return DataFrames; ``call`` answers with JSON.

    The embedding back end is the one that the configuration asks for. ``live``: watched folders are followed by a stream."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, embedder: Embedder | None = None, live: bool = False):
        self.spark, self.folder, self.live = spark, folder, live
        self.config = config or Config.load(os.path.join(folder, "config.json"))
        self.embedder = embedder or embedder_of(self.config.embedding_backend, self.config.embedding_model, self.config.openai_key, folder)
        self.store = S.Store(spark, os.path.join(folder, "tables"))
        self.pending = 0
        self.stopped = False
        self._lock = threading.RLock()
        self._watch = None

    # --- indexing ---

    def scan(self, root: str, force: bool = False) -> int:
        """Index what is new or changed below ``root`` and forget what is gone; returns the number of files indexed. Only the files that differ
        from the stored size or time are read, and only what differs is written."""
        with self._lock, stages(self.spark):
            seen = materialize(list_tree(self.spark, root, ignore_globs(self.folder)).filter(X.is_indexed_type(F.col("path"))), "seen")
            files = self.store.table("files")
            todo = seen if force else S.changed_by_metadata(seen, files)
            gone = files.filter(F.col("project_root") == os.path.realpath(root)).join(seen.select("path"), "path", "left_anti").select("path")
            return self._apply(todo, gone)

    def _apply(self, todo: DataFrame, gone: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Index the files ``todo`` (path, size, last_modified, project_root) and forget the paths ``gone``, in one commit."""
        self.check_dimension()
        tables = self.store.tables()
        todo = materialize(with_text(with_hash(read_files(todo.select("path", "size", "last_modified", "project_root")))), "todo")
        self.pending = n = todo.count()
        gone = materialize(gone.join(tables["files"].select("path"), "path", "left_semi"), "gone")
        if not n and gone.isEmpty():
            return 0
        stored = tables["files"].join(todo.select("path"), "path", "left_semi")
        files = materialize(S.upsert_files(stored, todo, S.top_id(tables["files"])).withColumn("is_indexed", F.lit(1)), "files")
        touched = gone.unionByName(todo.select("path"))
        old_files = tables["files"].join(touched, "path", "left_semi").select(F.col("id").alias("file_id"))
        old = materialize(tables["chunks"].join(old_files, "file_id", "left_semi").select("id", "file_id"), "old")
        new = chunk_files(todo).join(files.select("path", F.col("id").alias("file_id")), "path")
        # numbered first: a range partitioning runs what is below it twice, which would ask the back end twice
        chunks = materialize(embed_chunks(S.numbered_after(new, ["path", "ordinal"], S.top_id(tables["chunks"])), self.embedder), "chunks")
        texts = todo.join(files.select("path", F.col("id").alias("file_id")), "path").withColumn("language", X.language(F.col("path")))
        fresh = S.first_chunk_links(chunks, call_table(texts, "file_id", "long"))
        links = S.numbered_after(fresh, ["from_chunk_id", "to_symbol_name"], S.top_id(tables["symbol_links"]))
        postings, lengths = build_postings(chunks)
        self.store.change(
            {"files": files, "chunks": chunks, "symbol_links": links, "postings": postings.repartitionByRange("term").sortWithinPartitions("term"), "lengths": lengths},
            {"files": touched, "chunks": old, "symbol_links": old.select(F.col("id").alias("from_chunk_id")), "postings": old.select("id"), "lengths": old.select("id")},
            batch,
        )
        self.pending = 0
        return n

    def check_dimension(self) -> bool:
        """Wipe the chunks of a store whose vectors have another size than the back end's (all files are due again); a back end that can't
        tell its size changes nothing."""
        size = self.embedder.dimension()
        stored = stored_dimension(self.store.table("chunks"), "embedding").first()[0] if size else 0
        if not stored or stored == size:
            return False
        _LOG.warning("stored vectors have %d elements, the back end's %d: all files will be indexed again", stored, size)
        self._wipe()
        return True

    def _wipe(self) -> None:
        tables = S.wipe_chunks(self.store.tables())
        empty = {n: self.store.table(n).limit(0) for n in ("postings", "lengths") if n in self.store.versions()}
        self.store.commit({**tables, **empty})

    def embed_missing(self) -> int:
        """Vectors for the chunks that have none because the back end did not answer; returns their number."""
        with self._lock, stages(self.spark):
            chunks = self.store.table("chunks")
            done = materialize(embed_chunks(chunks.filter("embedding is null and content is not null"), self.embedder).filter("embedding is not null"), "embedded")
            n = done.count()
            if n:
                fill = done.select("id", F.col("embedding").alias("_e"))
                self.store.commit({"chunks": chunks.join(fill, "id", "left").withColumn("embedding", F.coalesce("embedding", "_e")).drop("_e")})
            return n

    def watch_add(self, path: str) -> str:
        real = os.path.realpath(path)
        if not os.path.isdir(real):
            raise ValueError(f"no such folder: {path}")
        if real in self.config.watch_paths:
            return "already watched"
        self.config.watch_paths.append(real)
        os.makedirs(self.folder, exist_ok=True)
        self.config.save(os.path.join(self.folder, "config.json"))
        self.scan(real)
        if self.live:
            self.watch()
        return f"added: {real}"

    def watch(self, interval: str = "1 second"):
        """The stream that follows all watched folders: at each tick it compares their trees with the store and indexes the difference, so edits,
        deletes, renames and what happened while nothing ran are all seen, and a tick that is repeated after a loss changes nothing."""
        if self._watch is None or not self._watch.isActive:
            self._watch = run_stream(tick_stream(self.spark), None, lambda batch, number: [self.scan(p) for p in list(self.config.watch_paths) if os.path.isdir(p)], interval=interval)
        return self._watch

    def follow(self, events: DataFrame, checkpoint: str, name: str = "events"):
        """Apply a stream of file events (path, event_type, ts, received_at), what is there now: the last event of a path in a batch decides; a
        path that was deleted or renamed is forgotten, another is read again. Each batch's number is committed with its tables."""
        return run_stream(events, checkpoint, lambda batch, number: self.apply_events(batch, (name, number)))

    def apply_events(self, events: DataFrame, batch: tuple[str, int] | None = None) -> int:
        if batch and self.store.applied(batch[0]) >= batch[1]:
            return 0
        with self._lock, stages(self.spark):
            last = materialize(latest_events(events), "events")
            roots = self.spark.createDataFrame([(k, p) for k, p in enumerate(self.config.watch_paths)], "ordinal int, root string")
            there = materialize(stat_files(last.filter(~F.col("event_type").isin(*GONE)).select("path"), roots, ignore_globs(self.folder)).filter(X.is_indexed_type(F.col("path"))), "there")
            gone = last.filter(F.col("event_type").isin(*GONE)).select("path")
            return self._apply(S.changed_by_metadata(there, self.store.table("files")), gone, batch)

    def reindex(self) -> int:
        with self._lock:
            self._wipe()
            return sum(self.scan(p) for p in self.config.watch_paths)

    # --- answers ---

    def _index(self):
        v = self.store.versions()
        return (self.store.table("postings"), corpus_stats(self.store.table("lengths"))) if "postings" in v else None

    def vectors(self) -> DataFrame:
        return searchable(self.store.table("chunks"), self.store.table("files"), self.config.memory_mode, self.config.hybrid_limit)

    def status(self) -> DataFrame:
        return status(self.store.table("files"), self.store.table("chunks"), self.vectors(), self.pending, self.config.watch_paths)

    def query(self, q: str, limit: int = 5, type_filter: str = "", language: str = "", scope: str = "") -> DataFrame:
        v = None if self.config.memory_mode == "DISK" or isinstance(self.embedder, ZeroEmbedder) else self.embedder.embed(q)
        return hybrid_search(self.store.table("chunks"), q, v, limit, Filters(type_filter, language, scope), vectors=self.vectors() if v else None, index=self._index())

    def resource_list(self) -> DataFrame:
        return self.store.table("files").select("path")

    def resource_read(self, uri: str) -> str | None:
        """The content of an indexed file, None for other files."""
        path = X.path_of_uri(uri)
        if self.store.table("files").filter(F.col("path") == path).isEmpty():
            return None
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()

    def summarize_project(self, root: str) -> DataFrame:
        return list_tree(self.spark, root, ignore_globs(self.folder)).select("path", "size")

    def call(self, request: str) -> str:
        """{"method", "params"} to {"result"} or {"error"}."""
        try:
            r = json.loads(request)
            m, p = r["method"], r.get("params", [])
        except (ValueError, KeyError, TypeError):
            return json.dumps({"error": "error"})
        rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
        c, f, k = (lambda: self.store.table("chunks")), (lambda: self.store.table("files")), (lambda: self.store.table("symbol_links"))
        methods = {
            "ping": lambda: "pong", "status": lambda: rows(self.status())[0], "watch_add": lambda: self.watch_add(p[0]), "shutdown": self.shutdown, "reindex": self.reindex,
            "resource_list": lambda: [x["path"] for x in rows(self.resource_list())], "resource_read": lambda: {"content": self.resource_read(p[0])},
            "find_references": lambda: rows(find_references(c(), k(), p[0])), "get_definition": lambda: next(iter(rows(get_definition(c(), p[0], self._index()))), None),
            "list_symbols": lambda: rows(list_symbols(c(), f(), p[0])), "summarize_project": lambda: rows(self.summarize_project(p[0])), "query": lambda: rows(self.query(*p)),
        }
        if m not in methods:
            return json.dumps({"error": "unknown"})
        try:
            return json.dumps({"result": methods[m]()})
        except Exception:
            _LOG.exception("%s failed", m)  # the caller's protocol has one word for it
            return json.dumps({"error": "error"})

    def shutdown(self) -> str:
        self.stopped = True
        if self._watch is not None:
            self._watch.stop()
            self._watch = None
        return "shutting down"


# The tools' names and their parameters, the protocol's version.
TOOLS = {
    "query": ["query", "limit", "type", "language", "scope"], "status": [], "summarize": ["path"], "find_references": ["symbol"], "get_definition": ["symbol"], "list_symbols": ["path"], "watch_add": ["path"],
}
PROTOCOL = "2024-11-05"


class ToolServer:
    """JSON-RPC over lines of text: initialize, resources/list, resources/read, tools/list, tools/call."""

    def __init__(self, engine: Engine | None):
        self.engine = engine

    def handle(self, line: str) -> str | None:
        """The answer to one request; None where none is due (notifications, unknown methods)."""
        try:
            r = json.loads(line)
        except ValueError:
            return None
        method, params, i = r.get("method"), r.get("params", {}), r.get("id")
        ok = lambda x: json.dumps({"jsonrpc": "2.0", "id": i, "result": x})
        fail = lambda code, text: json.dumps({"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": text}})
        if method == "initialize":
            return ok({"protocolVersion": PROTOCOL, "capabilities": {"resources": {}, "tools": {}}, "serverInfo": {"name": "tessera", "version": "0.1.0"}})
        if method == "tools/list":
            return ok({"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {a: {"type": "integer" if a == "limit" else "string"} for a in args}, "required": args[:1]}} for n, args in TOOLS.items()]})
        if method not in ("resources/list", "resources/read", "tools/call"):
            return None
        if self.engine is None:
            return fail(-32001, "the engine is not running")
        if method == "resources/list":
            return ok({"resources": [{"uri": "tessera://" + x["path"], "name": os.path.basename(x["path"])} for x in self.engine.resource_list().toLocalIterator()]})
        if method == "resources/read":
            text = self.engine.resource_read(params.get("uri", ""))
            return fail(-32002, "no such resource") if text is None else ok({"contents": [{"uri": params["uri"], "mimeType": "text/plain", "text": text}]})
        name, args = params.get("name"), params.get("arguments", {})
        if name not in TOOLS:
            return fail(-32601, "no such tool")
        given = [args.get(a, 5 if a == "limit" else "") for a in TOOLS[name]]
        answer = json.loads(self.engine.call(json.dumps({"method": "summarize_project" if name == "summarize" else name, "params": given})))
        if "error" in answer:
            return fail(-32000, answer["error"])
        return ok({"content": [{"type": "text", "text": answer["result"] if isinstance(answer["result"], str) else json.dumps(answer["result"], indent=1)}]})

    def serve(self, source=sys.stdin, sink=sys.stdout) -> None:
        for line in source:
            out = self.handle(line)
            if out is not None:
                print(out, file=sink, flush=True)


def main(argv: list[str] | None = None) -> int:
    """ping, status, watch PATH, query TEXT [LIMIT], reindex, serve; any other word is a method's name."""
    a = argparse.ArgumentParser(prog="tessera", description=main.__doc__)
    a.add_argument("--index", default=os.path.expanduser("~/.tessera"))
    a.add_argument("method")
    a.add_argument("args", nargs="*")
    o = a.parse_args(argv)
    from tessera.session import get_session

    engine = Engine(get_session(master="local[*]"), o.index, live=o.method == "serve")
    if o.method == "serve":
        if engine.config.watch_paths:
            engine.watch()
        ToolServer(engine).serve()
        engine.shutdown()
        return 0
    params = [o.args[0], int(o.args[1])] if o.method == "query" and len(o.args) > 1 else o.args
    print(engine.call(json.dumps({"method": {"watch": "watch_add"}.get(o.method, o.method), "params": params})))
    return 0


if __name__ == "__main__":
    sys.exit(main())
