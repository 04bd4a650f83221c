"""The index as tables: changes as functions from tables to tables, and a versioned store on disk."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schema import CHUNKS, FILES, LINKS, migrate
from tessera.session import materialize, remove


def changed_by_metadata(observed: DataFrame, files: DataFrame) -> DataFrame:
    """``observed`` (path, size, last_modified, ...) rows without a stored file, with another size or time, or not indexed yet."""
    old = files.select("path", F.col("size").alias("_s"), F.col("last_modified").alias("_m"), F.col("is_indexed").alias("_i"))
    j = observed.join(old, "path", "left")
    same = (F.col("size").eqNullSafe(F.col("_s"))) & (F.col("last_modified").eqNullSafe(F.col("_m"))) & (F.coalesce(F.col("_i"), F.lit(0)) == 1)
    return j.filter(~same).drop("_s", "_m", "_i")


def changed_by_hash(observed: DataFrame, files: DataFrame) -> DataFrame:
    """``observed`` (path, hash, ...) rows whose hash is not the stored one."""
    return observed.join(files.select("path", F.col("hash").alias("_h")), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")


def upsert_files(files: DataFrame, new: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """``files`` with the rows of ``new`` (path, hash, last_modified, size, project_root) put in: a known path keeps its id and gets
    is_indexed 0, a new one gets the next free id by path. Of several new rows of a path the one modified last counts.
    ``top``: one row (_top) of the largest id, where ``files`` are only some of the stored ones."""
    w = Window.partitionBy("path").orderBy(F.desc("last_modified"), F.desc_nulls_last("hash"), F.desc_nulls_last("size"))
    n = new.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("path", *[F.col(c).alias("n_" + c) for c in ("hash", "last_modified", "size", "project_root")], F.lit(True).alias("_new"))
    j = files.join(n, "path", "full_outer")
    pick = [F.when(F.col("_new"), F.col("n_" + c)).otherwise(F.col(c)).alias(c) for c in ("hash", "last_modified", "size")]
    j = j.select("path", *pick, F.when(F.col("_new"), F.lit(0)).otherwise(F.col("is_indexed")).cast("int").alias("is_indexed"), F.when(F.col("_new"), F.col("n_project_root")).otherwise(F.col("project_root")).alias("project_root"), "id")
    known, fresh = j.filter("id is not null"), j.filter("id is null").drop("id")
    top = top_id(files) if top is None else top
    numbered = number_rows(fresh, ["path"], "_k").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_k")).drop("_k", "_top")
    return known.select(FILES.names).unionByName(numbered.select(FILES.names))


def number_rows(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Numbers from 1 in a total order without one task for all: a range partitioning, the partitions' sizes, then a number within each."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    s = materialize(s, "numbered")  # the partitions of a plan that runs twice need not be the same
    n = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return s.join(F.broadcast(before), "_p").withColumn(into, F.col("_before") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_n", "_first", "_before")


def top_id(df: DataFrame) -> DataFrame:
    """One row (_top): the largest id, 0 if there is none."""
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))


def numbered_after(df: DataFrame, order: list[str], top: DataFrame) -> DataFrame:
    """``df`` with ids that go on after ``top`` in the order of some columns."""
    return number_rows(df, order, "_k").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_k")).drop("_k", "_top")  # one row


def insert_chunks(chunks: DataFrame, files: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """``chunks`` with ``new`` (path, ordinal, content, ... ) put in; ids go on after the largest, by path and ordinal. Chunks of a path that
    is no file are dropped; the files' former chunks are replaced unless ``replace`` is off."""
    n = new.join(files.select("path", F.col("id").alias("file_id")), "path")
    kept = chunks.join(n.select("file_id").distinct(), "file_id", "left_anti") if replace else chunks
    return migrate(kept, CHUNKS).unionByName(migrate(numbered_after(n, ["path", "ordinal"], top_id(chunks)), CHUNKS))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files of ``paths`` (path), their chunks and the links from these."""
    gone = tables["files"].join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    chunks = tables["chunks"].join(gone, "file_id", "left_semi").select(F.col("id").alias("from_chunk_id"))
    out = dict(tables)
    out["files"] = tables["files"].join(paths.select("path").distinct(), "path", "left_anti").select(tables["files"].columns)
    out["chunks"] = tables["chunks"].join(gone, "file_id", "left_anti").select(tables["chunks"].columns)
    out["symbol_links"] = tables["symbol_links"].join(chunks, "from_chunk_id", "left_anti").select(tables["symbol_links"].columns)
    return out


def set_indexed(files: DataFrame, path: str, flag: bool = True) -> DataFrame:
    return files.withColumn("is_indexed", F.when(F.col("path") == path, F.lit(int(flag))).otherwise(F.col("is_indexed")).cast("int"))


def wipe_chunks(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """No chunks, no links, and all files to be indexed again."""
    return {**tables, "chunks": tables["chunks"].limit(0), "symbol_links": tables["symbol_links"].limit(0), "files": tables["files"].withColumn("is_indexed", F.lit(0))}


def first_chunk_links(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """(from_chunk_id, to_symbol_name, link_type): every call of a file (file_id, name) at the file's first chunk."""
    first = chunks.groupBy("file_id").agg(F.min("id").alias("from_chunk_id"))
    return calls.join(first, "file_id").select("from_chunk_id", F.col("name").alias("to_symbol_name"), F.lit("call").alias("link_type"))


def innermost_links(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """As ``first_chunk_links``, at the smallest chunk whose lines hold the call's line (file_id, line, name)."""
    j = calls.withColumn("_c", F.monotonically_increasing_id()).join(chunks.select("file_id", "id", "start_line", "end_line"), "file_id").filter("line between start_line and end_line")
    w = Window.partitionBy("_c").orderBy(F.col("end_line") - F.col("start_line"), "id")
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("id").alias("from_chunk_id"), F.col("name").alias("to_symbol_name"), F.lit("call").alias("link_type"))


class Store:
    """Tables under one folder of any file system that Hadoop knows, as segments and sets of keys that are gone.

    A commit writes new segments and then one entry of the log, numbered, which is created only if no other commit made that number; so
    readers see whole versions, and a commit that fails changes nothing. A change costs what is new: rows of older segments are dead
    where their key is among those that went later. After ``SEGMENTS`` a table is written anew. The last ``keep`` versions stay, for readers
    that planned on them."""

    TABLES = {"files": FILES, "chunks": CHUNKS, "symbol_links": LINKS}
    KEYS = {"files": "path", "chunks": "file_id", "symbol_links": "from_chunk_id", "postings": "id", "lengths": "id"}
    SEGMENTS = 12

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.keep = spark, keep
        self.folder = folder.rstrip("/") if "://" in folder else "file://" + os.path.abspath(folder)

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._path("log")
        if not fs.exists(p):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def entry(self, number: int | None = None) -> dict:
        """The log's entry of a version, the last one by default: {number, tables: {name: {segments, gone}}, batches}."""
        numbers = self._numbers()
        if number is None and not numbers:
            return {"number": 0, "tables": {}, "batches": {}}
        p, fs = self._path(f"log/{numbers[-1] if number is None else number:012d}.json")
        source = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def versions(self) -> dict[str, dict]:
        return self.entry()["tables"]

    def applied(self, name: str) -> int:
        """The last batch of a stream that is in the tables, -1 if none is."""
        return self.entry()["batches"].get(name, -1)

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.versions().get(name))

    def tables(self) -> dict[str, DataFrame]:
        v = self.versions()
        return {n: self._read(n, v.get(n)) for n in self.TABLES}

    def _read(self, name: str, v: dict | None) -> DataFrame:
        if not v or not v["segments"]:
            return self.spark.createDataFrame([], self.TABLES.get(name))
        out, gone = None, None
        for path, at in v["segments"]:
            df = self.spark.read.parquet(f"{self.folder}/{path}")
            df = (migrate(df, self.TABLES[name]) if name in self.TABLES else df).withColumn("_at", F.lit(at))
            out = df if out is None else out.unionByName(df)
        key = self.KEYS.get(name)
        first = min(at for _, at in v["segments"])
        for path, at in v["gone"]:
            if at > first:
                df = self.spark.read.parquet(f"{self.folder}/{path}").select(F.col(key).alias("_key"), F.lit(at).alias("_gone"))
                gone = df if gone is None else gone.unionByName(df)
        if gone is not None:
            gone = gone.groupBy("_key").agg(F.max("_gone").alias("_gone"))
            out = out.join(gone, (F.col(key) == F.col("_key")) & (F.col("_gone") > F.col("_at")), "left_anti")
        return out.drop("_at")

    def change(self, new: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Adds rows and takes away those of the keys in ``gone`` (a column of the key's name) that were there before. ``batch``: name and
        number of the stream's batch that this applies; one that is in the tables already changes nothing."""
        now = self.entry()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return
        at = now["number"] + 1
        tables = {n: {"segments": list(v["segments"]), "gone": list(v["gone"])} for n, v in now["tables"].items()}
        for n, df in (gone or {}).items():
            if n in tables:
                tables[n]["gone"].append([self._write(f"{n}-gone", df.select(self.KEYS[n]).filter(F.col(self.KEYS[n]).isNotNull()).distinct()), at])
        for n, df in new.items():
            tables.setdefault(n, {"segments": [], "gone": []})["segments"].append([self._write(n, migrate(df, self.TABLES[n]) if n in self.TABLES else df), at])
        for n, v in tables.items():
            if len(v["segments"]) + len(v["gone"]) > self.SEGMENTS:
                df = self._read(n, v)
                if n == "postings":
                    df = df.repartitionByRange("term").sortWithinPartitions("term")
                tables[n] = {"segments": [[self._write(n, df), at]], "gone": []}
        self._log(now, tables, batch)

    def commit(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Replaces whole tables."""
        now = self.entry()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return
        written = {n: {"segments": [[self._write(n, migrate(df, self.TABLES[n]) if n in self.TABLES else df), now["number"] + 1]], "gone": []} for n, df in tables.items()}
        self._log(now, {**now["tables"], **written}, batch)

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def _log(self, before: dict, tables: dict, batch: tuple[str, int] | None) -> None:
        batches = {**before["batches"], **({batch[0]: batch[1]} if batch else {})}
        entry = {"number": before["number"] + 1, "tables": tables, "batches": batches}
        p, fs = self._path(f"log/{entry['number']:012d}.json")
        sink = fs.create(p, False)  # fails if another commit was first
        sink.write(bytearray(json.dumps(entry).encode()))
        sink.close()
        numbers = self._numbers()
        paths = lambda e: {x[0] for v in e["tables"].values() for x in v["segments"] + v["gone"]}
        live = set().union(*(paths(self.entry(k)) for k in numbers[-self.keep :]))
        for k in numbers[: -self.keep]:
            for x in paths(self.entry(k)) - live:
                remove(self.spark, f"{self.folder}/{x}")
            remove(self.spark, f"{self.folder}/log/{k:012d}.json")
