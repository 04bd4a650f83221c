"""Files of a tree as rows: scans, snapshots and event logs."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.session import materialize

#: Folders that the driver opens at most before the rest of the tree is listed by the executors, and bytes that one task reads.
FOLDERS, READ = 256, 64 << 20
IGNORE_FILE = ".tesseraignore"
_LISTED = "path string, size long, last_modified long"


def _open(root: str):
    """(file system, path, prefix) of a local path or a URI; the prefix makes paths of the file system those of the result."""
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), os.path.realpath(root), ""
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/"), "" if root.startswith("file:") else root[: root.index(path)] if path in root else root.split("://")[0] + "://"


def ignored_names(globs: list[str]) -> re.Pattern | None:
    return re.compile("^(?:" + "|".join(X.glob_regex(g) for g in globs) + ")$") if globs else None


def _entries(system, folder: str, skip: re.Pattern | None) -> tuple[list[tuple], list[str]]:
    """Regular files (path, size, last_modified) and folders in ``folder``, without ignored names, links to folders, and what can't be read."""
    from pyarrow import fs

    try:
        infos = system.get_file_info(fs.FileSelector(folder))
    except OSError:
        return [], []
    files, folders = [], []
    local = isinstance(system, fs.LocalFileSystem)
    for i in infos:
        if skip and skip.match(i.base_name):
            continue
        if i.type == fs.FileType.File:
            files.append((i.path, i.size, (i.mtime_ns or 0) // 1_000_000))
        elif i.type == fs.FileType.Directory and not (local and os.path.islink(i.path)):
            folders.append(i.path)
    return files, folders


def _walk(root: str, globs: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _, prefix = _open(root)
        skip = ignored_names(globs)
        for b in batches:
            todo, out = list(b["folder"]), []
            while todo:
                files, folders = _entries(system, todo.pop(), skip)
                todo += folders
                out += [(prefix + p, s, m) for p, s, m in files]
                if len(out) >= 100_000:
                    yield pd.DataFrame(out, columns=["path", "size", "last_modified"])
                    out = []
            yield pd.DataFrame(out, columns=["path", "size", "last_modified"])

    return run


def list_tree(spark: SparkSession, root: str, globs: list[str] | None = None) -> DataFrame:
    """(path, size, last_modified, project_root) of all regular files below ``root``, whatever their names, unless a component below
    it matches one of ``globs``; an ignored folder is not opened. A root that is no folder gives no rows.

    The driver opens folders breadth-first until there are ``FOLDERS`` of them; their subtrees are listed by the executors."""
    globs = X.IGNORED if globs is None else globs
    system, top, prefix = _open(root)
    skip = ignored_names(globs)
    files, todo, opened = [], [top] if system.get_file_info(top).is_file is False else [], 0
    while todo and opened < FOLDERS:
        f, folders = _entries(system, todo.pop(0), skip)
        files += [(prefix + p, s, m) for p, s, m in f]
        todo += folders
        opened += 1
    out = spark.createDataFrame(files, _LISTED)
    if todo:
        rest = spark.createDataFrame([(x,) for x in todo], "folder string").repartition(len(todo))
        out = out.unionByName(rest.mapInPandas(_walk(root, globs), _LISTED))
    return out.withColumn("project_root", F.lit(prefix + top))


def read_files(listed: DataFrame) -> DataFrame:
    """``listed`` with the bytes of each file (content); files that are gone or can't be read by now have no row. The paths are spread by
    the bytes to read, not by their number."""
    spark = listed.sparkSession
    listed = materialize(listed, "listed")
    total = listed.agg(F.sum("size")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / READ))
    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])
    at = listed.columns.index("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held = [], 0
            for row in b.itertuples(index=False, name=None):
                try:
                    system, path, _ = _open(row[at])
                    with system.open_input_stream(path) as f:
                        out.append((*row, f.read()))
                except OSError:
                    continue
                held += len(out[-1][-1])
                if held >= READ:
                    yield pd.DataFrame(out, columns=schema.names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=schema.names)

    return listed.repartition(parts, "path").mapInPandas(run, schema)


def scan_tree(spark: SparkSession, root: str, globs: list[str] | None = None, with_content: bool = True) -> DataFrame:
    """``list_tree``, with the files' bytes (content) unless ``with_content`` is off."""
    listed = list_tree(spark, root, globs)
    return read_files(listed) if with_content else listed


def stat_files(paths: DataFrame, roots: DataFrame, globs: list[str]) -> DataFrame:
    """(path, size, last_modified, project_root) of the regular files among ``paths`` (path) that lie below one of ``roots`` (ordinal, root) and
    match no glob below it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            out = []
            for p in b["path"]:
                system, path, _ = _open(p) if "://" in p else (fs.LocalFileSystem(), p, "")
                i = system.get_file_info(path)
                if i.type == fs.FileType.File:
                    out.append((p, i.size, (i.mtime_ns or 0) // 1_000_000))
            yield pd.DataFrame(out, columns=["path", "size", "last_modified"])

    there = assign_root(paths.select("path").distinct().mapInPandas(run, _LISTED), roots.select("ordinal", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")).alias("root")))
    there = there.filter("project_root is not null").withColumn("project_root", F.regexp_replace("project_root", "/$", ""))
    return there.filter(~X.ignored(F.col("path"), F.col("project_root"), globs)).select("path", "size", "last_modified", "project_root")


def ignore_globs(folder: str) -> list[str]:
    """The fixed globs and those of the ignore file in ``folder``, if there is one."""
    try:
        with open(os.path.join(folder, IGNORE_FILE), encoding="utf-8") as f:
            more = X.parse_ignore_file(f.read())
    except OSError:
        more = []
    return [*X.IGNORED, *(g for g in more if X.is_regex(g))]


def with_hash(df: DataFrame) -> DataFrame:
    """The SHA-256 digest in hexadecimal of ``content``."""
    return df.withColumn("hash", F.sha2("content", 256))


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.decode("content", "UTF-8"))


def assign_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``df`` with the project root of ``roots`` (ordinal, root): the first whose string begins the path; NULL if none does.

    Paths meet roots on their beginnings of the lengths that roots have, so the work grows with the number of different lengths and not with
    that of the roots; the lengths, at most as many as a path has characters, are collected."""
    r = roots.select("ordinal", "root").groupBy("root").agg(F.min("ordinal").alias("ordinal"))
    lengths = sorted(x[0] for x in r.select(F.length("root")).distinct().collect())
    if not lengths:
        return df.drop("project_root").withColumn("project_root", F.lit(None).cast("string"))
    p = df.select("path").filter("path is not null").distinct()
    begins = p.select("path", F.explode(F.array(*map(F.lit, lengths))).alias("n")).filter(F.col("n") <= F.length("path")).select("path", F.substring("path", F.lit(1), F.col("n")).alias("root"))
    hit = begins.join(r, "root").groupBy("path").agg(F.min_by("root", "ordinal").alias("project_root"))
    return df.drop("project_root").join(hit, "path", "left")


def snapshot_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event_type) between two snapshots (path, size, last_modified): Created, Modified, Deleted. Sees deletes and edits in
    place, which a file stream does not."""
    b = before.select("path", F.struct("size", "last_modified").alias("b"))
    a = after.select("path", F.struct("size", "last_modified").alias("a"))
    kind = F.when(F.col("b").isNull(), "Created").when(F.col("a").isNull(), "Deleted").when(F.col("a") != F.col("b"), "Modified")
    return b.join(a, "path", "full_outer").select("path", kind.alias("event_type")).filter("event_type is not null")
