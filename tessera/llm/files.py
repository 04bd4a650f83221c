"""Whole texts of files, put together from their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_texts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, path, project_root, text) of the files that have chunks.

    The chunks of a file are joined with one line feed in the order of their first lines; a chunk or file delivered twice
    counts once; NULL contents count as empty; chunks of unknown files and files without chunks have no row. Contents
    cross the network once, and a file's chunks meet in one place, because its text is needed whole."""
    parts = chunks.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), "id", F.coalesce("content", F.lit("")).alias("c"))).alias("p"))
    texts = parts.select("file_id", F.array_join(F.transform(F.array_sort(F.array_distinct("p")), lambda x: x["c"]), "\n").alias("text"))
    f = files.filter(F.col("id").isNotNull() & F.col("path").isNotNull()).groupBy(F.col("id").alias("file_id")).agg(F.min("path").alias("path"), F.min("project_root").alias("project_root"))
    return texts.join(f, "file_id").select("file_id", "path", "project_root", "text")
