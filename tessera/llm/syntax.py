"""Source files that do not parse (problem 2).

A file is judged by the language its extension stands for. The recogniser of ``gll`` runs the grammars of a language's
dialects (Python 3 and 2, JavaScript and TypeScript, Java with and without compact files) in one pass over a graph-structured
stack; a file that no supported dialect accepts is flagged. Files of other extensions are never flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import file_texts


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from tessera.llm.grammars import parses

    for b in batches:
        yield pd.DataFrame({"file_id": b["file_id"], "project_root": b["project_root"], "language": b["language"], "valid": [parses(t, k) for t, k in zip(b["text"], b["language"])]})


def judged_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, project_root, language, valid) of the files in a supported language. An empty file is valid unless its
    language asks for content (JSON)."""
    from tessera.llm.grammars import EXTENSIONS

    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    language = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    known = files.filter(ext.isin(*EXTENSIONS))
    return file_texts(known, chunks).withColumn("language", language).select("file_id", "project_root", "language", "text").mapInPandas(_judge, "file_id long, project_root string, language string, valid boolean")


def parse_rates(judged: DataFrame) -> DataFrame:
    """(project_root, language, n_files, n_invalid, rate); a NULL root is a group of its own."""
    return judged.groupBy("project_root", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid")).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
