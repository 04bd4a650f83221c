"""Record schemas and constants of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_f = T.StructField
FILES = T.StructType([_f("path", _S), _f("hash", _S), _f("last_modified", _L), _f("size", _L), _f("is_indexed", _I), _f("project_root", _S), _f("id", _L)])
CHUNKS = T.StructType(
    [_f("id", _L), _f("file_id", _L), _f("content", _S), _f("start_line", _I), _f("end_line", _I), _f("symbol_name", _S), _f("symbol_type", _S), _f("project_root", _S), _f("language", _S), _f("embedding", T.ArrayType(T.FloatType()))]
)
LINKS = T.StructType([_f("id", _L), _f("from_chunk_id", _L), _f("to_symbol_name", _S), _f("link_type", _S)])

# Fixed values of retrieval and chunking.
RRF_K = 60
OVERFETCH = 2
LIMIT = 5
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
CHUNK_SIZE, CHUNK_OVERLAP = 4000, 0.15
DIMENSION = 384
RAM_VECTORS, HYBRID_VECTORS = 100_000, 1000


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order; columns that an old schema lacks are NULL, others are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
