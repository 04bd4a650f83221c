"""Exact and approximate nearest vectors of a query, and what may be searched."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import HYBRID_VECTORS, RAM_VECTORS


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector divided by its length (plus 1e-9, so that zeros stay zeros)."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-9)
    return F.transform(d, lambda x: x / n)


def mean_pooled(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, pooled): the mean of a key's vectors, element by element."""
    e = df.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("pooled"))


def of_dimension(df: DataFrame, vec: str, dim: int) -> DataFrame:
    return df.filter(F.size(vec) == dim)


def stored_dimension(df: DataFrame, vec: str) -> DataFrame:
    """One row (dimension) of a stored vector, 0 if there is none."""
    return df.filter(F.size(vec) > 0).select(F.size(vec).alias("d")).limit(1).agg(F.coalesce(F.max("d"), F.lit(0)).alias("dimension"))


def nearest(df: DataFrame, query: list[float], k: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(id, distance) of the ``k`` nearest vectors, nearest first, ties by id. Vectors of another dimension, NULL or with
    elements that are not finite are no candidates. Plans as a scan with a bounded top-k per task."""
    if not query or k <= 0:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("distance")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    c = df.filter(F.size(vec) == len(query)).select(F.col(id_col).alias("id"), squared_l2(F.col(vec), q).alias("distance"))
    return c.filter(F.col("distance") < float("inf")).orderBy("distance", "id").limit(k)


def searchable(chunks: DataFrame, files: DataFrame, mode: str = "RAM", hybrid_limit: int = HYBRID_VECTORS) -> DataFrame:
    """The vectors a mode searches: RAM the newest 100,000, HYBRID the newest ``hybrid_limit``, DISK none. Newest by the file's
    last_modified, ties by chunk id; chunks of unknown files and without a vector are left out."""
    has = chunks.filter(F.size("embedding") > 0)
    if mode == "DISK":
        return has.withColumn("last_modified", F.lit(None).cast("long")).limit(0)
    # ids and times are ranked, vectors stay where they are; the ids kept are at most 100,000
    keys = has.select("id", "file_id").join(files.select(F.col("id").alias("file_id"), "last_modified"), "file_id").select("id", "last_modified")
    newest = keys.orderBy(F.desc("last_modified"), "id").limit(hybrid_limit if mode == "HYBRID" else RAM_VECTORS)
    return has.join(F.broadcast(newest), "id")


def approximate(df: DataFrame, query: list[float], k: int, id_col: str = "id", vec: str = "embedding", buckets: float = 2.0, tables: int = 8, seed: int = 100) -> DataFrame:
    """(id, distance): ``nearest`` by random projections, which may miss some; finite vectors of the query's dimension only."""
    from pyspark.ml.linalg import Vectors

    zero = F.array_repeat(F.lit(0.0), len(query))  # the conversion can be run before the filter
    good = df.filter((F.size(vec) == len(query)) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))).select(F.col(id_col).alias("id"), array_to_vector(F.coalesce(F.col(vec).cast("array<double>"), zero)).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=buckets, numHashTables=tables, seed=seed).fit(good)
    near = model.approxNearestNeighbors(good, Vectors.dense(query), k, distCol="d")
    return near.select("id", F.pow("d", F.lit(2)).alias("distance"))


def from_bytes(blob: Column) -> Column:
    """array<float> of a blob of little-endian 4-byte floats."""
    def run(s):
        import numpy as np

        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    import pandas as pd
    from pyspark.sql import types as T

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(blob)


# --- a vector index as a table (id, embedding) ---


def add_vectors(index: DataFrame, new: DataFrame, dim: int, most: int = RAM_VECTORS) -> DataFrame:
    """``index`` with the vectors of ``new`` of the right dimension; a known id gets its new vector. Beyond ``most`` vectors, those of the
    largest ids among the new ones find no place."""
    fit = of_dimension(new, "embedding", dim).select("id", "embedding").dropDuplicates(["id"])
    kept = index.select("id", "embedding").join(fit.select("id"), "id", "left_anti").withColumn("_new", F.lit(0))
    return kept.unionByName(fit.withColumn("_new", F.lit(1))).orderBy("_new", "id").limit(most).drop("_new")


def remove_vectors(index: DataFrame, ids: DataFrame) -> DataFrame:
    """``index`` without the ids of ``ids`` (id)."""
    return index.join(ids.select("id"), "id", "left_anti")


def save_vectors(index: DataFrame, path: str) -> None:
    index.select("id", "embedding").write.mode("overwrite").parquet(path)


def load_vectors(spark, path: str) -> DataFrame:
    return spark.read.schema("id long, embedding array<float>").parquet(path)
