"""Session construction, lineage cutting and the files that it leaves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_shipped: str | None = None
_written: list[str] = []
#: Operators that keep the partitions of their scan: a plan of these only can be asked for its partitions without running anything.
_NARROW = {"FileSourceScanExec", "BatchScanExec", "LocalTableScanExec", "RDDScanExec", "RangeExec", "ProjectExec", "FilterExec", "GenerateExec", "ColumnarToRowExec", "InputAdapter", "WholeStageCodegenExec", "UnionExec"}


def get_session(app: str = "tessera", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` wins over them. ``shared``: the folder that all executors
    share (``spark.checkpoint.dir``), which a cluster needs."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shared:
        defaults["spark.checkpoint.dir"] = shared
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, unless it is installed: they don't know the driver's working folder."""
    global _shipped
    folder = os.path.dirname(os.path.abspath(__file__))
    app = spark.sparkContext.applicationId
    if _shipped == app or "site-packages" in folder or "dist-packages" in folder:
        return
    temp = tempfile.mkdtemp(prefix="tessera-package-")
    atexit.register(shutil.rmtree, temp, True)
    path = os.path.join(temp, "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(folder):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(folder)))
    spark.sparkContext.addPyFile(path)
    _shipped = app


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset and the master is local (tests on one
    machine), a temporary folder removed at exit; on any other master an error, because executors would write to their own disks."""
    global _local_dir
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master or ""
    if not (master == "local" or (master.startswith("local[") and master.endswith("]"))):
        raise RuntimeError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return "file://" + os.path.abspath(_local_dir)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives the
    loss of executors and that later jobs read instead of computing it again. It stays until ``release`` or the end of
    the ``stages`` block that it was written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _partitions(df: DataFrame) -> int | None:
    """Partitions of the scan under ``df``; None if anything but narrow operators stands above it."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() not in _NARROW:
            return None
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs more than moving the rows: a small table in one
    file would be worked on in one task. Scans of more partitions, as large ones have, and results of shuffles stay as they are.

    The setting ``spark.tessera.spread`` (default: the default parallelism) states the partitions; 0 turns it off."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.tessera.spread", str(spark.sparkContext.defaultParallelism)))
    n = _partitions(df) if least else None
    return df if n is None or n >= least else df.repartition(2 * least, *keys)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Hadoop knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the tables that ``materialize`` wrote, but for the first ``keep``; results that read them must have been written before."""
    while len(_written) > keep:
        remove(spark, _written.pop())


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """A block whose materialized tables are removed at its end; what it results in must be written or collected inside."""
    keep = len(_written)
    try:
        yield
    finally:
        release(spark, keep)


def pinned(df: DataFrame) -> DataFrame:
    """``df``, a ranked list cut to a limit that the caller states, computed once and kept by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
