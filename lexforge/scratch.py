"""Tables for a while in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = "lexforge"
_own_dir: str | None = None
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and all of it runs on one machine (tests), a
    temporary folder of this process is used; it goes when the process ends.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix=f"{_PACKAGE}-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is there goes when the driver ends, if not before."""
    if not _made:
        atexit.register(_clear)
    path = f"{scratch_dir(spark)}/{_PACKAGE}-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_made):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    Unlike ``localCheckpoint`` nothing is lost with an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, level: int = 3) -> DataFrame:
    """Like :func:`stored`, in buckets by ``key``: joins and groups by it don't move these rows again.

    ``level`` is zstd's: a higher one takes less disk and more time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).saveAsTable(table)
    out = spark.table(table)
    out._scratch, out._table = path, table
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` or :func:`bucketed` that no later plan reads."""
    for df in frames:
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        path = getattr(df, "_scratch", None)
        if path in _made:
            _delete(df.sparkSession, path)
