"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def full_address(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme: one without means the default file system, not each machine's own disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full address. It has to be set on a cluster; a local session without it gets a
    temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if sc.applicationId not in _fallback:
            _fallback[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='skydrift-')}"
        root = _fallback[sc.applicationId]
    return full_address(spark, root)


def new_folder(spark: SparkSession, name: str) -> str:
    """An address below the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder's owner cleans it
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read back; the files go when the program ends."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    atexit.register(_delete, spark, at)
    return spark.read.schema(df.schema).parquet(at)
