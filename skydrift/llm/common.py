"""What the text operators share: shared-folder tables, size-checked broadcasts, components."""

from __future__ import annotations

import atexit
import gc
import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Rows of an Arrow batch that goes to a Python worker: texts are long, and workers' memory is bounded.
BATCH_ROWS = "2000"
#: A side is broadcast only when a count shows that it stays below this many bytes.
BROADCAST_BYTES = 48 << 20
#: A row group of these tables: a task that writes or reads one holds about so much of it.
GROUP_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as a full address, so that Python workers and Spark
    mean the same place. It has to be set on a cluster."""
    return shared_folder(spark)


class Workspace:
    """A folder of its own below the shared one, for the tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        atexit.register(self.drop)

    def at(self, tag: str) -> str:
        return f"{self.path}/{tag}"

    def table(self, df: DataFrame, tag: str, few: bool = False) -> DataFrame:
        """Writes df below the shared folder and reads it back, which cuts its lineage. few: in a quarter as many files as
        a shuffle has partitions (but one for each task that can run at a time), for tables that aren't costly to make."""
        if few:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4))
        df.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(self.at(tag))
        return self.spark.read.schema(df.schema).parquet(self.at(tag))

    def free(self) -> None:
        """Shuffle files of finished steps go when the driver collects what refers to them; a long job asks for that between steps."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, tag: str = "") -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tag}".rstrip("/"))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; the folder's owner cleans it
            pass


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a count shows that it fits; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def crc32_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; the split rule of the learning operators."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def about(share: float, *columns: str, seed: int = 0) -> Column:
    """True for about this share of the values of some columns, always the same ones. Unlike the first rows of an
    order, such a sample takes nothing from each task to one place but what is in it."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def components(work: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges(a, b): rows (id, comp), comp the least id of the component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins and aggregates;
    each round is written to the shared folder, and nothing is collected but a checksum.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = work.table(e, f"{tag}-0", True)
    last = None
    for i in itertools.count(1):  # as many as it takes: their number grows with the logarithm of the nodes
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # every larger neighbour hangs on the least of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # every smaller neighbour, and the node itself, hangs on the least one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small_star = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x")).select("x.*").where("a < b").distinct()
        e = work.table(small_star, f"{tag}-{i}", True)
        work.drop(f"{tag}-{i - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if now == last:
            break
        last = now
    roots = e.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("comp"))
    return e.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(roots)


def trim() -> None:
    """Gives memory that a task has freed back to the system: workers are kept for the next task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def local_or_remote(uri: str):
    """A pyarrow file system and path for a Hadoop-style URI, for the files that Python workers write."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} doesn't say in which file system it lies")
    return fs.FileSystem.from_uri(uri)
