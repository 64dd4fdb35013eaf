"""Exact deduplication as stateful streaming.

The keyed state, in RocksDB on the executors' disks and checkpointed in the shared folder, never
expires: for each digest it keeps how many rows had it, the best row's identifier and where that
row's content lies. Later runs with the same state folder go on from there. On hits (digests of
several rows) whole texts are compared; should two texts share a digest, they are told apart.

Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]. Of equal texts the
row with the most code points in the original text stays, then the one with the smallest doc_id, which may be
of any type that has an order. Null texts count as empty; a row without a doc_id stays only if no row of its length has one; repeated
rows count as members of their group; an empty table gives an empty result; other columns are
ignored, whatever their names. Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small

#: State on the executors' disks; log files are not allocated ahead, for there are many small stores.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _rows(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col("text"))
    return df.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len"), norm.alias("norm"), digest(norm).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _best() -> Column:
    """The longest row, of equal ones that of least id; rows without an id come last."""
    return F.min(F.struct((-F.col("len")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))


def ingest(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Streams the Parquet files at path that the state has not seen into it; returns the state's
    latest rows: digest, group_size, keep_len, keep_id, file, row."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    best = _best()
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, it may name one file or a folder
    keyed = _rows(reader.parquet(path), digest).groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/checkpoint")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{state}/changes/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        changes = spark.read.parquet(f"{state}/changes")
    except Exception as e:  # no batch has run: there were no files or no rows
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        changes = spark.createDataFrame([], keyed.schema)
    # counts only grow, so the largest is the last
    last = changes.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s"))
    return last.select("digest", "s.group_size", (-F.col("s.best.less")).alias("keep_len"), F.col("s.best.doc_id").alias("keep_id"), F.col("s.best.file").alias("file"), F.col("s.best.row").alias("row"))


def dedup(spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of the documents at path: doc_id, keep_id, group_size, kept, text_sha256."""
    work = Workspace(spark, "exact-dedup")
    groups = work.table(ingest(spark, path, state or work.at("state"), digest), "groups")
    rows = _rows(spark.read.parquet(path), digest)
    hits = groups.where("group_size > 1").select("digest")
    # whole texts are compared where a digest came again; partial minima shrink large groups before the shuffle
    checked = rows.join(small(hits, 64), "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    clash = work.table(checked.where("lo <> hi").select("digest"), "clash")
    some = clash.count() > 0
    plain = rows.select("doc_id", "len", "digest", "file", "row").join(groups.select("digest", "group_size", "keep_id", F.col("file").alias("kfile"), F.col("row").alias("krow")), "digest")
    is_best = (F.col("file") == F.col("kfile")) & (F.col("row") == F.col("krow"))
    if some:
        plain = plain.join(clash, "digest", "left_anti")
    out = plain.select("doc_id", "keep_id", "group_size", is_best.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if some:
        clashing = rows.join(small(clash, 64), "digest", "left_semi")
        apart = clashing.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _best().alias("b"))
        told = clashing.join(apart, ["digest", "norm"])
        out = out.unionByName(told.select("doc_id", F.col("b.doc_id").alias("keep_id"), "group_size", ((F.col("file") == F.col("b.file")) & (F.col("row") == F.col("b.row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))
    return out
