"""Windows over one long axis, a block at a time: neighbours come along as a halo, so no task holds a whole observation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, at: Column, width: int, before: int, after: int) -> DataFrame:
    """df with _block, blocks of `width` places, and _own: false for copies of rows that lie up to `before` places
    before another block or `after` behind it. Rows amid a block aren't copied."""
    block = lambda x: F.floor(x / F.lit(width))
    return df.withColumn("_block", F.explode(F.sequence(block(at - after), block(at + before)))).withColumn("_own", F.col("_block") == block(at))


def dealt(df: DataFrame, rows: int, most: int, *by: str) -> DataFrame:
    """df, which has so many rows, dealt by columns in parts of about `most` rows, so that what a task holds doesn't
    grow with df. Rows of equal columns stay together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, math.ceil(rows / most)), *by)


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_block", "_own")


def peaks(df: DataFrame, at: str, value: str, window: int, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    """Rows at the threshold or above that are the largest within `window` places on either side; equal ones all stay.

    Blocks are as long as a window, so each window is the end of one block and the beginning of the next. A row that
    passes the threshold sends a probe to either end of its window; at the first the largest value from there to the
    block's end is read, at the other the largest one from the block's beginning to it. Places may be missing."""
    span = 2 * window + 1
    rest = F.struct(*[F.col(c) for c in df.columns])
    row = lambda side, v: F.struct((F.col(at) + side * window).alias("pos"), F.lit(side).alias("side"), v.alias("v"), F.when(F.lit(side != 0), rest).alias("row"))
    none = F.lit(None).cast(dict(df.dtypes)[value])
    rows = F.when(F.col(value) >= threshold, F.array(row(0, F.col(value)), row(-1, none), row(1, none))).otherwise(F.array(row(0, F.col(value))))
    x = df.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").withColumn("block", F.floor(F.col("pos") / span))
    w = Window.partitionBy(*keys, "block")
    upto, onward = [F.max("v").over(w.orderBy(o).rangeBetween(Window.unboundedPreceding, 0)) for o in (F.asc("pos"), F.desc("pos"))]
    seen = x.withColumn("near", F.when(F.col("side") < 0, onward).when(F.col("side") > 0, upto)).where("side <> 0")
    most = seen.groupBy("row").agg(F.max("near").alias("near"))
    return most.where(F.col(f"row.{value}") == F.col("near")).select("row.*")
