"""Row numbers over a whole table, and within groups that may hold a third of it, without a task that sees all rows.

Rows are dealt by ranges of their order, so equal values of the first column don't stay together if later ones
tell them apart. Each task numbers its own rows, the rows of all ranges are counted, and the sums of the ranges
before are added. The dealt rows are written once, because ranges come from a sample that another run of the
plan would draw anew.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

#: monotonically_increasing_id has the task above this bit and the row's place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column | str], name: str = "rank", keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """df with `name`, 1 for the first row in the given order, over all rows or within each group of keys. The order
    has to be total; of rows that are equal in it, any may come first. Null keys are a group."""
    spark = df.sparkSession
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order]]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = kept(dealt, "numbered")
    part = F.shiftright("_at", PLACE_BITS)
    sizes = sorted(tuple(r) for r in dealt.groupBy(part.alias("p")).count().collect())  # a row a range
    before = [0, *accumulate(size for _, size in sizes)]
    starts = spark.createDataFrame([(p, at) for (p, _), at in zip(sizes, before)], "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    out = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")
    if not keys:
        return out
    first = out.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg((F.min(name) - 1).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_k{i}" for i in range(len(keys))])
