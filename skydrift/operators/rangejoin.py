"""Range joins as equi joins on buckets: a key on each side, and neighbours of the bucket on one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, row_bytes: int = 100, most: int = 48 << 20) -> DataFrame:
    """df with a broadcast hint if a count shows that it fits; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def bucketed(left: DataFrame, right: DataFrame, x: Column, y: Column, width: float, cond: Column, keys: tuple[tuple[Column, Column], ...] = (), how: str = "inner") -> DataFrame:
    """Pairs with |x - y| <= width and cond. Buckets are a little wider than the tolerance, so rounding
    never puts such a pair two buckets apart. left's rows come once for three buckets; right's aren't copied.
    For semi and anti joins the copies are on the right, so left's rows stay single."""
    w = width * (1 + 1e-9) + 1e-12
    floor = lambda c: F.floor(c / w)
    three = lambda c: F.explode(F.array(floor(c) - 1, floor(c), floor(c) + 1))
    if how.startswith("left_"):
        a, b = left.withColumn("_bx", floor(x)), right.withColumn("_by", three(y))
    else:
        a, b = left.withColumn("_bx", three(x)), right.withColumn("_by", floor(y))
    on = (F.col("_bx") == F.col("_by")) & cond
    for p, q in keys:
        on = on & (p == q)
    return a.join(b, on, how).drop("_bx", "_by")
