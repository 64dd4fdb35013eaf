"""Exact quantiles of large groups: two passes over the values, and no buffer that grows with a group.

The first pass keeps a mergeable sketch a group, from which come a lower and an upper bound around each place that
is asked for. The second pass counts what lies below the lower bound and, value by value, what lies between the
bounds, a few thousandths of the group at most unless values are equal, and equal ones are one row with a count.
Running sums over that slice find the values at the places exactly. Should a sketch ever have missed a place, its
group raises an error instead of a wrong number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .rangejoin import small

#: The sketch's places are right to one part in so many; bounds lie three such parts on either side.
ACCURACY, MARGIN = 10_000, 3
#: Groups of fewer values are sliced whole.
FEW = 2 * ACCURACY


def quantiles(df: DataFrame, value: str, at: dict[str, float], keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """(keys, a column for each quantile of `at`, name: share from 0 to 1) with linear interpolation between the two
    values beside a place, as percentile() has it. Null values don't count; a group without values has nulls. Null
    keys are a group."""
    x = df.select(*keys, F.col(value).cast("double").alias("_v"))
    top = F.nanvl(F.col("_v"), F.lit(float("inf")))  # NaN is the largest value
    ask = sorted({min(1.0, max(0.0, q + side * MARGIN / ACCURACY)) for q in at.values() for side in (-1, 1)})
    bound = {q: [ask.index(min(1.0, max(0.0, q + side * MARGIN / ACCURACY))) for side in (-1, 1)] for q in at.values()}
    sketch = x.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx(top, ask, ACCURACY).alias("_ask"))
    sides = F.array(*[F.struct(F.col("_ask")[a].alias("lo"), F.col("_ask")[b].alias("hi")) for a, b in bound.values()])
    groups = kept(sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", sides.alias("_sides")), "quantiles")  # a row a group
    own = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    few = F.col("_n") < FEW
    near = x.where("_v IS NOT NULL").join(small(groups), own)
    # below a bound, values are one row; above it, none; between the bounds, a row a value
    parts = F.transform("_sides", lambda s, i: F.struct(i.alias("q"), F.when(~few & (top < s["lo"]), F.lit(None).cast("double")).otherwise(F.col("_v")).alias("v"), (few | (top <= s["hi"])).alias("in")))
    counted = near.select(*keys, "_n", F.explode(F.filter(parts, lambda p: p["in"])).alias("_p")).select(*keys, "_n", F.col("_p.q").alias("_q"), F.col("_p.v").alias("_v")).groupBy(*keys, "_n", "_q", "_v").agg(F.count("*").alias("_m"))
    order = Window.partitionBy(*keys, "_q").orderBy(F.col("_v").asc_nulls_first())
    counted = counted.withColumn("_upto", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.element_at(F.array(*[F.lit(float(q)) for q in bound]), F.col("_q") + 1) * (F.col("_n") - 1)
    holds = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_m") <= k), F.col("_v")))
    placed = counted.withColumns({"_place": place, "_k0": F.floor(place), "_k1": F.ceil(place)})
    found = placed.groupBy(*keys, "_q", "_place", "_k0", "_k1").agg(holds(F.col("_k0")).alias("_v0"), holds(F.col("_k1")).alias("_v1"))
    between = F.when(F.col("_k0") == F.col("_k1"), F.col("_v0")).otherwise((F.col("_k1") - F.col("_place")) * F.col("_v0") + (F.col("_place") - F.col("_k0")) * F.col("_v1"))
    missed = F.raise_error(F.lit("a quantile lies outside its sketch's bounds")).cast("double")
    sure = F.when(F.col("_v0").isNull() | F.col("_v1").isNull(), missed).otherwise(between)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == list(bound).index(q), sure)).alias(name) for name, q in at.items()])
    again = reduce(Column.__and__, [wide[k].eqNullSafe(groups[f"_k{i}"]) for i, k in enumerate(keys)], F.lit(True))
    return groups.join(wide, again, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *at)


def medians(df: DataFrame, value: str, name: str = "med", keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    return quantiles(df, value, {name: 0.5}, keys)


def deviations(df: DataFrame, value: str, mid: str = "med", mad: str = "mad", keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """(keys, mid, mad): the median, and the median distance from it."""
    m = medians(df, value, mid, keys)
    renamed = m.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], mid)
    own = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.lit(True))
    off = df.select(*keys, value).join(small(renamed), own).select(*keys, mid, F.abs(F.col(value) - F.col(mid)).alias("_off"))
    return medians(off, "_off", mad, (*keys, mid))
