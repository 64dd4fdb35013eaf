"""Bandpass and noise normalisation of samples (keys..., t, c, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_TO_SIGMA, nan_to_num
from .blocks import own, with_halo


def dc_channel(nfine: int, first: int = 0) -> Column:
    return F.pmod(F.col("c") + first, F.lit(nfine)) == nfine // 2


def repair_dc(samples: DataFrame, nfine: int, keys: tuple[str, ...] = ("obs",), first: int = 0, width: int = 4096) -> DataFrame:
    """Centre channels become the mean of their neighbours (of themselves at the window's ends). Channels are dealt in
    blocks with a channel of halo on either side."""
    w = Window.partitionBy(*keys, "t", "_block").orderBy("c")
    beside = lambda f, c: F.when(f("c").over(w) == c, f("z").over(w))
    near = (F.coalesce(beside(F.lag, F.col("c") - 1), F.col("z")) + F.coalesce(beside(F.lead, F.col("c") + 1), F.col("z"))) * 0.5
    x = with_halo(samples, F.col("c"), width, 1, 1)
    return own(x.withColumn("z", F.when(dc_channel(nfine, first), near).otherwise(F.col("z"))))


def block_of(block: int) -> Column:
    return F.floor(F.col("c") / block).cast("int")


def knots(samples: DataFrame, block: int, stat: Column, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """A statistic for each block of channels, at the block's middle."""
    return samples.groupBy(*keys, block_of(block).alias("b")).agg(stat.alias("v"), ((F.min("c") + F.max("c")) * 0.5).alias("pos"))


def interpolated(samples: DataFrame, points: DataFrame, block: int, name: str, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """samples with knots interpolated linearly between block middles, constant beyond the outer ones."""
    w = Window.partitionBy(*keys).orderBy("b")
    p = points.withColumns({"v0": F.lag("v").over(w), "pos0": F.lag("pos").over(w), "v1": F.lead("v").over(w), "pos1": F.lead("pos").over(w)})
    x = samples.withColumn("b", block_of(block)).join(p, [*keys, "b"])
    left = F.col("v0") + (F.col("v") - F.col("v0")) * (F.col("c") - F.col("pos0")) / (F.col("pos") - F.col("pos0"))
    right = F.col("v") + (F.col("v1") - F.col("v")) * (F.col("c") - F.col("pos")) / (F.col("pos1") - F.col("pos"))
    v = F.when((F.col("c") < F.col("pos")) & F.col("v0").isNotNull(), left).when((F.col("c") > F.col("pos")) & F.col("v1").isNotNull(), right).otherwise(F.col("v"))
    return x.withColumn(name, v).drop("b", "v", "pos", "v0", "pos0", "v1", "pos1")


def mean_spectrum(samples: DataFrame, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    return samples.groupBy(*keys, "c").agg(F.avg("z").alias("z"))


def bandpass_removed(samples: DataFrame, block: int, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """samples less the block medians of their mean spectrum."""
    points = knots(mean_spectrum(samples, keys), block, F.median("z"), keys)
    return interpolated(samples, points, block, "bandpass", keys).withColumn("z", F.col("z") - F.col("bandpass"))


def block_noise(samples: DataFrame, block: int, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """1.4826 times the median absolute deviation of each block, over time and channels."""
    mid = knots(samples, block, F.median("z"), keys).select(*keys, "b", F.col("v").alias("mid"))
    off = samples.withColumn("b", block_of(block)).join(mid, [*keys, "b"]).withColumn("z", F.abs(F.col("z") - F.col("mid"))).drop("b", "mid")
    return knots(off, block, F.median("z") * MAD_TO_SIGMA, keys)


def normalize(samples: DataFrame, block: int = 512, nfine: int | None = None, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Bandpass subtracted, unit robust noise."""
    x = samples.withColumn("z", nan_to_num("z"))
    if nfine:
        x = repair_dc(x, nfine, keys)
    x = bandpass_removed(x, block, keys)
    x = interpolated(x, block_noise(x, block, keys), block, "sigma", keys)
    all_std = x.groupBy(*keys).agg(F.stddev_pop("z").alias("all_std"))
    x = x.join(all_std, list(keys))
    fallback = F.when((F.col("all_std") > 0), F.col("all_std")).otherwise(F.lit(1.0))
    good = (F.col("sigma") > 0) & (F.col("sigma") < float("inf"))
    return x.withColumn("z", F.col("z") / F.when(good, F.col("sigma")).otherwise(fallback)).drop("bandpass", "sigma", "all_std")
