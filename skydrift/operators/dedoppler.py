"""De-Doppler search: power summed along every linear drift path.

Two forms give the same hits, and both share partial sums in a Taylor tree. The relational one deals channels in
blocks and sums by grouping; the kernel (see kernel.py) works on a unit's samples as an array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_TO_SIGMA
from ..sources.shared import kept
from . import blocks
from .blocks import dealt, with_halo
from .rangejoin import small
from .selection import deviations


#: Samples of a task's part. Each becomes some ten rows a round of the tree, or a row for each of the paths.
PART = 1 << 16


def padded_rows(n_t: int) -> int:
    """The least power of two, two at least, that holds n_t rows."""
    return 1 << max(1, math.ceil(math.log2(max(n_t, 2))))


def offset(row: Column, d: Column, m: int) -> Column:
    """Channels that the tree's path of total drift d has moved by at a row, of 2**m rows."""
    out = F.lit(0)
    for j in range(m):
        half = F.shiftright(d, j) - F.shiftright(d, j + 1)
        out = out + F.shiftright(row, m - 1 - j).bitwiseAND(F.lit(1)) * half
    return out


def paths(spark: SparkSession, n_t: int, k_max: int, k_limit: float | None = None) -> DataFrame:
    """(sign, k, d, t, delta): where each path lies at each row, relative to its start. A shear that the next one
    begins with is left out, zero drift is there once, and no drift is beyond k_limit channels per step."""
    tp = padded_rows(n_t)
    span, m = tp - 1, tp.bit_length() - 1
    if k_limit is not None and k_limit < 1.0 / span:
        d = spark.range(1).select(F.lit(0).alias("k"), F.lit(0).alias("d"))
    else:
        d = spark.range((k_max + 1) * tp).select((F.col("id") / tp).cast("int").alias("k"), (F.col("id") % tp).cast("int").alias("d"))
        d = d.where((F.col("d") < span) | (F.col("k") == k_max))
        if k_limit is not None:
            d = d.where(F.col("k") + F.col("d") / span <= k_limit + 1e-9)
    t = F.explode(F.sequence(F.lit(0), F.lit(n_t - 1)))
    d = d.withColumn("t", t).withColumn("delta", F.col("k") * F.col("t") + offset(F.col("t"), F.col("d"), m))
    return d.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).where("sign = 1 OR k + d > 0").withColumn("delta", F.col("sign") * F.col("delta"))


def column_noise(samples: DataFrame, n_t: int, keys: tuple[str, ...] = ("obs",), every: int = 3) -> DataFrame:
    """Median and scale of column sums, of every third column as the reference takes them, or of all with every=1; the
    scale of zero deviation is the square root of n_t."""
    sums = samples.groupBy(*keys, "c").agg(F.sum("z").alias("s")).where(F.col("c") % every == 0)
    mad = deviations(kept(sums, "column-sums"), "s", keys=keys).withColumn("mad", F.col("mad") * MAD_TO_SIGMA)
    return mad.select(*keys, "med", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.lit(math.sqrt(n_t))).alias("scale"))


def path_sums(samples: DataFrame, table: DataFrame, n_f: int, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """The sum along each path of a table from each start channel; samples beyond the window count as zero. Every
    path adds its own samples; tree_sums shares them. Samples are dealt before they meet paths, and sums stay where
    they are."""
    x = dealt(samples.select(*keys, "t", "c", "z"), samples.count(), PART, *keys)
    x = x.join(small(table), "t").withColumn("start", F.col("c") - F.col("delta")).where((F.col("start") >= 0) & (F.col("start") < n_f))
    return x.groupBy(*keys, "start", "sign", "k", "d").agg(F.sum("z").alias("power"))


def tree_sums(samples: DataFrame, n_t: int, n_f: int, k_max: int, k_limit: float | None = None, keys: tuple[str, ...] = ("obs",), width: int | None = None) -> DataFrame:
    """What path_sums gives for the table of paths, by a Taylor tree: in each of log2(n_t) rounds two neighbouring
    stretches of samples, already summed for half the drift, become one. A sample is in two rows a round, not in one
    for every drift.

    Start channels are dealt in blocks; a block has all samples that a path from it can meet, a halo on either side.
    That is the only exchange: the rounds group by the block too, so they stay where their rows are. There are as many
    parts as the number of samples asks for, as all rounds of a part lie in a task's memory."""
    tp = padded_rows(n_t)
    span, m = tp - 1, tp.bit_length() - 1
    reach = k_max * (n_t - 1) + span
    width = width or max(1024, 4 * reach)
    x = with_halo(samples.select(*keys, "t", "c", "z"), F.col("c"), width, reach, reach).drop("_own")
    x = x.where((F.col("_block") >= 0) & (F.col("_block") <= (n_f - 1) // width))  # no path begins in others
    x = dealt(x, samples.count(), PART, *keys, "_block")
    signs = F.explode(F.array(F.lit(1), F.lit(-1)))
    x = x.withColumn("sign", signs).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k_max))))
    # a path is followed along its sign: channels count upward from its start
    x = x.select(*keys, "_block", "sign", "k", F.col("t").cast("int").alias("b"), F.lit(0).alias("d"), (F.col("c") - F.col("sign") * F.col("k") * F.col("t")).cast("long").alias("at"), F.col("z").alias("v"))
    first, last = F.col("_block") * width, (F.col("_block") + 1) * width - 1
    inside = F.when(F.col("sign") > 0, (F.col("at") >= first) & (F.col("at") <= last + span)).otherwise((F.col("at") <= last) & (F.col("at") >= first - span))
    x = x.where(inside)
    for _ in range(m):
        d = F.explode(F.array(F.col("d") * 2, F.col("d") * 2 + 1)).alias("d2")
        x = x.select(*keys, "_block", "sign", "k", "b", "d", "at", "v", d)
        step = F.when(F.col("b") % 2 == 1, F.col("d2") - F.col("d")).otherwise(0)  # the later half starts where the earlier one has drifted to
        x = x.select(*keys, "_block", "sign", "k", F.shiftright("b", 1).alias("b"), F.col("d2").alias("d"), (F.col("at") - F.col("sign") * step).alias("at"), "v").where(inside)
        x = x.groupBy(*keys, "_block", "sign", "k", "b", "d", "at").agg(F.sum("v").alias("v"))
    x = x.where((F.col("at") >= F.greatest(first, F.lit(0))) & (F.col("at") <= F.least(last, F.lit(n_f - 1))))
    x = x.where((F.col("sign") == 1) | (F.col("k") + F.col("d") > 0))
    if k_limit is not None and k_limit < 1.0 / span:
        x = x.where((F.col("k") == 0) & (F.col("d") == 0))
    else:
        x = x.where((F.col("d") < span) | (F.col("k") == k_max))
        if k_limit is not None:
            x = x.where(F.col("k") + F.col("d") / span <= k_limit + 1e-9)
    return x.select(*keys, "_block", F.col("at").alias("start"), "sign", "k", "d", F.col("v").alias("power"))


def best_paths(sums: DataFrame, n_t: int, keys: tuple[str, ...] = ("obs",), digits: int = 9) -> DataFrame:
    """The strongest path of each start channel; of equal ones the positive, then the slowest."""
    span = padded_rows(n_t) - 1
    ranked = sums.withColumn("drift", F.col("sign") * (F.col("k") * span + F.col("d")) / span)
    best = F.max(F.struct(F.round("power", digits).alias("p"), F.col("sign"), (-F.abs("drift")).alias("slow"))).alias("b")
    block = [c for c in sums.columns if c == "_block"]  # rows are dealt by it already
    return ranked.groupBy(*keys, *block, "start").agg(best).select(*keys, F.col("start").alias("c"), F.col("b.p").alias("power"), (-F.col("b.slow") * F.col("b.sign")).alias("drift"))


def snr_map(samples: DataFrame, n_t: int, n_f: int, k_max: int, k_limit: float | None = None, keys: tuple[str, ...] = ("obs",), every: int = 3) -> DataFrame:
    """(keys, c, snr, drift) of each start channel. every: see column_noise."""
    best = best_paths(tree_sums(samples, n_t, n_f, k_max, k_limit, keys), n_t, keys)
    noise = column_noise(samples, n_t, keys, every)
    return best.join(noise, list(keys)).select(*keys, "c", ((F.col("power") - F.col("med")) / F.col("scale")).alias("snr"), "drift")


def nms_window(n_t: int, n_f: int, k_max: int) -> int:
    return min(n_f, max(8, (k_max + 1) * (n_t - 1) + 4))


def peaks(snr: DataFrame, window: int, threshold: float, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Channels at the threshold or above that are the strongest within the window; equal ones all stay."""
    return blocks.peaks(snr, "c", "snr", window, threshold, keys)


def top_k(df: DataFrame, by: str, k: int, keys: tuple[str, ...] = ("obs",), tie: tuple[str, ...] = ("c",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *tie)
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= k).drop("rank_")


def hits(samples: DataFrame, n_t: int, n_f: int, k_max: int, threshold: float, k_limit: float | None = None, max_hits: int = 500, keys: tuple[str, ...] = ("obs",), every: int = 3) -> DataFrame:
    found = snr_map(samples, n_t, n_f, k_max, k_limit, keys, every)
    return top_k(peaks(found, nms_window(n_t, n_f, k_max), threshold, keys), "snr", max_hits, keys)


def with_rates(found: DataFrame, tsamp: float, foff_mhz: float, fch1: float) -> DataFrame:
    return found.withColumns({"drift_rate_hz_s": F.col("drift") * (foff_mhz * 1e6) / tsamp, "frequency_mhz": F.lit(fch1) + F.lit(foff_mhz) * F.col("c")})
