"""Detectors beside the drift search: single-sample spikes, dispersed pulses, and the plain robust z-score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_TO_SIGMA
from ..sources.shared import kept
from .blocks import own, with_halo
from .dedoppler import top_k
from .rangejoin import small
from .selection import deviations

#: Time steps of a block of a series.
SERIES_BLOCK = 1 << 14
DISPERSION = 4148.808  # seconds times MHz squared, per unit of dispersion measure


def spikes(samples: DataFrame, threshold: float, most: int = 200, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Samples at the threshold or above, at most the `most` strongest of each unit."""
    found = samples.where(F.col("z") >= threshold)
    return top_k(found, "z", most, keys, ("t", "c")).withColumnRenamed("z", "power_sigma")


def isolated(found: DataFrame, hits: DataFrame, tol: float = 3.0, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Spikes that lie on no hit's track. A track is the channels that it covers at each time at which there are spikes,
    in steps of a few; a spike meets the tracks of its own time and step."""
    step = max(tol, 1.0)
    at, reach = F.col("h_c") + F.col("h_d") * F.col("t"), tol + F.col("h_w")
    h = hits.select(*keys, F.col("channel").alias("h_c"), F.col("drift").alias("h_d"), F.coalesce("bandwidth_ch", F.lit(0.0)).alias("h_w"))
    tracks = h.join(found.select(*keys, "t").distinct(), list(keys)).withColumn("_step", F.explode(F.sequence(F.floor((at - reach) / step) - 1, F.floor((at + reach) / step) + 1)))
    tracks = tracks.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("t").alias("h_t"), "_step", at.alias("h_at"), reach.alias("h_reach"))
    on = (F.floor(F.col("c") / step) == F.col("_step")) & (F.col("t") == F.col("h_t")) & (F.abs(F.col("h_at") - F.col("c")) <= F.col("h_reach"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"h_{k}"))
    return found.join(tracks, on, "left_anti")


def pooled(samples: DataFrame, columns: int, n_f: int, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Maxima over equal groups of channels; channels beyond the last whole group are left out."""
    width = max(1, n_f // columns)
    usable = width * (n_f // width if n_f < columns else columns)
    return samples.where(F.col("c") < usable).groupBy(*keys, "t", F.floor(F.col("c") / width).cast("int").alias("g")).agg(F.max("z").alias("z"))


def subbands(samples: DataFrame, n_f: int, n_sub: int = 64, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Means of n_sub equal groups of channels, each normalised over time by its median and deviation."""
    n_sub = max(1, min(n_sub, n_f))
    width = n_f // n_sub
    sub = samples.where(F.col("c") < width * n_sub).groupBy(*keys, "t", F.floor(F.col("c") / width).cast("int").alias("s")).agg(F.avg("z").alias("z"))
    mid = sub.groupBy(*keys, "s").agg(F.median("z").alias("med"))
    sub = sub.join(mid, [*keys, "s"])
    mad = sub.groupBy(*keys, "s").agg((F.median(F.abs(F.col("z") - F.col("med"))) * MAD_TO_SIGMA).alias("sig"))
    return sub.join(mad, [*keys, "s"]).select(*keys, "t", "s", ((F.col("z") - F.col("med")) / F.when(F.col("sig") > 0, F.col("sig")).otherwise(1.0)).alias("z"))


def delays(spark: SparkSession, n_f: int, n_sub: int, fch1: float, foff: float, tsamp: float) -> DataFrame:
    """(s, delay): samples by which a subband lags behind the highest one, per unit of dispersion measure."""
    width = n_f // n_sub
    s = spark.range(n_sub).select(F.col("id").cast("int").alias("s")).withColumn("f", F.lit(fch1) + F.lit(foff) * (F.col("s") * width + (width - 1) / 2))
    top = s.agg(F.max("f").alias("f_ref"))
    return s.join(F.broadcast(top)).select("s", (F.lit(DISPERSION) * (F.pow("f", F.lit(-2.0)) - F.pow("f_ref", F.lit(-2.0))) / tsamp).alias("delay"))  # one row each


def trials(lag: DataFrame, n_t: int, max_dm: float, n_dm: int) -> DataFrame:
    """(i, dm): evenly from zero to the largest measure that is useful over n_t samples."""
    useful = F.lit(n_t / 2) / F.greatest(F.max("delay"), F.lit(1e-12))
    top = lag.agg(useful.alias("useful")).select(F.least(F.lit(float(max_dm)), "useful").alias("top"), F.when(F.col("useful") > 1, n_dm).otherwise(1).alias("n"))
    return top.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "top", "n").select("i", F.when(F.col("n") > 1, F.col("top") * F.col("i") / (F.col("n") - 1)).otherwise(0.0).alias("dm"))


def dedispersed(sub: DataFrame, lag: DataFrame, dms: DataFrame, n_t: int, n_sub: int, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Each trial's time series: subbands moved back by their lag, summed, over the root of their number."""
    shift = lag.join(F.broadcast(dms)).select("s", "i", "dm", F.rint(F.col("delay") * F.col("dm")).cast("int").alias("shift")).where(F.col("shift") < n_t)
    x = sub.join(F.broadcast(shift), "s").withColumn("t", F.col("t") - F.col("shift")).where("t >= 0")  # trials times subbands: a few thousand rows
    got = x.groupBy(*keys, "i", "dm", "t").agg((F.sum("z") / F.sqrt(F.lit(float(n_sub)))).alias("v"))
    grid = sub.select(*keys).distinct().join(F.broadcast(dms)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))))
    return grid.join(got, [*keys, "i", "dm", "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def boxcars(series: DataFrame, n_t: int, widths: tuple[int, ...] = (1, 2, 4, 8, 16), keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """For each trial and width the strongest full box: its start and its signal to noise among all boxes."""
    w = Window.partitionBy(*keys, "i", "_block").orderBy("t")
    series = with_halo(series, F.col("t"), SERIES_BLOCK, 0, max(widths))  # a block sees the box that begins at its end
    boxes = [F.struct(F.lit(k).alias("w"), (F.sum("v").over(w.rowsBetween(0, k - 1)) / F.sqrt(F.lit(float(k)))).alias("box")) for k in widths if k <= n_t]
    x = own(series.withColumn("b", F.array(*boxes))).select(*keys, "i", "dm", "t", F.explode("b").alias("b")).select(*keys, "i", "dm", "t", "b.w", "b.box").where(F.col("t") <= n_t - F.col("w"))
    mid = x.groupBy(*keys, "i", "w").agg(F.median("box").alias("m"))
    x = x.join(mid, [*keys, "i", "w"])
    dev = x.groupBy(*keys, "i", "w").agg((F.median(F.abs(F.col("box") - F.col("m"))) * MAD_TO_SIGMA).alias("sd"))
    snr = (F.col("box") - F.col("m")) / F.when(F.col("sd") != 0, F.col("sd")).otherwise(1.0)
    x = x.join(dev, [*keys, "i", "w"]).withColumn("snr", F.round(snr, 9))
    best = F.max(F.struct("snr", (-F.col("t")).alias("neg_t"))).alias("b")
    return x.groupBy(*keys, "i", "dm", "w").agg(best).select(*keys, "i", "dm", "w", (-F.col("b.neg_t")).alias("t"), F.col("b.snr").alias("snr"))


def pulses(found: DataFrame, threshold: float, most: int = 50, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """One pulse for each stretch of time and width, the strongest; of equal ones the lowest trial, then width."""
    f = found.where(F.col("snr") >= threshold).withColumn("bucket", F.floor(F.col("t") / F.greatest(F.col("w"), F.lit(4))))
    w = Window.partitionBy(*keys, "bucket").orderBy(F.desc("snr"), "i", "w")
    f = f.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return top_k(f, "snr", most, keys, ("t", "i", "w")).withColumn("likely_rfi", F.col("dm") < 1.0)


def robust_z(samples: DataFrame, threshold: float = 6.0, keys: tuple[str, ...] = ("obs",)) -> DataFrame:
    """Channels whose median over time stands out from all of them by the threshold. NaN and null samples don't count."""
    z = F.when(~F.isnan("z"), F.col("z"))
    spec = kept(samples.groupBy(*keys, "c").agg(F.median(z).alias("level")).where("level IS NOT NULL"), "levels")
    std = spec.groupBy(*keys).agg(F.stddev_pop("level").alias("std"))
    scales = deviations(spec, "level", "m", "mad", keys).join(std, list(keys)).withColumn("mad", F.col("mad") * MAD_TO_SIGMA)
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("std") > 0, F.col("std")).otherwise(1e-12)
    return spec.join(small(scales), list(keys)).select(*keys, "c", "level", ((F.col("level") - F.col("m")) / scale).alias("robust_z")).where(F.col("robust_z") >= threshold)


def pulse_array(z: np.ndarray, freqs: np.ndarray, tsamp: float, threshold: float, max_dm: float, n_dm: int, n_sub: int = 64, widths: tuple[int, ...] = (1, 2, 4, 8, 16), most: int = 50) -> list[dict]:
    """subbands, dedispersed, boxcars and pulses over one unit's samples [time, channel] at once. Fewer than 32
    samples hold no pulse that could be told from a spike."""
    n_t, n_f = z.shape
    if n_t < 32 or not n_f:
        return []
    n_sub = max(1, min(n_sub, n_f))
    groups = slice(0, n_f // n_sub * n_sub)
    sub, f = z[:, groups].reshape(n_t, n_sub, -1).mean(2), freqs[groups].reshape(n_sub, -1).mean(1)
    sub = sub - np.median(sub, 0)
    scale = 1.4826 * np.median(np.abs(sub), 0)
    sub = np.vstack([sub / np.where(scale > 0, scale, 1.0), np.zeros((1, n_sub))])  # the last row stands for what lies beyond the end
    lag = DISPERSION * (f**-2.0 - f.max() ** -2.0) / tsamp
    useful = n_t / 2 / max(lag.max(), 1e-12)
    best: dict[int, tuple] = {}
    for i, dm in enumerate(np.linspace(0.0, min(max_dm, useful), n_dm if useful > 1 else 1)):
        at = np.minimum(np.arange(n_t)[:, None] + np.rint(lag * dm).astype(np.int64), n_t)
        total = np.concatenate([[0.0], np.cumsum(sub[at, np.arange(n_sub)].sum(1) / np.sqrt(n_sub))])
        for w in (w for w in widths if w <= n_t):
            box = (total[w:] - total[:-w]) / np.sqrt(w)
            off = box - np.median(box)
            snr = np.round(off / (1.4826 * np.median(np.abs(off)) or 1.0), 9)
            t = int(snr.argmax())
            if snr[t] >= threshold:
                found = (-float(snr[t]), i, w, t, float(dm))
                best[t // max(w, 4)] = min(best.get(t // max(w, 4), found), found)
    rows = sorted(best.values(), key=lambda b: (b[0], b[3], b[1], b[2]))[:most]
    return [{"i": i, "dm": dm, "w": w, "t": t, "snr": -neg, "likely_rfi": dm < 1.0} for neg, i, w, t, dm in rows]


def spike_array(z: np.ndarray, tracks: list[tuple[float, float, float]], threshold: float, lo: int, hi: int, most: int = 50, tol: float = 3.0, first: int = 200) -> list[dict]:
    """spikes and isolated over one unit: of the `first` strongest samples of all its channels those of channels lo to hi,
    `most` of them, and whether each lies on no track (channel, drift, bandwidth)."""
    t, c = np.nonzero(z >= threshold)
    order = np.lexsort((c, t, -z[t, c]))[:first]
    order = order[(c[order] >= lo) & (c[order] < hi)][:most]
    rows = []
    for k, x in zip(t[order].tolist(), c[order].tolist()):
        near = any(abs(at + drift * k - x) <= tol + width for at, drift, width in tracks)
        rows.append({"t": k, "channel": x, "power_sigma": float(z[k, x]), "isolated": not near})
    return rows
