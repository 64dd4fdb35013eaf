"""De-drifted snippets of hits and what they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = 32
# The names of what is measured, in their order.
SCALARS = ("snr", "abs_drift_ch", "zero_drift", "bandwidth_ch", "on_fraction", "modulation", "kurtosis", "wobble_rms", "sidelobe_ratio", "off_track_level", "peak_to_mean")


def snippets(hits: DataFrame, samples: DataFrame, n_t: int) -> DataFrame:
    """(hit_id, t, x, v): 64 columns around each hit's track, zero beyond the window. x = 32 is on the track."""
    grid = hits.select("hit_id", "obs", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))).alias("t"), "channel", "drift")
    grid = grid.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1)))).withColumn("c", (F.rint(F.col("channel") + F.col("drift") * F.col("t")) - HALF + F.col("x")).cast("int"))
    return grid.join(samples, ["obs", "t", "c"], "left").select("hit_id", "t", "x", F.coalesce("z", F.lit(0.0)).alias("v"))


def images(snips: DataFrame, n_t: int, rows: int = 16, pool: int = 4) -> DataFrame:
    """(hit_id, r, q, v): rows averaged to `rows` bins and columns by `pool`, over the largest magnitude."""
    if n_t == rows:
        binned = snips.withColumn("r", F.col("t"))
    else:
        a, b = F.floor(F.col("r") * n_t / rows), F.floor((F.col("r") + 1) * n_t / rows)
        bins = snips.sparkSession.range(rows).select(F.col("id").cast("int").alias("r")).select("r", F.explode(F.sequence(a, F.greatest(b, a + 1) - 1)).alias("t"))
        binned = snips.join(F.broadcast(bins), "t")  # as many rows as time samples, or bins
    img = binned.groupBy("hit_id", "r", F.floor(F.col("x") / pool).cast("int").alias("q")).agg(F.avg("v").alias("v"))
    top = img.groupBy("hit_id").agg((F.max(F.abs("v")) + 1e-6).alias("top"))
    return img.join(top, "hit_id").select("hit_id", "r", "q", (F.col("v") / F.col("top")).alias("v"))


def scalars(hits: DataFrame, snips: DataFrame, digits: int = 9) -> DataFrame:
    """The scalar features of each hit(hit_id, snr, drift)."""
    c = HALF
    prof = snips.groupBy("hit_id", "x").agg(F.round(F.avg("v"), digits).alias("p"))
    near = lambda lo, hi: F.col("x").between(lo, hi)
    p = prof.groupBy("hit_id").agg(F.max(F.when(near(c - 1, c + 1), F.col("p"))).alias("peak"), F.avg(F.when(near(c - 20, c - 5) | near(c + 5, c + 20), F.col("p"))).alias("side"))
    low = F.col("p") <= 0.5 * F.greatest("peak", F.lit(1e-6))
    edge = prof.join(p.select("hit_id", "peak"), "hit_id").groupBy("hit_id").agg(F.max(F.when(low & (F.col("x") < c), F.col("x"))).alias("lo"), F.min(F.when(low & (F.col("x") > c), F.col("x"))).alias("hi"))
    offs = F.max(F.when(near(c - 6, c + 6), F.struct("v", (-F.col("x")).alias("neg"))))
    row = snips.groupBy("hit_id", "t").agg(F.max(F.when(near(c - 1, c + 1), F.col("v"))).alias("on"), offs.alias("o"), F.sum(F.when(~near(c - 4, c + 4), F.col("v"))).alias("off")).withColumn("w", -F.col("o.neg") - c)
    strong = F.col("on") > 1.5
    t = row.groupBy("hit_id").agg(
        F.avg("on").alias("mean_on"), F.stddev_pop("on").alias("sd"), F.max("on").alias("max_on"), F.avg(F.when(F.col("on") > 2.0, 1.0).otherwise(0.0)).alias("on_fraction"),
        F.count_if(strong).alias("n_strong"), F.avg(F.when(strong, F.col("w") * F.col("w"))).alias("w2"), (F.sum("off") / (F.count("*") * (2 * HALF - 9))).alias("off_track_level"))
    m = row.join(t.select("hit_id", "mean_on"), "hit_id").groupBy("hit_id").agg(F.avg(F.pow(F.col("on") - F.col("mean_on"), 4)).alias("m4"), F.avg(F.pow(F.col("on") - F.col("mean_on"), 2)).alias("m2"))
    x = hits.select("hit_id", "snr", "drift").join(p, "hit_id").join(edge, "hit_id").join(t, "hit_id").join(m, "hit_id")
    base: Column = F.abs("mean_on") + 1e-3
    return x.select(
        "hit_id", "snr", F.abs("drift").alias("abs_drift_ch"), F.when(F.abs("drift") < 0.02, 1.0).otherwise(0.0).alias("zero_drift"),
        (F.coalesce("hi", F.lit(2 * HALF)) - F.coalesce("lo", F.lit(-1)) - 1).cast("double").alias("bandwidth_ch"), "on_fraction",
        (F.col("sd") / base).alias("modulation"), (F.col("m4") / F.pow(F.when(F.col("m2") != 0, F.col("m2")).otherwise(1e-9), 2)).alias("kurtosis"),
        F.when(F.col("n_strong") >= 2, F.sqrt("w2")).otherwise(6.0).alias("wobble_rms"), (F.col("side") / (F.col("peak") + 1e-3)).alias("sidelobe_ratio"), "off_track_level",
        (F.col("max_on") / base).alias("peak_to_mean"))


def vectors(hits: DataFrame, snips: DataFrame, n_t: int) -> DataFrame:
    """hit_id and its 267 numbers: the scalars, then the image row by row."""
    img = images(snips, n_t).groupBy("hit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "q", "v"))), lambda s: s["v"]).alias("img"))
    return scalars(hits, snips).join(img, "hit_id").select("hit_id", F.concat(F.array(*[F.col(s) for s in SCALARS]), "img").alias("features"))
