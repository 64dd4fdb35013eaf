"""Header arithmetic: frequency axes, drift limits, and how a file is cut into work units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.exprs import col

COARSE_WIDTH_HZ = 2.9296875e6


def frequency(channel: Column | str, fch1: Column | str = "fch1", foff: Column | str = "foff") -> Column:
    return col(fch1) + col(foff) * col(channel)


def band_edges(df: DataFrame) -> DataFrame:
    last = frequency(F.col("nchans") - 1)
    return df.withColumn("f_min", F.least("fch1", last)).withColumn("f_max", F.greatest("fch1", last))


def fine_per_coarse() -> Column:
    """Channels per coarse channel: a power of two within 1% of the width ratio that divides the band; else null."""
    n = F.lit(COARSE_WIDTH_HZ) / F.abs(F.col("foff") * 1e6)
    p = F.when(n > 1, F.rint(F.log2(n))).otherwise(F.lit(0.0)).cast("int")
    two = F.pow(F.lit(2.0), p)
    return F.when((F.col("foff") != 0) & (p > 0) & (F.abs(two - n) / n < 0.01) & (F.col("nchans") % two == 0), two.cast("long"))


def channel_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """First and one past the last channel of a frequency range, clamped into the band, never inverted."""
    a, b = (lo - F.col("fch1")) / F.col("foff"), (hi - F.col("fch1")) / F.col("foff")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col("nchans").cast("long"), c.cast("long")))
    c0, c1 = clamp(F.floor(F.least(a, b))), clamp(F.ceil(F.greatest(a, b)) + 1)
    bad = F.col("foff") == 0
    stop = F.when(bad, F.raise_error(F.lit("cannot map a frequency range: foff is zero")).cast("long")).otherwise(F.greatest(c0, c1))
    return c0, stop


def drift_ceiling(cfg: SearchConfig) -> Column:
    """Channels per sample that are searched at most."""
    hz = F.abs(F.col("foff")) * 1e6
    k = F.when(hz > 0, F.ceil(F.lit(cfg.max_drift_rate_hz_s) * F.col("tsamp") / hz)).otherwise(1)
    return F.greatest(F.lit(1), F.least(k, F.lit(max(1, cfg.max_drift_ch_per_step)))).cast("long")


def padding(cfg: SearchConfig) -> Column:
    return drift_ceiling(cfg) * F.greatest(F.col("nsamples"), F.lit(1)).cast("long") + 8


def drift_resolvable(cfg: SearchConfig) -> Column:
    hz = F.abs(F.col("foff")) * 1e6
    return (hz == 0) | (F.lit(cfg.max_drift_rate_hz_s) * F.col("nsamples") * F.col("tsamp") >= hz)


def unit_megabytes(cfg: SearchConfig) -> Column:
    width = F.least(F.lit(cfg.channels_per_unit).cast("long"), F.col("nchans").cast("long")) + padding(cfg) * 2
    return F.least(width, F.col("nchans").cast("long")) * F.col("nsamples") * 4 / float(1 << 20)


def unit_too_large(cfg: SearchConfig) -> Column:
    """Why a unit of this file would not fit, or null."""
    mb = unit_megabytes(cfg)
    return F.when(mb > cfg.max_download_mb, F.concat(F.lit("a unit would be "), F.ceil(mb).cast("string"), F.lit(f" MB; the limit is {cfg.max_download_mb}")))


def drift_limits(df: DataFrame, rate: float, cap: int | None) -> DataFrame:
    """From n_t, n_f, tsamp and foff: k_needed, k_config, k_max, searched_hz_s, and whether the window is too narrow."""
    hz = F.abs(F.col("foff")) * 1e6
    needed = F.when(hz > 0, F.abs(F.lit(rate) * F.col("tsamp") / hz)).otherwise(1.0)
    config = F.greatest(F.lit(0), F.ceil(needed) - 1)
    if cap is not None:
        config = F.least(config, F.lit(max(0, cap - 1)))
    top = F.least(config, F.greatest(F.lit(0), F.floor(F.col("n_f") / F.greatest("n_t", F.lit(1))) - 1))
    searched = F.when((hz == 0) | (F.col("tsamp") == 0), F.lit(rate)).otherwise(F.least(F.lit(rate), (top + 1) * hz / F.col("tsamp")))
    too_wide = hz * F.col("tsamp") > 1e6
    k_max = F.when(too_wide, F.raise_error(F.lit("foff must be in MHz")).cast("long")).otherwise(top.cast("long"))
    return df.withColumns({"k_needed": needed, "k_config": config.cast("long"), "k_max": k_max, "searched_hz_s": searched, "degraded": top < config})


def split_units(files: DataFrame, cfg: SearchConfig, width: int | None = None) -> DataFrame:
    """A row for each work unit of files(stem, nchans, nsamples, tsamp, foff, c0, c1)."""
    w = width or max(1024, cfg.channels_per_unit)
    cores = F.when(F.col("c1") > F.col("c0"), F.sequence(F.col("c0"), F.col("c1") - 1, F.lit(w).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = files.withColumn("core_start", F.explode(cores)).withColumn("core_stop", F.least(F.col("core_start") + w, F.col("c1"))).withColumn("pad", padding(cfg))
    return out.withColumns({
        "chan_start": F.greatest(F.lit(0).cast("long"), F.col("core_start") - F.col("pad")),
        "chan_stop": F.least(F.col("nchans").cast("long"), F.col("core_stop") + F.col("pad")),
        "unit_id": F.format_string("%s:%d-%d", "stem", "core_start", "core_stop"),
    })


def owned(hits: DataFrame, channel: str = "channel") -> DataFrame:
    """Hits that lie in their unit's own core, so that overlapping units report each once."""
    return hits.where((F.col(channel) >= F.col("core_start")) & (F.col(channel) < F.col("core_stop")))


def samples_of_units(samples: DataFrame, units: DataFrame, block: int = 4096) -> DataFrame:
    """Samples (obs, t, c, z) replicated to each unit whose padded window holds them, with channels relative to it. They
    meet by blocks of channels, so a sample sees the units that reach into its block and no others of its file."""
    u = units.select("obs", "unit_id", "chan_start", "chan_stop", "core_start", "core_stop").where("chan_stop > chan_start")
    blocks = F.sequence(F.floor(F.col("chan_start") / block), F.floor((F.col("chan_stop") - 1) / block))
    u = u.withColumn("_block", F.explode(blocks))  # grows with the files, so the planner chooses the join
    x = samples.withColumn("_block", F.floor(F.col("c") / block)).join(u, ["obs", "_block"]).where("c >= chan_start AND c < chan_stop")
    return x.drop("_block").withColumn("c", F.col("c") - F.col("chan_start"))
