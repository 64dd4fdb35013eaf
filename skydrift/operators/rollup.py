"""Statistics of runs and over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag, half_even

# What a run's row has.
NUMERIC = ("work_units", "errors", "channels", "hits", "spikes", "pulses", "cpu_seconds", "wall_seconds", "channels_per_second", "workers", "drift_searched_hz_s", "max_drift_rate_hz_s", "best_frequency_mhz", "best_drift_hz_s", "best_snr", "best_interest", "et_count")
TOTALS = ("work_units", "errors", "channels", "hits", "spikes", "pulses", "cpu_seconds", "wall_seconds")


def run_stats(units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """units(unit, pid, error, n_channels, n_hits, n_spikes, n_isolated, cpu_seconds, searched): one row a run."""
    x = units.groupBy(*keys).agg(
        F.count("*").alias("work_units"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("n_channels").alias("channels"), F.sum("n_hits").alias("hits"),
        F.sum("n_isolated").alias("spikes"), (F.sum("n_spikes") - F.sum("n_isolated")).alias("spikes_on_tones"), F.round(F.sum("cpu_seconds"), 2).alias("cpu_seconds"),
        F.count_distinct("pid").alias("workers"), F.min("searched").alias("drift_searched_hz_s"))
    return x


def stage_seconds(units: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of each stage over units(timings map)."""
    return units.select(*keys, F.explode("timings").alias("stage", "seconds")).groupBy(*keys, "stage").agg(F.round(F.sum("seconds"), 6).alias("seconds"))


def per_run(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """runs(run, stats..., searched, wanted) with their best candidate (the first of equal ones) and its flags."""
    best = candidates.groupBy("run").agg(F.max_by(F.struct("frequency_mhz", "drift_rate_hz_s", "snr", "interest", "ai_class", "mirror_image", "multi_target"), F.struct("interest", -F.col("hit_id"))).alias("b"), F.count_if(F.col("ai_class") == "technosignature_like").alias("et_count"))
    x = runs.join(best, "run", "left").withColumn("drift_degraded", F.coalesce(F.col("drift_searched_hz_s") < F.col("max_drift_rate_hz_s") * 0.999, F.lit(False)))
    return x.select(*runs.columns, "drift_degraded", F.col("b.frequency_mhz").alias("best_frequency_mhz"), F.col("b.drift_rate_hz_s").alias("best_drift_hz_s"), F.col("b.snr").alias("best_snr"), F.col("b.interest").alias("best_interest"), F.col("b.ai_class").alias("best_ai_class"), flag("b.mirror_image").alias("best_mirror_image"), flag("b.multi_target").alias("best_multi_target"), F.coalesce("et_count", F.lit(0)).alias("et_count"))


def with_totals(runs: DataFrame) -> DataFrame:
    """runs and, after them, a row of their sums; hours are seconds / 3600."""
    sums = [F.round(F.coalesce(F.sum(c), F.lit(0)).cast("double"), 2).alias(c) for c in TOTALS if c in runs.columns]
    t = runs.agg(F.concat(F.lit("TOTAL ("), F.count("*").cast("string"), F.lit(" runs)")).alias("run"), *sums, F.max("best_interest").alias("best_interest"), F.coalesce(F.bool_or("drift_degraded"), F.lit(False)).alias("drift_degraded"))
    t = t.withColumns({"cpu_hours": half_even(F.col("cpu_seconds") / 3600, 3), "wall_hours": half_even(F.col("wall_seconds") / 3600, 3)})
    return runs.withColumns({c: F.col(c).cast("double") for c in TOTALS if c in runs.columns}).unionByName(t, allowMissingColumns=True)


def best_overall(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("best_interest").isNotNull()).orderBy(F.desc("best_interest"), "run").limit(1)


def warnings(runs: DataFrame) -> DataFrame:
    """How many runs had failed units, no classifier, too little drift, or an artefact on top."""
    return runs.agg(
        F.count_if(F.coalesce("errors", F.lit(0)) > 0).alias("with_errors"), F.count_if(F.coalesce("ai_note", F.lit("")) != "").alias("without_ai"),
        F.count_if(flag("drift_degraded")).alias("degraded"), F.count_if(flag("best_mirror_image") | flag("best_multi_target")).alias("artefact_on_top"))


def run_flags() -> Column:
    """Comma-joined labels of a run's row."""
    return F.concat_ws(", ", F.when(flag("best_mirror_image"), "mirror"), F.when(flag("best_multi_target"), "multi-target"), F.when(flag("drift_degraded"), "drift degraded"), F.when(F.coalesce("ai_note", F.lit("")) != "", "AI inactive"), F.when(F.coalesce("errors", F.lit(0)) > 0, "failed units"))


def recovery(trials: DataFrame) -> DataFrame:
    """trials(snr, drift, found): the share found in each cell."""
    return trials.groupBy("snr", "drift").agg(F.avg(F.col("found").cast("double")).alias("rate"), F.count("*").alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def recall_by_band(rows: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Recall of each label by band of |drift|."""
    band = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        band = F.when(F.abs("drift") < edges[k], k).otherwise(band)
    return rows.groupBy("label", band.cast("int").alias("band")).agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("recall"), F.count("*").alias("n"))


def throughput(units: DataFrame, bytes_per_value: int = 4) -> DataFrame:
    """Megabytes read, their rate, and units that gave up, for each pass."""
    mb = F.sum(F.col("n_channels") * F.col("n_t") * bytes_per_value) / float(1 << 20)
    return units.groupBy("pass_no").agg(F.count("*").alias("units"), F.round(mb, 6).alias("mb"), F.round(mb / F.sum("seconds"), 6).alias("mb_per_s"), F.count_if(F.col("error").isNotNull()).alias("gave_up"))
