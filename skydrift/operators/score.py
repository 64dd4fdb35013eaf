"""Interest scores, classes, ranks, and why a signal is set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, half_even
from .ordering import numbered

OOD_FACTOR, OOD_FALLBACK_SNR_MAX = 3.0, 40.24


def stationary(n_t: Column | int, drift: str = "drift") -> Column:
    """Moves less than a channel over the scan."""
    n = F.lit(n_t) if isinstance(n_t, int) else n_t
    return F.abs(drift) * F.greatest(n - 1, F.lit(1)) <= 1 + 1e-6


def out_of_distribution(snr_max: float | None = None) -> Column:
    return F.col("snr") > OOD_FACTOR * (snr_max or OOD_FALLBACK_SNR_MAX)


def best_class(probabilities: list[str]) -> Column:
    """The label of the largest p_ column; of equal ones the first; null if there is none."""
    best = F.array_max(F.filter(F.array(*[F.struct(F.col(p).alias("p"), F.lit(-k).alias("k"), F.lit(p[2:]).alias("label")) for k, p in enumerate(probabilities)]), lambda x: x["p"].isNotNull()))
    return best["label"]


def interest(df: DataFrame, threshold: float, snr_max: float | None = None, any_probability: bool = True) -> DataFrame:
    """df with ood and interest, 0 to 100, one decimal."""
    ood = out_of_distribution(snr_max)
    s_snr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-(F.col("snr") - threshold) / threshold)))
    still = flag("stationary")
    rule = F.when(~still & (F.col("bandwidth_ch") <= 4) & (F.col("on_fraction") >= 0.5), 0.7).otherwise(0.0)
    p = F.when(ood, rule).otherwise(F.coalesce("p_technosignature_like", F.lit(0.0))) if any_probability and "p_technosignature_like" in df.columns else rule
    score = 0.55 * p + 0.20 * s_snr + 0.25 * F.coalesce("anomaly", F.lit(0.5))
    for when, factor in ((still & ~flag("drift_unresolved"), 0.3), (flag("known_rfi_band"), 0.5), (F.col("bandwidth_ch") > 8, 0.4), (flag("mirror_image"), 0.2), (ood, 0.3)):
        score = score * F.when(when, factor).otherwise(1.0)
    value = half_even(score * 100, 1)
    return df.withColumns({"ood": ood, "interest": F.when(ood, F.least(value, F.lit(50.0))).otherwise(value)})


def ranked(df: DataFrame, by: str = "interest", keys: tuple[str, ...] = (), tie: tuple[str, ...] = ("hit_id",)) -> DataFrame:
    """df with rank, largest first, over all rows or within keys; a window for keys, whose top rows Spark can pick early."""
    if not keys:
        return numbered(df, [F.desc(by), *tie])
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), *tie)))


# Reasons in order of weight; a signal counts under the first that holds.
REASONS = ("mirror_image", "cadence_failed", "multi_target", "known_rfi_band", "stationary", "out_of_distribution", "drift_unresolved", "ai_rfi", "ai_noise")


def set_aside_masks() -> dict[str, Column]:
    return {
        "mirror_image": flag("mirror_image"),
        "cadence_failed": F.coalesce(F.col("cadence") == "failed", F.lit(False)),
        "multi_target": flag("multi_target"),
        "known_rfi_band": flag("known_rfi_band"),
        "stationary": flag("stationary") & ~flag("drift_unresolved"),
        "out_of_distribution": F.coalesce(F.col("ai_class") == "out_of_distribution", F.lit(False)),
        "drift_unresolved": flag("drift_unresolved"),
        "ai_rfi": F.coalesce(F.col("ai_class").startswith("rfi_"), F.lit(False)),
        "ai_noise": F.coalesce(F.col("ai_class") == "noise", F.lit(False)),
    }


def set_aside(df: DataFrame) -> DataFrame:
    """df with reason: the first that holds, or null for what is left."""
    masks, reason = set_aside_masks(), None
    for name in REASONS:
        reason = F.when(masks[name], name) if reason is None else reason.when(masks[name], name)
    return df.withColumn("reason", reason)
