"""A survey's candidate catalogue: every hit of a table with its interest, class, why it is set aside, and its ranks.

    python -m jobs.catalogue --hits HITS --out FOLDER [--config FILE]

HITS is any Parquet table; the settings say, as SQL expressions, which of its columns are a hit's fields. Mirror
images are looked for within a file and the same frequency in other targets over the whole survey, the score and
the class follow from both, and ranks are given over all hits and within a target. The catalogue is written by
target, and partitions that come again are overwritten whole, so a rerun over the same hits leaves the same rows.
Targets that are no longer among the hits keep their last rows. Rows without hit_id or target are left out, and
their number is logged. Equal interest is ordered by hit_id, which has to be unique.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.config import KNOWN_BANDS_MHZ
from skydrift.functions.exprs import in_bands
from skydrift.operators import rfi, score
from skydrift.operators.ordering import numbered
from skydrift.sources.shared import kept

from .common import log, session, settings

COLUMNS = ("hit_id", "target", "frequency_mhz", "drift_rate_hz_s", "snr", "interest", "ai_class", "reason", "mirror_image", "multi_target", "rank", "target_rank")


def scored(hits: DataFrame, cfg: dict) -> DataFrame:
    """hits with flags, interest, ai_class and reason."""
    bands = [tuple(b) for b in cfg["known_rfi_bands_mhz"] or KNOWN_BANDS_MHZ]
    hits = hits.withColumns({"mirror_channel": rfi.mirror_channel(cfg["fine_channels"]), "stationary": score.stationary(cfg["samples"]), "known_rfi_band": in_bands("frequency_mhz", bands)})
    marked = rfi.mirror_pairs(hits, cfg["mirror_tol_channels"])
    found = score.interest(marked, cfg["snr_threshold"], cfg["snr_max"])
    seen = hits.select("target", "frequency_mhz")
    found = rfi.multi_target(found, seen, cfg["multi_target_tol_khz"], cfg["multi_target_band_khz"], cfg["multi_target_band_hits"], seen)
    label = score.best_class([f"p_{c}" for c in cfg["classes"]])
    return score.set_aside(found.withColumn("ai_class", F.when(F.col("ood"), "out_of_distribution").otherwise(label)))


def run(spark: SparkSession, hits_path: str, out: str, cfg: dict | None = None) -> DataFrame:
    """Writes the catalogue of the hits at hits_path below out, and returns it as it stands."""
    cfg, say = cfg or settings("catalogue"), log("catalogue")
    table = spark.read.parquet(hits_path)
    hits = table.select(*[F.expr(e).alias(c) for c, e in cfg["hits"].items()])
    usable = F.col("hit_id").isNotNull() & F.coalesce(F.col("target") != "", F.lit(False))  # a partition has no empty name
    hits = kept(hits.where(usable), "catalogue-hits")
    n_read, n = table.count(), hits.count()  # of Parquet files: from their footers
    say.info("read %d hits from %s, %d of them without hit_id or target", n_read, hits_path, n_read - n)
    found = numbered(scored(hits, cfg), [F.desc("interest"), "hit_id"])
    found = numbered(found, ["rank"], "target_rank", ("target",)).select(*COLUMNS)
    # a hot target goes to several files; a target's rows are replaced, all others stay
    found.hint("rebalance", "target").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", cfg["max_records_per_file"]).partitionBy("target").parquet(out)
    now = spark.read.schema(found.schema).parquet(out).select(*COLUMNS)
    say.info("wrote %d hits to %s, which has %d now", n, out, now.count())
    return now


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.catalogue", description="Catalogue of a survey's hits")
    p.add_argument("--hits", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = session("catalogue")
    try:
        run(spark, a.hits, a.out, settings("catalogue", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
