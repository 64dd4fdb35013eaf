"""Hits of one scan against the other scans of its cadence, of which only what the hits ask for is read.

A hit's drift says where it has to be in each other scan. The channels there, with the tolerance of the cadence test,
fall into blocks of a scan; each block that any hit asks for is read and searched once, in its own task. What a block
gave is kept below a folder, under a key of scan, block and everything that its search depends on, so the next run over
another scan of the cadence reads only blocks that nobody has asked for.
"""

from __future__ import annotations

import dataclasses

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..sources import filterbank
from . import ledger, rfi
from .rangejoin import small
from .search import searched

#: What the results of a block depend on, besides the scan.
SEARCH = ("max_drift_rate_hz_s", "max_drift_ch_per_step", "bandpass_block", "remove_dc_spike", "fine_channels_per_coarse", "snr_threshold", "max_hits_per_unit")
KEPT = "key string, location string, unit_id string, channel long, frequency_mhz double, drift_rate_hz_s double, snr double"


def blocks(hits: DataFrame, scans: DataFrame, mjd: float, width: int, tol_hz: float = 20.0, slope_s: float = 60.0) -> DataFrame:
    """(location, block): blocks of `width` channels in which hits(frequency_mhz, drift_rate_hz_s), seen at mjd, are to be
    looked for in scans(location, mjd, fch1, foff, nchans)."""
    s = scans.select("location", ((F.col("mjd") - mjd) * 86400).alias("dt"), "fch1", "foff", "nchans").where("foff <> 0")
    x = hits.select("frequency_mhz", "drift_rate_hz_s").join(small(s))  # a handful of scans
    at = F.col("frequency_mhz") + F.col("drift_rate_hz_s") * F.col("dt") / 1e6
    tol = (F.lit(tol_hz) + F.abs("drift_rate_hz_s") * slope_s) / 1e6
    a, b = (at - tol - F.col("fch1")) / F.col("foff"), (at + tol - F.col("fch1")) / F.col("foff")
    x = x.withColumns({"lo": F.floor(F.least(a, b)), "hi": F.ceil(F.greatest(a, b))}).where("hi >= 0 AND lo < nchans")
    asked = F.sequence(F.floor(F.greatest("lo", F.lit(0)) / width), F.floor(F.least("hi", F.col("nchans") - 1) / width))
    return x.select("location", F.explode(asked).alias("block")).distinct()


def hits_of(asked: DataFrame, cfg: SearchConfig, width: int, cache: str) -> DataFrame:
    """Hits in the asked blocks, as KEPT; blocks that the cache lacks are read, searched and added to it. Blocks that can't
    be read aren't kept, so they are tried again."""
    spark = asked.sparkSession
    version = ledger.results_version({k: getattr(cfg, k) for k in SEARCH} | {"width": width}, "1")
    asked = asked.withColumn("version", F.lit(version)).withColumn("key", ledger.cache_key(["location", "block", "version"]))
    try:
        old = spark.read.schema(KEPT).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], KEPT)
    todo = ledger.misses(asked, old)
    units = filterbank.read_blocks(todo.select("location", "block"), width, cfg.max_drift_rate_hz_s, cfg.max_drift_ch_per_step)
    found = searched(units, dataclasses.replace(cfg, spike_threshold=float("inf"), pulse_threshold=float("inf"))).where("error IS NULL")
    block = F.floor(F.regexp_extract("unit_id", ":([0-9]+)-[0-9]+$", 1).cast("long") / width)
    new = found.withColumns({"block": block, "version": F.lit(version)}).withColumn("key", ledger.cache_key(["location", "block", "version"]))
    new.select("key", "location", "unit_id", "channel", "frequency_mhz", "drift_rate_hz_s", "snr").write.mode("append").parquet(cache)
    now = spark.read.schema(KEPT).parquet(cache)
    return now.join(asked.select("key"), "key", "left_semi").where("channel IS NOT NULL")


def tested(found: DataFrame, scans: DataFrame, reference: str, cfg: SearchConfig, cache: str, width: int = 1 << 14) -> DataFrame:
    """found(hit_id, frequency_mhz, drift_rate_hz_s, snr, interest), hits of the scan at the location `reference`, with
    cadence: passed where the hit comes again in every ON scan and in no OFF scan, else failed; not_run where the scans
    (name, location, mjd, is_on, fch1, foff, nchans) don't suffice, or the reference is no ON scan."""
    spark = found.sparkSession
    whole = scans.withColumn("all", F.lit(1))
    fit = rfi.testable(whole, ("all",)).first()
    mine = scans.where((F.col("location") == reference) & F.col("is_on")).select("name", "mjd").first()
    if mine is None or fit is None or not fit["testable"]:
        return rfi.apply_cadence(found, None, "not_run")
    others = scans.where(F.col("location") != reference)
    near = hits_of(blocks(found, others, mine["mjd"], width), cfg, width, cache)
    near = near.join(F.broadcast(scans.select("location", "name")), "location").select(F.xxhash64("location", "channel").alias("hit_id"), "name", "frequency_mhz", "drift_rate_hz_s", "snr")
    both = found.select("hit_id", F.lit(mine["name"]).alias("name"), "frequency_mhz", "drift_rate_hz_s", "snr").unionByName(near)
    events = rfi.cadence_events(scans.select("name", "mjd", "is_on"), both, reference=mine["name"])
    passed = events.select("hit_id").distinct().withColumn("_passed", F.lit(True))
    out = found.join(passed, "hit_id", "left").withColumn("cadence", F.when(F.coalesce("_passed", F.lit(False)), "passed").otherwise("failed")).drop("_passed")
    return out.withColumn("interest", F.when(F.col("cadence") == "failed", rfi.half_even(F.col("interest") * 0.2, 1)).otherwise(F.col("interest"))).select(*found.columns, "cadence")


def scan_table(spark, scans: dict[str, bool]) -> DataFrame:
    """scans as tested asks for them, of files and whether each is ON."""
    rows = []
    for location, is_on in scans.items():
        h = filterbank.read_header(location)
        rows.append((location, location, h.tstart, is_on, h.fch1, h.foff, h.nchans))
    return spark.createDataFrame(rows, "name string, location string, mjd double, is_on boolean, fch1 double, foff double, nchans long")
