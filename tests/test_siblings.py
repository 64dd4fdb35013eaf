"""Hits looked for in the other scans of a cadence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift import cli
from skydrift.config import SearchConfig
from skydrift.operators import siblings
from skydrift.sources import filterbank as fb

FOFF, TSAMP, N_F, WIDTH = -2.7939677238464355e-06, 18.253611008, 1 << 15, 1 << 11
STEP = 300 / TSAMP  # time steps between scans of five minutes


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Six scans. One tone drifts through the ON scans, one is everywhere, one is in the first scan only."""
    at = tmp_path_factory.mktemp("cadence")
    t = np.arange(16)
    for k in range(6):
        z = np.random.default_rng(k).normal(10, 1, (16, N_F)).astype(np.float32)
        add = lambda c, d: np.add.at(z, (t, np.rint(c + d * (t + k * STEP)).astype(int)), 8)  # noqa: E731, B023
        add(20_000, 1.5)
        if k % 2:
            z[t, np.rint(20_000 + 1.5 * (t + k * STEP)).astype(int)] -= 8
        add(6000, -1.0)
        if k == 0:
            add(12_000, 2.0)
        name = f"blc_guppi_58000_{10_000 + 300 * k}_{'STAR' if k % 2 == 0 else f'OFF{k}'}_000{k}.gpuspec.0000.fil"
        fb.write_file(str(at / name), z, fb.Header(fch1=1420.0, foff=FOFF, tsamp=TSAMP, tstart=58000 + (10_000 + 300 * k) / 86400, source_name="S"))
    return at


CFG = SearchConfig(channels_per_unit=N_F, use_ai=False, spike_threshold=1e9)


def test_blocks_that_hits_ask_for(spark):
    scans = spark.createDataFrame([("a", 58000.0, 1420.0, FOFF, 5000), ("b", 58000.01, 1420.0, FOFF, 5000), ("far", 58000.0, 900.0, FOFF, 5000)], "location string, mjd double, fch1 double, foff double, nchans long")
    rate = 1.0 * FOFF * 1e6 / TSAMP
    hits = spark.createDataFrame([(1420.0 + FOFF * 1000, rate), (1420.0 + FOFF * 1001, rate), (1420.0 - FOFF * 10_000, 0.0)], "frequency_mhz double, drift_rate_hz_s double")
    got = {(r["location"], r["block"]) for r in siblings.blocks(hits, scans, 58000.0, 100).collect()}
    moved = 864 / TSAMP
    assert ("a", 10) in got and ("b", int(1000 + moved) // 100) in got
    assert {x for x, _ in got} == {"a", "b"} and len(got) <= 5


def test_a_hit_passes_or_fails(spark, folder, tmp_path):
    scans = cli.siblings(spark, str(folder), "0000.fil")
    first = next(iter(scans))
    meta = cli.analyze(spark, first, str(tmp_path / "run"), CFG, scans=scans, cache=str(tmp_path / "cache"))
    assert meta["stats"]["errors"] == 0
    rows = spark.read.parquet(str(tmp_path / "run/candidates.parquet")).collect()
    got = {min((20_000, 6000, 12_000), key=lambda c: abs(c - r["channel"])): (r["cadence"], r["interest"]) for r in rows if r["snr"] > 20}
    assert {k: v[0] for k, v in got.items()} == {20_000: "passed", 6000: "failed", 12_000: "failed"}
    assert got[20_000][1] > 4 * got[6000][1] > 0


def test_only_asked_blocks_are_read_and_only_once(spark, folder, tmp_path, monkeypatch):
    scans = siblings.scan_table(spark, cli.siblings(spark, str(folder), "0000.fil"))
    places = [r["location"] for r in scans.orderBy("mjd").collect()]
    rate = 1.5 * FOFF * 1e6 / TSAMP
    found = spark.createDataFrame([(1, 1420.0 + FOFF * 20_000, rate, 30.0, 50.0)], "hit_id long, frequency_mhz double, drift_rate_hz_s double, snr double, interest double")
    cache = str(tmp_path / "cache")
    out = siblings.tested(found, scans, places[0], CFG, cache, WIDTH).collect()
    assert [(r["cadence"], r["interest"]) for r in out] == [("passed", 50.0)]
    kept = spark.read.parquet(cache)
    blocks = {(r["location"], r["unit_id"]) for r in kept.collect()}
    assert len(blocks) <= 5 * 2 and places[0] not in {x for x, _ in blocks} and len(blocks) < 5 * N_F // WIDTH / 4
    n = kept.count()
    again = siblings.tested(found, scans, places[0], CFG, cache, WIDTH).collect()
    assert again == out and spark.read.parquet(cache).count() == n  # nothing is searched again
    siblings.tested(found, scans, places[0], SearchConfig(snr_threshold=12.0, use_ai=False), cache, WIDTH).collect()
    assert spark.read.parquet(cache).count() > n  # other settings, other results


def test_scans_that_do_not_suffice(spark, folder, tmp_path):
    scans = siblings.scan_table(spark, cli.siblings(spark, str(folder), "0000.fil"))
    places = [r["location"] for r in scans.orderBy("mjd").collect()]
    found = spark.createDataFrame([(1, 1420.0, 0.1, 30.0, 50.0)], "hit_id long, frequency_mhz double, drift_rate_hz_s double, snr double, interest double")
    status = lambda s, ref: [r["cadence"] for r in siblings.tested(found, s, ref, CFG, str(tmp_path / "c"), WIDTH).collect()]
    assert status(scans.where(F.col("location") == places[0]), places[0]) == ["not_run"]
    assert status(scans, places[1]) == ["not_run"]  # an OFF scan
    assert status(scans.limit(0), places[0]) == ["not_run"]
    assert siblings.tested(found.limit(0), scans, places[0], CFG, str(tmp_path / "c"), WIDTH).count() == 0
