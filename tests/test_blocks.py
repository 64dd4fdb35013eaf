import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.operators import blocks, dedoppler, detect, normalize
from skydrift.operators.blocks import own, with_halo


def waterfall(spark, z, obs=1):
    rows = [(obs, t, c, float(v)) for (t, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "obs int, t int, c int, z double")


def plain_peaks(values, window, threshold):
    return {c for c, v in values.items() if v >= threshold and v == max(x for k, x in values.items() if abs(k - c) <= window)}


@pytest.mark.parametrize("window", [1, 4, 50, 700])
def test_peaks_of_one_long_observation(spark, window):
    """A hundred blocks and more of one observation, with ties, gaps and both ends."""
    rng = np.random.default_rng(window)
    v = np.round(rng.normal(0, 1, 3000) * 2) / 2
    values = {int(c): float(v[c]) for c in range(3000) if not 900 < c < 1200 and c % 17}
    df = spark.createDataFrame([(7, c, x, 0.5) for c, x in values.items()], "obs int, c int, snr double, drift double")
    got = dedoppler.peaks(df, window, 0.5)
    assert got.columns == df.columns
    assert {r["c"] for r in got.collect()} == plain_peaks(values, window, 0.5)
    parts = df.select(F.floor(F.col("c") / (2 * window + 1)).alias("b")).distinct().count()
    assert parts >= (3000 - 300) // (2 * window + 1)


def test_peaks_do_not_see_other_observations(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (2, 5, 9.0), (1, 6, 1.0)], "obs int, c int, snr double")
    assert sorted((r["obs"], r["c"]) for r in dedoppler.peaks(df, 3, 0.0).collect()) == [(1, 5), (2, 5)]
    assert dedoppler.peaks(df.limit(0), 3, 0.0).count() == 0


def test_halos_hold_all_neighbours(spark):
    df = spark.range(100).select(F.col("id").alias("c"))
    seen = {}
    for r in with_halo(df, F.col("c"), 10, 3, 2).collect():
        seen.setdefault(r["_block"], []).append(r["c"])
    for b in range(10):
        assert sorted(seen[b]) == list(range(max(0, 10 * b - 3), min(100, 10 * b + 12)))
    assert own(with_halo(df, F.col("c"), 10, 3, 2)).count() == 100


@pytest.mark.parametrize("nfine, width", [(1, 4), (2, 3), (8, 4096), (8, 5)])
def test_centre_channels_across_blocks(spark, nfine, width):
    z = np.random.default_rng(3).normal(size=(2, 37))
    got = {(r["t"], r["c"]): r["z"] for r in normalize.repair_dc(waterfall(spark, z), nfine, width=width).collect()}
    assert len(got) == z.size
    for (t, c), v in np.ndenumerate(z):
        if c % nfine == nfine // 2:
            v = ((z[t, c - 1] if c else v) + (z[t, c + 1] if c < 36 else v)) * 0.5
        assert got[(t, c)] == pytest.approx(v)


@pytest.mark.parametrize("n_t, n_f, k_max, width", [(16, 40, 2, None), (64, 50, 0, None), (64, 30, 1, 7), (5, 33, 1, 8), (1, 9, 0, None), (16, 64, 3, 16)])
def test_tree_gives_the_sums_of_all_paths(spark, n_t, n_f, k_max, width):
    z = np.random.default_rng(n_t).integers(0, 1000, size=(n_t, n_f)).astype(float)
    x = waterfall(spark, z)
    for k_limit in (None, 0.6, 1e-3):
        want = {(r["start"], r["sign"], r["k"], r["d"]): r["power"] for r in dedoppler.path_sums(x, dedoppler.paths(spark, n_t, k_max, k_limit), n_f).collect()}
        rows = dedoppler.tree_sums(x, n_t, n_f, k_max, k_limit, width=width).collect()
        got = {(r["start"], r["sign"], r["k"], r["d"]): r["power"] for r in rows}
        assert got == want and len(rows) == len(got)


def test_tree_has_one_exchange_and_shares_sums(spark):
    z = np.random.default_rng(0).normal(size=(64, 300))
    x = waterfall(spark, z).cache()
    best = dedoppler.best_paths(dedoppler.tree_sums(x, 64, 300, 0), 64)
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1, plan
    sums = dedoppler.tree_sums(x, 64, 300, 0)
    assert sums.count() < 2 * 64 * 300  # two signs, one row a drift and channel
    x.unpersist()


def test_boxes_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(detect, "SERIES_BLOCK", 10)
    v = np.random.default_rng(4).normal(size=95)
    v[47:51] += 9
    series = spark.createDataFrame([(0, 0, 0.0, t, float(x)) for t, x in enumerate(v)], "obs int, i int, dm double, t int, v double")
    for r in detect.boxcars(series, 95).collect():
        box = np.convolve(v, np.ones(r["w"]), "valid") / np.sqrt(r["w"])
        dev = np.abs(box - np.median(box))
        snr = (box - np.median(box)) / (1.4826 * np.median(dev))
        assert r["t"] == int(np.round(snr, 9).argmax()) and r["snr"] == pytest.approx(snr.max())


def test_robust_z_passes_over_nan(spark):
    z = np.random.default_rng(6).normal(size=(9, 200))
    z[:, 50] += 40
    z[3, 50] = np.nan
    z[:, 60] = np.nan
    found = detect.robust_z(waterfall(spark, z)).collect()
    assert {r["c"] for r in found} >= {50} and not any(r["c"] == 60 or np.isnan(r["robust_z"]) for r in found)
    assert blocks.own is own


def test_units_meet_their_own_samples_only(spark):
    from skydrift.operators import axis

    x = spark.range(200).select(F.lit(1).alias("obs"), F.lit(0).alias("t"), F.col("id").alias("c"), F.col("id").cast("double").alias("z"))
    units = spark.createDataFrame([(1, f"u{a}", max(0, a - 7), min(200, a + 30 + 7), a, a + 30) for a in range(0, 200, 30)] + [(1, "none", 5, 5, 5, 5), (2, "other", 0, 9, 0, 9)], "obs int, unit_id string, chan_start long, chan_stop long, core_start long, core_stop long")
    got = axis.samples_of_units(x, units, block=16).collect()
    assert len(got) == len({(r["unit_id"], r["c"]) for r in got}) == sum(min(200, a + 37) - max(0, a - 7) for a in range(0, 200, 30))
    assert all(r["z"] == r["c"] + r["chan_start"] for r in got)
    plan = axis.samples_of_units(x, units, block=16)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_block" in plan


def test_spikes_on_tracks_of_any_width(spark):
    rng = np.random.default_rng(2)
    spikes = [(1, int(t), int(c), 9.0) for t, c in zip(rng.integers(0, 16, 300), rng.integers(0, 400, 300))]
    tracks = [(1, 50, 2.5, 0.0), (1, 300, -7.25, 1.0), (1, 200, 0.0, 25.0), (2, 100, 0.0, 500.0), (1, 399, 3.0, None)]
    found = spark.createDataFrame(spikes, "obs int, t int, c int, power_sigma double")
    hits = spark.createDataFrame(tracks, "obs int, channel long, drift double, bandwidth_ch double")
    got = sorted((r["t"], r["c"]) for r in detect.isolated(found, hits).collect())
    assert got == sorted((t, c) for _, t, c, _ in spikes if not any(o == 1 and abs(h + d * t - c) <= 3 + (w or 0) for o, h, d, w in tracks))


def test_strongest_spikes_before_the_core(spark):
    z = np.zeros((4, 100))
    z[0, :80] = 50 + np.arange(80)  # eighty stronger ones in the guard band
    z[1, 80:90] = 20 + np.arange(10)
    assert len(detect.spike_array(z, [], 9.0, 80, 100, first=85)) == 5 and len(detect.spike_array(z, [], 9.0, 80, 100)) == 10
    assert [r["channel"] for r in detect.spike_array(z, [], 9.0, 0, 100, most=2)] == [79, 78]


def test_parts_grow_with_samples(spark, monkeypatch):
    """A task of the drift search holds a part of the samples, not a share of them."""
    monkeypatch.setattr(dedoppler, "PART", 256)
    x = spark.range(16 * 16 * 64).select((F.col("id") / 1024).cast("int").alias("obs"), (F.col("id") % 16).cast("int").alias("t"), (F.col("id") / 16 % 64).cast("int").alias("c"), F.lit(1.0).alias("z"))
    sums = dedoppler.tree_sums(x, 16, 64, 3)
    assert sums.rdd.getNumPartitions() == dedoppler.path_sums(x, dedoppler.paths(spark, 16, 3), 64).rdd.getNumPartitions() == 64
    assert {r[0] for r in sums.select("_block").distinct().collect()} == {0}
    assert sums.where("k = 0 AND d = 0").agg(F.sum("power")).first()[0] == 16 * 16 * 64
