"""Noise of all columns: no threshold of these queries comes from every third one."""

import numpy as np
import pytest

from skydrift.operators import dedoppler, kernel
from skydrift.plans import registry
from skydrift.plans.signal import K_MAX


def quiet_thirds():
    """An observation whose every third column hardly differs, while the others do."""
    rng = np.random.default_rng(8)
    z = rng.normal(0, 0.3, (16, 64)) + rng.normal(0, 1.0, 64) * (np.arange(64) % 3 > 0)
    z[:, ::3] = rng.normal(0, 0.01, (16, 22))
    z[:, 40] += 6.0
    return z.astype(np.float32)


def noise(z, every):
    col = z.astype(float).sum(0)[::every]
    med = np.median(col)
    return med, 1.4826 * np.median(np.abs(col - med))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("quiet")
    rows = [(i, x.tolist()) for i, x in enumerate(quiet_thirds())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_all_columns_or_every_third(spark):
    z = quiet_thirds()
    rows = [(1, t, c, float(z[t, c])) for t in range(16) for c in range(64)]
    df = spark.createDataFrame(rows, "obs long, t int, c int, z double")
    for every in (1, 3):
        r = dedoppler.column_noise(df, 16, every=every).first()
        assert (r["med"], r["scale"]) == pytest.approx(noise(z, every))


@pytest.mark.parametrize("name", ["dedoppler_hits", "nms_peaks", "feature_vectors"])
def test_snr_by_the_noise_of_all_columns(spark, folder, name):
    z = quiet_thirds()
    snr, _ = kernel.search(z.astype(float), K_MAX)  # by every third column
    (m3, s3), (m, s) = noise(z, 3), noise(z, 1)
    want = ((snr * s3 + m3) - m) / s
    df = registry.queries()[name](spark, folder)
    got = {r["hit_id"] % 1000: r["v"] for r in df.where("place = 0").collect()} if name == "feature_vectors" else {r["c"]: r["snr"] for r in df.collect()}
    assert got and all(v == pytest.approx(want[c], abs=1e-5) for c, v in got.items())
    assert 40 in got and got[40] != pytest.approx(snr[40], rel=0.1)
