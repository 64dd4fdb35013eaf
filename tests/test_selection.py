import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.operators import selection


def exact(df, at, keys):
    return df.groupBy(*keys).agg(*[F.percentile("z", F.lit(q)).alias(n) for n, q in at.items()])


def same(a, b):
    x, y = [sorted(map(tuple, d.collect()), key=repr) for d in (a, b)]
    assert len(x) == len(y)
    for r, s in zip(x, y):
        assert r == pytest.approx(s, nan_ok=True) if None not in r else r == s


AT = {"q0": 0.0, "q1": 0.013, "med": 0.5, "q95": 0.95, "q100": 1.0}


def test_small_groups_as_percentile_has_them(spark):
    rows = [(g, float((g * 31 + i * i * 7) % 23) - 5.5) for g in range(1, 30) for i in range(g)] + [(99, None), (None, 1.0), (None, 4.0), (100, float("nan")), (100, 1.0), (100, 2.0)]
    df = spark.createDataFrame(rows, "obs long, z double")
    same(selection.quantiles(df, "z", AT), exact(df, AT, ["obs"]))
    same(selection.quantiles(df.limit(0), "z", AT), exact(df, AT, ["obs"]).limit(0))
    same(selection.quantiles(df, "z", AT, ()), exact(df, AT, []))


@pytest.mark.parametrize("kind", ["distinct", "ties", "tail", "constant"])
def test_one_large_group(spark, kind):
    n = 300_000
    u = F.rand(7)
    z = {"distinct": F.col("id") * 1.0, "ties": F.floor(u * 4) * 1.0, "tail": F.exp(u * 600 - 300), "constant": F.lit(2.5)}[kind]
    df = spark.range(n).select((F.col("id") % 100 == 0).cast("int").alias("obs"), z.alias("z")).cache()
    same(selection.quantiles(df, "z", AT), exact(df, AT, ["obs"]))
    df.unpersist()


def test_slices_are_a_small_share(spark, monkeypatch):
    """What one task sorts is what lies between the bounds."""
    df = spark.range(200_000).select(F.lit(1).alias("obs"), ((F.col("id") * 7919) % 200_003).cast("double").alias("z"))
    got = selection.quantiles(df, "z", {"med": 0.5})
    assert got.first()["med"] == float(np.median((np.arange(200_000) * 7919) % 200_003))
    groups = df.groupBy("obs").agg(F.percentile_approx("z", [0.5 - 3e-4, 0.5 + 3e-4], selection.ACCURACY).alias("b")).first()["b"]
    assert df.where(F.col("z").between(*groups)).count() < 0.002 * 200_000


def test_a_sketch_that_misses_raises(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 10_000)
    monkeypatch.setattr(selection, "MARGIN", -50)
    df = spark.range(50_000).select(F.lit(1).alias("obs"), F.col("id").cast("double").alias("z"))
    with pytest.raises(Exception, match="sketch"):
        selection.medians(df, "z").collect()


def test_deviations(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(3, 2, 4001)
    df = spark.createDataFrame([(int(i % 3 == 0), float(x)) for i, x in enumerate(z)], "obs int, z double")
    got = {r["obs"]: (r["med"], r["mad"]) for r in selection.deviations(df, "z").collect()}
    for g in (0, 1):
        part = z[(np.arange(4001) % 3 == 0) == bool(g)]
        assert got[g] == pytest.approx((np.median(part), np.median(np.abs(part - np.median(part)))))
