"""Joins of hits by channel make pairs of channels, however many hits lie on one."""

import math

import numpy as np
from pyspark.sql import functions as F

from skydrift.operators import rfi


def test_tones_meet_channels_and_not_hits(spark):
    rng = np.random.default_rng(2)
    hits = [(int(c), k + 1) for k, c in enumerate(rng.integers(0, 60, 400))] + [(None, 0)]
    tones = [(k, int(rng.integers(-30, 90)), float(rng.integers(-10, 11)) / 10) for k in range(120)] + [(900, None, 0.5), (3, 20, -0.0), (901, 20, 0.0)]
    injected = spark.createDataFrame(tones, "tone_id long, start_channel long, true_drift double")
    found = rfi.truth_join(injected, spark.createDataFrame(hits, "channel long, rank long"), 16)
    reach = lambda c, d: [r for h, r in hits if h is not None and c is not None and abs(h - c) <= abs(d * 16) + 4]
    best = {}
    for k, c, d in tones:
        best[k] = min([*reach(c, d), *([best[k]] if best.get(k) else [])], default=None)
    assert {(r["tone_id"], r["best_rank"]) for r in found.collect()} == set(best.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(rank" in plan[plan.rindex("Join Inner") :]


def test_equal_frequencies_ask_once(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"T{k % 4}", 1000 + float(rng.integers(0, 300)) / 1000, 50.0) for k in range(300)] + [(900, None, 1000.1, 50.0), (901, "T1", None, 50.0)]
    hits = spark.createDataFrame(rows, "hit_id long, target string, frequency_mhz double, interest double")
    found = rfi.multi_target(hits, hits.select("target", "frequency_mhz"))
    assert found.columns == [*hits.columns[:3], "interest", "multi_target"]
    def other(t, f):
        near = lambda w: sum(s is not None and t is not None and s != t and g is not None and f is not None and f - w <= g <= f + w for _, s, g, _ in rows)
        return near(0.002) > 0 or near(0.025) >= 2
    assert {(r["hit_id"], r["multi_target"]) for r in found.collect()} == {(k, other(t, f)) for k, t, f, _ in rows}
    more = hits.union(hits.withColumn("hit_id", F.col("hit_id") + 1000))
    assert rfi.multi_target(more, hits.select("target", "frequency_mhz")).where("multi_target").count() == 2 * found.where("multi_target").count()


def test_frequencies_make_no_pairs(spark):
    """Dense and sparse stretches, on both sides of blocks' and bins' edges, with and without hits that are settled early."""
    rng = np.random.default_rng(4)
    f = np.concatenate([1000 + rng.integers(0, 4000, 700) / 1e3, 2000 + rng.random(900) / 50, [0.0, -0.0, math.nan, math.inf, -5.0, 1000.0]])
    rows = [(k, f"T{k % 5 if k % 3 else 0}", float(x), 50.0) for k, x in enumerate(f)] + [(9000, "T1", math.nan, 50.0), (9001, "T2", 0.0, 50.0)]
    hits = spark.createDataFrame(rows, "hit_id long, target string, frequency_mhz double, interest double")
    like = lambda a, b: a <= b or math.isnan(b)
    for tol, band, least in ((2.0, 25.0, 2), (0.5, 3.0, 3), (0.0, 1.0, 1), (5.0, 1.0, 2)):
        found = rfi.multi_target(hits, hits.select("target", "frequency_mhz"), tol, band, least)
        def other(t, x):
            near = [g for _, s, g, _ in rows if s != t and like(x - band / 1e3, g) and like(g, x + band / 1e3)]
            return any(like(x - tol / 1e3, g) and like(g, x + tol / 1e3) for g in near) or len(near) >= least
        assert {(r["hit_id"], r["multi_target"]) for r in found.collect()} == {(k, other(t, x)) for k, t, x, _ in rows}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in plan and "Join LeftOuter" in plan
        same = rfi.multi_target(hits, seen := hits.select("target", "frequency_mhz"), tol, band, least, seen)
        marks = lambda df: sorted((r["hit_id"], r["multi_target"]) for r in df.collect())
        assert marks(same) == marks(found)
