"""Mirror images found by the strongest partner are those that all pairs give."""

import math

import numpy as np
import pytest

from skydrift.operators import mirror, rfi

SCHEMA = "hit_id long, file string, channel long, mirror_channel long, drift double, snr double"


def le(a, b):
    """As Spark compares doubles: NaN equals itself and is the largest."""
    return math.isnan(b) or a <= b


def plain(rows, tol=3, ratio=2.0):
    pair, image = set(), set()
    for i, f, _, m, d, s in rows:
        for j, g, c, _, e, z in rows:
            if None in (i, j, f, g, m, c, d, e) or m < 0 or f != g or i == j or abs(c - m) > tol or not le(abs(d + e), max(0.25, abs(d) * 0.1) if not math.isnan(d) else d):
                continue
            pair |= {i, j}
            known = [x for x in (s, z) if x is not None]
            if not known:
                continue
            high, low = (max(known), min(known)) if not any(map(math.isnan, known)) else (math.nan, min((x for x in known if not math.isnan(x)), default=math.nan))
            alike = not le(low * ratio, high)
            if None in (s, z):
                image |= {i, j} if alike else set()
                continue
            weak = not le(s, z) or (le(s, z) and le(z, s) and j < i)  # j is the weaker one
            image |= ({i} if alike or not weak else set()) | ({j} if alike or weak else set())
    return {(r[0], r[0] in pair, r[0] in image) for r in rows}


def hits(seed, n, odd, channels=1200):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = int(rng.integers(-20, channels))
        d, s = float(rng.integers(-40, 41)) / float(rng.choice([1, 10, 40])), float(rng.integers(-3, 60)) / 2
        row = [k, f"F{rng.integers(0, 3)}", c, int(2 * (c // 100 * 100 + 50) - c), d, s]
        if odd and k % 5 == 0:
            row[2 + int(rng.integers(0, 4))] = None
        if odd and k % 7 == 0:
            row[4 + int(rng.integers(0, 2))] = float(rng.choice([math.nan, math.inf, -math.inf, 0.0, -0.0]))
        if odd and k % 31 == 0:
            row[1] = None
        rows.append(tuple(row))
    return rows


@pytest.mark.parametrize(("seed", "n", "odd", "tol", "channels"), [(1, 900, False, 3, 1200), (2, 900, True, 3, 1200), (3, 900, True, 0, 200), (4, 600, False, 12, 600), (5, 60, True, 3, 130)])
def test_as_all_pairs(spark, seed, n, odd, tol, channels):
    rows = hits(seed, n, odd, channels)
    want = plain(rows, tol)
    assert {p for _, p, _ in want} == {q for _, _, q in want} == {False, True}
    got = rfi.mirror_pairs(spark.createDataFrame(rows, SCHEMA), tol)
    assert {(r["hit_id"], r["mirror_pair"], r["mirror_image"]) for r in got.collect()} == want


def test_equal_ids_and_no_rows(spark):
    rows = [(1, "a", 50, 50, 0.0, 9.0), (1, "a", 50, 50, 0.0, 20.0), (2, "b", 50, 50, 0.0, 9.0), (3, "b", 50, 50, 0.1, 30.0), (3, "b", 51, 49, 0.1, 8.0)]
    got = rfi.mirror_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["hit_id"], r["mirror_pair"], r["mirror_image"]) for r in got} == plain(rows)
    assert rfi.mirror_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hits_of_one_channel_make_no_pairs(spark):
    """A hundred thousand hits on one channel would be ten thousand million pairs."""
    n = 100_000
    df = spark.range(n).selectExpr("id AS hit_id", "'a' AS file", "50L AS channel", "50L AS mirror_channel", "(id % 1000) / 1000D AS drift", "1 + id / 10D AS snr")
    got = rfi.mirror_pairs(df)
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("mirror_pair").count() == got.where("drift <= 0.25").count() == 251 * n // 1000
    top = max(k for k in range(n) if k % 1000 == 0)  # meets the others with a drift of 0 to 0.25
    assert got.where(f"hit_id = {top}").first()["mirror_image"]


def test_best_of_another_id():
    rng = np.random.default_rng(6)
    ranks, ids = rng.permutation(300), rng.integers(0, 20, 300)
    best = mirror.Best(ranks, ids)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(0, 90, 500))
    own = rng.integers(0, 20, 500)
    want = [max((r for r in ranks[a:z] if ids[r] != o), default=-1) for a, z, o in zip(lo, hi, own)]
    assert best.of(lo, hi, own).tolist() == want
