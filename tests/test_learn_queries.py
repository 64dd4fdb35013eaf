"""Tones planted in what was observed: recovery and training rows."""

import numpy as np
import pytest

from skydrift import cli
from skydrift.config import SearchConfig
from skydrift.operators import learn, rollup
from skydrift.sources import filterbank as fb


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(8)
    rows = [(o, t, c, float(v)) for o in range(12) for (t, c), v in np.ndenumerate(rng.normal(size=(16, 200)))]
    return spark.createDataFrame(rows, "obs long, t int, c int, z double").cache()


def test_where_tones_are_planted(spark, noise):
    x, t = learn.planted(noise, 16, 200, (5.0,), (0.0, 2.0))
    trials = {r["obs"]: r for r in t.collect()}
    assert len(trials) == 36 and {r["cell"] for r in trials.values()} == {0, 1, 2}
    was = {(r["obs"], r["t"], r["c"]): r["z"] for r in noise.collect()}
    added = {}
    for r in x.collect():
        more = r["z"] - was[(trials[r["obs"]]["source"], r["t"], r["c"])]
        if more:
            added.setdefault(r["obs"], {})[r["t"]] = (r["c"], more)
    assert set(added) == {k for k, r in trials.items() if r["cell"]}
    for k, rows in added.items():
        start, drift = trials[k]["start"], trials[k]["tone_drift"]
        assert {s: c for s, (c, _) in rows.items()} == {s: start + round(drift * s) for s in range(16)} and 4 <= start and start + drift * 15 < 196
        assert len({round(v, 9) for _, v in rows.values()}) == 1


def test_strong_tones_come_back_and_weak_ones_do_not(noise):
    got = {(r["snr"], r["drift"]): (r["rate"], r["n"]) for r in rollup.recovery(learn.recovery_trials(noise, 16, 200, 3, 8.0, (1.0, 40.0), (0.0, 0.5, 2.0))).collect()}
    assert {n for _, n in got.values()} == {12}
    assert all(got[(40.0, d)][0] > 0.9 and got[(1.0, d)][0] < 0.2 for d in (0.0, 0.5, 2.0))


def test_training_rows_teach_a_classifier(spark, noise):
    rows = learn.examples(noise, 16, 200, 3, 3.0, (20.0, 40.0), (0.0, 1.5, 2.5)).drop("hit_id").cache()
    assert rows.schema.simpleString() == spark.createDataFrame([], learn.EXAMPLE).schema.simpleString()
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert set(n) == {"noise", "rfi_zero_drift", "technosignature_like"} and n["technosignature_like"] > 40 and n["rfi_zero_drift"] > 20
    model, _, right = learn.train(rows, trees=20)
    assert right > 0.9 and model.snr_max == rows.agg({"snr": "max"}).first()[0]
    held = {}
    for label, _, recall, k in model.recall:
        held[label] = held.get(label, 0) + k
        assert 0 <= recall <= 1
    assert held == {label: k // 4 for label, k in n.items()}  # every fourth row of each label
    rows.unpersist()


def test_commands_on_a_file(spark, tmp_path):
    z = np.random.default_rng(1).normal(10, 1, (16, 2048)).astype(np.float32)
    fb.write_file(str(tmp_path / "n.fil"), z, fb.Header(fch1=1420.0, foff=-2.7939677238464355e-06, tsamp=18.253611008, source_name="N"))
    asked = cli.planted_in(spark, str(tmp_path / "n.fil"), SearchConfig(channels_per_unit=500), (40.0,), (0.0, 2.0))
    assert asked["n_f"] == 500 and asked["samples"].select("obs").distinct().count() == 4
    assert [r["rate"] for r in rollup.recovery(learn.recovery_trials(**asked)).collect()] == [1.0, 1.0]
