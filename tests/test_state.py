"""Keyed state over growing input, and the search as a table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.functions import tables
from skydrift.operators.dedoppler import nms_window
from skydrift.operators.kernel import peaks, search
from skydrift.streaming import state

VISIT = "obs string, seq long, stop long, nchans long, errors int, version string, interest double"


def fold(rows):
    out = {}
    for obs, seq, stop, nchans, errors, version, interest in rows:
        o = out.setdefault(obs, dict(visits=0, reach=0, nchans=0, failures=0, version=None, found=[]))
        o["visits"] += 1
        o["nchans"] = max(o["nchans"], nchans or 0)
        if errors:
            o["failures"] += 1
        else:
            o["reach"] = max(o["reach"], stop or 0)
        o["version"] = max(filter(None, (o["version"], version)), default=None)
        if interest is not None and not errors:
            o["found"].append((version, interest, seq))
    got = set()
    for obs, o in out.items():
        best = min(((-i, s) for v, i, s in o["found"] if v == o["version"]), default=(None, None))
        got.add((obs, o["visits"], o["reach"], o["nchans"], o["failures"], bool(o["nchans"] and o["reach"] >= o["nchans"]), o["failures"] >= 3, o["version"], None if best[0] is None else -best[0], best[1]))
    return got


def test_two_runs_over_growing_input(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"o{i % 13}", i, int(rng.integers(0, 1000)), 900, int(rng.random() < 0.2), f"v{1 + i // 150}", float(rng.integers(0, 20)) if rng.random() < 0.7 else None) for i in range(400)]
    rows += [("odd", 900, None, None, None, None, None), ("odd", 901, None, 5, 1, "v1", 3.0)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda part: spark.createDataFrame(part, VISIT).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(VISIT).parquet(src)
    add(rows[:170])
    state.keep(stream(), out)
    assert {tuple(r) for r in state.ledger(spark, out).collect()} == fold(rows[:170])
    add(rows[170:])
    state.keep(stream(), out)
    assert {tuple(r) for r in state.ledger(spark, out).collect()} == fold(rows)
    before = {tuple(r) for r in state.ledger(spark, out).collect()}
    state.keep(stream(), out)  # nothing new
    assert {tuple(r) for r in state.ledger(spark, out).collect()} == before
    assert "HDFS" in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "HDFS")  # as it was


def test_an_older_version_comes_late(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1, 10, 10, 0, "v2", 5.0)], [("a", 2, 10, 10, 0, "v1", 99.0)], [("a", 3, 10, 10, 0, "v2", 5.0), ("a", 4, 10, 10, 0, "v3", None)]):
        spark.createDataFrame(part, VISIT).coalesce(1).write.mode("append").parquet(src)
        state.keep(spark.readStream.schema(VISIT).parquet(src), out)
        got = state.ledger(spark, out).first()
        assert (got["version"], got["interest"], got["seq"]) == (("v2", 5.0, 1) if part[0][1] < 3 else ("v3", None, None))


def test_table_function(spark):
    tables.register(spark)
    rng = np.random.default_rng(3)
    z = rng.normal(size=(3, 16, 120))
    z[1, np.arange(16), 40 + np.arange(16)] += 4
    rows = [(o, t, c, None if (o, t, c) == (0, 3, 5) else float(v)) for (o, t, c), v in np.ndenumerate(z) if (o, t, c) != (2, 15, 7)] + [(None, 1, 1, 5.0), (0, None, 1, 9.0)]
    z[0, 3, 5] = z[2, 15, 7] = 0
    x = spark.createDataFrame(rows, "obs long, t int, c int, z double").withColumn("extra", F.lit("clash"))
    got = {(r["obs"], r["channel"], round(r["drift"], 9), round(r["snr"], 9)) for r in spark.sql("SELECT * FROM dedoppler_hits(samples => TABLE(SELECT * FROM {x}) PARTITION BY obs, k_max => 1, threshold => 2.5)", x=x).collect()}
    want = set()
    for o in range(3):
        snr, drift = search(z[o], 1)
        want |= {(o, int(c), round(float(drift[c]), 9), round(float(snr[c]), 9)) for c in peaks(snr, nms_window(16, 120, 1), 2.5)}
    assert got == want and any(o == 1 and abs(c - 40) < 2 for o, c, *_ in got)
    assert spark.sql("SELECT * FROM dedoppler_hits(samples => TABLE(SELECT * FROM {x}) PARTITION BY obs, k_max => 1, threshold => 2.5)", x=x.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [1e9])
def test_table_function_without_hits(spark, threshold):
    tables.register(spark)
    x = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, 1.0)], "obs long, t int, c int, z double")
    assert spark.sql("SELECT * FROM dedoppler_hits(k_max => 0, threshold => {t}, samples => TABLE(SELECT * FROM {x}) PARTITION BY obs)", x=x, t=threshold).count() == 0


def test_table_function_over_a_join_has_an_exchange_of_its_own(spark, tmp_path):
    from skydrift.plans import registry

    rng = np.random.default_rng(4)
    for k in range(4):  # each file ends amid an observation
        rows = [(v, rng.normal(size=64).tolist()) for v in range(k * 88, (k + 1) * 88)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of large tables, whose join deals by obs
    try:
        found = registry.queries()["table_function_hits"](spark, str(tmp_path))
        got = sorted((r["obs"], r["channel"], r["drift"], r["snr"]) for r in found.collect())
        want = sorted((int(r["unit_id"]), r["channel"], r["drift"], r["snr"]) for r in registry.queries()["kernel_hits"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and got
    # the join's exchange may be read by the tasks that wrote it; this kind is never
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()


def test_the_fold_runs_no_python_for_a_key(spark):
    rows = [(f"o{i % 40}", i, i * 7 % 1000, 900, int(i % 5 == 0), f"v{1 + i // 150}", float(i * 13 % 20) if i % 3 else float("nan")) for i in range(400)]
    found = state.folded(spark.createDataFrame([*rows, (None, 900, 1, 1, 0, "v1", 1.0)], VISIT).where("obs IS NOT NULL"))
    assert {tuple(r) for r in found.collect()} == fold([(*r[:-1], None if r[-1] != r[-1] else r[-1]) for r in rows])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
