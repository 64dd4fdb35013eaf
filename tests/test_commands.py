"""Commands end to end, on small files."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from skydrift import cli
from skydrift.config import SearchConfig
from skydrift.operators import detect, learn, report
from skydrift.operators.features import SCALARS
from skydrift.sources import filterbank as fb
from skydrift.streaming import crunch
from skydrift.streaming.crunch import visit


def write(path, n_t=16, n_f=4096, tones=(), seed=0, extra=None, target="T"):
    z = np.random.default_rng(seed).normal(10, 1, (n_t, n_f)).astype(np.float32)
    for c, drift, amp in tones:
        z[np.arange(n_t), np.rint(c + drift * np.arange(n_t)).astype(int)] += amp
    for t, c, amp in extra or ():
        z[t, c] += amp
    fb.write_file(str(path), z, fb.Header(fch1=1420.0, foff=-2.7939677238464355e-06, tsamp=18.253611008, tstart=59000.0, source_name=target))
    return str(path)


def burst(dm, n_t=256, n_f=512, at=40, amp=6.0):
    freqs = np.linspace(200, 100, n_f)
    z = np.random.default_rng(7).normal(0, 1, (n_t, n_f))
    lag = np.rint(detect.DISPERSION * dm * (freqs**-2 - freqs.max() ** -2)).astype(int)
    ok = at + lag < n_t
    z[(at + lag)[ok], np.flatnonzero(ok)] += amp
    return z, freqs


def test_pulses_of_a_unit():
    z, freqs = burst(40)
    best = detect.pulse_array(z, freqs, 1.0, 8.0, 1000.0, 64)[0]
    assert abs(best["dm"] - 40) <= 0.35 * 40 and 35 <= best["t"] <= 60 and not best["likely_rfi"]
    z, freqs = burst(0)
    assert detect.pulse_array(z, freqs, 1.0, 8.0, 1000.0, 64)[0]["likely_rfi"]
    assert detect.pulse_array(z[:31], freqs, 1.0, 0.0, 1000.0, 64) == []


def test_a_run_has_what_its_units_found(spark, tmp_path):
    f = write(tmp_path / "t.fil", n_t=40, tones=[(2000, 1.5, 6)], extra=[(7, 900, 60), (9, 2014, 50)])
    meta = cli.analyze(spark, f, str(tmp_path / "run"), SearchConfig(channels_per_unit=4096, use_ai=False))
    lone = spark.read.parquet(str(tmp_path / "run/spikes.parquet")).collect()
    assert [(r["t"], r["channel"]) for r in lone] == [(7, 900)]
    assert meta["stats"]["spikes"] == 1 and meta["stats"]["spikes_on_tones"] >= 1 and meta["stats"]["pulses"] == spark.read.parquet(str(tmp_path / "run/pulses.parquet")).count()
    assert set(meta["stats"]["stage_seconds"]) == set(report.STAGES) and "switched off" in meta["stats"]["ai_note"]
    assert spark.read.parquet(str(tmp_path / "run/snippets.parquet")).first()["img"][0] is not None


def test_too_large_units_and_narrow_windows(spark, tmp_path):
    f = write(tmp_path / "t.fil", n_t=16, n_f=128)
    with pytest.raises(ValueError, match="is not searched: a unit would be"):
        cli.analyze(spark, f, str(tmp_path / "no"), SearchConfig(max_download_mb=0))
    meta = cli.analyze(spark, f, str(tmp_path / "run"), SearchConfig(channels_per_unit=64))
    assert "drift_note" in meta["stats"] and meta["stats"]["drift_searched_hz_s"] < 4


def test_models_are_kept_and_judged(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(learn.LABELS[i % 7], 0.0, *[float(x) for x in rng.normal(i % 7, 0.2, len(SCALARS))], rng.normal(0, 1, 256).tolist()) for i in range(210)]
    model, labels, right = learn.train(spark.createDataFrame(rows, learn.EXAMPLE), trees=10)
    assert right > 0.8 and labels == learn.LABELS
    learn.save(model, str(tmp_path / "m"))
    again, why = learn.load(spark, str(tmp_path / "m"))
    assert why is None and again.numFeatures == 267
    f = write(tmp_path / "t.fil", tones=[(2000, 1.5, 6)])
    meta = cli.analyze(spark, f, str(tmp_path / "run"), SearchConfig(model_path=str(tmp_path / "m")))
    best = spark.read.parquet(str(tmp_path / "run/candidates.parquet")).orderBy("snr", ascending=False).first()
    assert "ai_note" not in meta["stats"] and best["ai_class"] in (*learn.LABELS, "out_of_distribution")
    assert sum(best[f"p_{x}"] for x in learn.LABELS) == pytest.approx(1)
    assert learn.load(spark, None)[1] and "can't be loaded" in learn.load(spark, str(tmp_path / "none"))[1]
    spark.createDataFrame([(["a"], list(SCALARS))], "labels array<string>, scalars array<string>").coalesce(1).write.mode("overwrite").json(str(tmp_path / "m/meta"))
    assert "other labels" in learn.load(spark, str(tmp_path / "m"))[1]


def test_visits_resume_and_give_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.fil", n_f=6000, tones=[(1000, 1.5, 6)], target="A")
    write(tmp_path / "in/b.fil", n_f=1500, tones=[(1000, 1.5, 6)], seed=1, target="B")
    (tmp_path / "in/bad.fil").write_bytes(b"\x05\x00\x00\x00hello")
    cfg = SearchConfig(channels_per_unit=1500)
    go = lambda: {r["obs"]: (r["start"], r["stop"], r["errors"]) for r in visit(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg, max_units=2).collect()}
    assert go() == {"a": (0, 3000, 0), "b": (0, 1500, 0), "bad": (0, 1, 1)}
    assert go() == {"a": (3000, 6000, 0), "bad": (0, 1, 1)}
    assert go() == {"bad": (0, 1, 1)}
    assert go() == {}  # all are done, or given up
    found = spark.read.parquet(str(tmp_path / "out/candidates"))
    assert found.where("multi_target").count() >= 1  # both targets have the tone


def test_summary_of_runs(spark, tmp_path):
    for k in range(2):
        f = write(tmp_path / f"t{k}.fil", tones=[(2000, 1.5 + k, 6 + 3 * k)], seed=k)
        cli.analyze(spark, f, str(tmp_path / f"runs/r{k}"), SearchConfig())
    table, notes, best = report.summary(spark, str(tmp_path / "runs"), str(tmp_path / "sum"))
    rows = {r["run"]: r for r in table.collect()}
    assert set(rows) == {"r0", "r1", "TOTAL (2 runs)"} and rows["TOTAL (2 runs)"]["hits"] == rows["r0"]["hits"] + rows["r1"]["hits"]
    assert notes["without_ai"] == 2 and best["run"] in ("r0", "r1") and "AI inactive" in rows["r0"]["flags"]
    assert spark.read.option("header", True).csv(str(tmp_path / "sum/summary.csv")).count() == 3
    assert "TOTAL" in spark.read.text(str(tmp_path / "sum/summary.html"), wholetext=True).first()[0]


def test_summary_of_runs_with_other_columns(spark, tmp_path):
    """Runs are read by one scan, whatever their number; what a run's table lacks is null for it alone."""
    for k in range(12):
        at = f"{tmp_path}/runs/r{k}"
        row = spark.range(k, k + 1).selectExpr("cast(id as string) AS hit_id", "1400.0 + id AS frequency_mhz", "0.1D AS drift_rate_hz_s", "10.0D + id AS snr", "cast(id AS double) AS interest", "'noise' AS ai_class")
        row = row.selectExpr("*", "true AS mirror_image") if k % 2 else row
        row.write.parquet(f"{at}/candidates.parquet")
        meta = {"title": at, "processed_utc": "2024-01-01T00:00:00", "config": {"max_drift_rate_hz_s": 4.0}, "stats": {"hits": 1, "channels": 5, "drift_searched_hz_s": 4.0}}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{at}/metadata.json")
    table, _, best = report.summary(spark, str(tmp_path / "runs"), str(tmp_path / "sum"))
    rows = {r["run"]: r for r in table.collect()}
    assert best["run"] == "r11" and rows["TOTAL (12 runs)"]["hits"] == 12
    assert all(rows[f"r{k}"]["best_mirror_image"] == bool(k % 2) and rows[f"r{k}"]["best_interest"] == k for k in range(12))


class Server(BaseHTTPRequestHandler):
    posted: list = []

    def do_POST(self):
        self.posted.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        self._say(b"{}")

    def do_GET(self):
        self._say(json.dumps({"data": [{"url": "http://x/a.fil"}]}).encode() if "query-files" in self.path else b"<results_ready_to_send>5</results_ready_to_send>")

    def _say(self, body):
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Server.posted.clear()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_status_of_servers(spark, server):
    lines = cli.status(spark, server, server + "/status")
    assert lines[1:] == ["archive: reachable", "volunteers: reachable, 5 results ready"]
    dead = cli.status(spark, "http://127.0.0.1:9", "http://127.0.0.1:9")
    assert "unreachable" in dead[1] and "unreachable" in dead[2]


def test_findings_go_to_a_webhook_once(spark, tmp_path, server):
    f = write(tmp_path / "t.fil", tones=[(2000, 1.5, 6)])
    cli.analyze(spark, f, str(tmp_path / "run"), SearchConfig())
    cfg = SearchConfig(share_min_interest=0.0, share_require_cadence=False, webhook_url=server)
    sent = cli.share_run(spark, str(tmp_path / "run"), str(tmp_path / "shared"), cfg, ("bundle", "webhook")).collect()
    assert {r["destination"] for r in sent} == {"bundle", "webhook"} and all(r["ok"] for r in sent)
    n = len(Server.posted)
    assert n == sum(r["destination"] == "webhook" for r in sent) and Server.posted[0]["finding_id"].startswith("AIS-")
    assert cli.share_run(spark, str(tmp_path / "run"), str(tmp_path / "shared"), cfg, ("bundle", "webhook")).count() == 0 and len(Server.posted) == n
    with pytest.raises(ValueError, match="settings"):
        cli.share_run(spark, str(tmp_path / "run"), str(tmp_path / "shared"), SearchConfig(), ("issues",))


def test_a_folder_tells_its_cadence(spark, tmp_path):
    step = 300 / 18.253611008  # time steps between scans of five minutes
    on = [True, False, True, False]
    for k, is_on in enumerate(on):
        name = f"blc1_guppi_58000_{10_000 + 300 * k}_{'STAR' if is_on else f'OTHER{k}'}_000{k}.gpuspec.0000.fil"
        z = np.random.default_rng(k).normal(10, 1, (16, 4096)).astype(np.float32)
        if is_on:
            z[np.arange(16), np.rint(2000 + k * step + np.arange(16)).astype(int)] += 8
        fb.write_file(str(tmp_path / name), z, fb.Header(fch1=1420.0, foff=-2.7939677238464355e-06, tsamp=18.253611008, tstart=58000 + (10_000 + 300 * k) / 86400, source_name="S"))
    found = cli.siblings(spark, str(tmp_path), "0000.fil")
    assert list(found.values()) == on
    events = cli.cadence(spark, list(found), str(tmp_path / "out"), SearchConfig(channels_per_unit=4096), found).collect()
    assert [(r["on_scans_matched"], r["n_on_scans"], r["off_scans_checked"]) for r in events] == [(2, 2, 2)]


def test_a_stream_finds_what_a_run_finds(spark, tmp_path):
    """A tone across a unit's edge, found with guard bands only."""
    (tmp_path / "in").mkdir()
    f = write(tmp_path / "in/edge.fil", n_f=16_384, tones=[(4088, 1.5, 5)])
    cfg = SearchConfig(channels_per_unit=4096, snr_threshold=9.0)
    cli.analyze(spark, f, str(tmp_path / "run"), cfg)
    crunch.crunch(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg).awaitTermination()
    key = lambda at: sorted((r["channel"], round(r["drift"], 6), round(r["snr"], 6), r["interest"]) for r in spark.read.parquet(at).collect())
    assert key(str(tmp_path / "run/candidates.parquet")) == key(str(tmp_path / "out/candidates")) and any(abs(c - 4088) <= 3 for c, *_ in key(str(tmp_path / "out/candidates")))


def test_a_stream_uses_the_model_and_refuses_large_units(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/t.fil", tones=[(2000, 1.5, 6)])
    write(tmp_path / "in/long.fil", n_t=700, n_f=4096, seed=1)
    rng = np.random.default_rng(0)
    rows = [(learn.LABELS[i % 7], 0.0, *[float(x) for x in rng.normal(i % 7, 0.2, len(SCALARS))], rng.normal(0, 1, 256).tolist()) for i in range(70)]
    model, _, _ = learn.train(spark.createDataFrame(rows, learn.EXAMPLE), trees=3)
    learn.save(model, str(tmp_path / "m"))
    assert learn.load(spark, str(tmp_path / "m"))[0].snr_max == model.snr_max < 10
    cfg = SearchConfig(model_path=str(tmp_path / "m"), max_download_mb=4)
    crunch.crunch(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg).awaitTermination()
    assert {r["obs"]: r["errors"] for r in crunch.ledger(spark, str(tmp_path / "out")).collect()} == {"t": 0, "long": 1}
    assert "a unit would be" in spark.read.parquet(str(tmp_path / "out/hits")).where("error IS NOT NULL").first()["error"]
    best = spark.read.parquet(str(tmp_path / "out/candidates")).orderBy("snr", ascending=False).first()
    assert best["snr"] > 3 * model.snr_max and best["ai_class"] == "out_of_distribution"  # beyond what this model has seen
    assert {r["obs"]: r["errors"] for r in visit(spark, str(tmp_path / "in"), str(tmp_path / "v"), cfg).collect()} == {"t": 0, "long": 1}


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for d, c in (("a", 1000), ("b", 3000)):
        (tmp_path / "in" / d).mkdir(parents=True)
        write(tmp_path / "in" / d / "x.fil", tones=[(c, 1.5, 6)], seed=c)
    seen = visit(spark, str(tmp_path / "in"), str(tmp_path / "out"), SearchConfig()).collect()
    assert sorted((r["obs"], r["errors"]) for r in seen) == [("a/x", 0), ("b/x", 0)]
    found = spark.read.parquet(str(tmp_path / "out/candidates"))
    assert {(r["obs"], r["channel"] // 1000) for r in found.where("NOT stationary").select("obs", "channel").collect()} >= {("a/x", 1), ("b/x", 3)} or found.count() >= 2
    assert found.select("hit_id").distinct().count() == found.count()
    assert visit(spark, str(tmp_path / "in"), str(tmp_path / "out"), SearchConfig()).count() == 0
