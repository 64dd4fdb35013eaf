"""Filterbank files: headers, windows, ranges over HTTP, the data source and the stream."""

import http.server
import re
import threading

import numpy as np
import pytest

from skydrift import cli
from skydrift.config import SearchConfig
from skydrift.sources import filterbank as fb
from skydrift.streaming import crunch


def make(path, n_t=16, n_f=4096, seed=0, tone=None, **header):
    z = np.random.default_rng(seed).normal(10, 1, (n_t, n_f)).astype(np.float32)
    if tone:
        for t in range(n_t):
            z[t, round(tone[0] + tone[1] * t)] += 6
    fb.write_file(str(path), z, fb.Header(**{"fch1": 1420.0, "foff": -2.7939677238464355e-06, "tsamp": 18.253611008, "source_name": "X"} | header))
    return z


def test_header_round_trip(tmp_path):
    make(tmp_path / "a.fil", source_name="")
    h = fb.read_header(str(tmp_path / "a.fil"))
    assert (h.nchans, h.nsamples, h.nbits, h.source_name, h.tsamp) == (4096, 16, 32, "", 18.253611008)


@pytest.mark.parametrize("nbits,kind", fb.KINDS.items())
def test_windows_of_each_width(tmp_path, nbits, kind):
    z = np.arange(6 * 2 * 50).reshape(6, 2, 50).astype(kind)
    h = fb.Header(fch1=1.0, foff=1.0, nchans=50, tsamp=1.0, nifs=2, nbits=nbits)
    (tmp_path / "b.fil").write_bytes(fb.header_bytes(h) + z.tobytes())
    got = fb.read_window(str(tmp_path / "b.fil"), 10, 30, if_index=1)
    assert got.dtype == np.float32 and (got == z[:, 1, 10:30].astype(np.float32)).all()


def test_bad_headers(tmp_path):
    with pytest.raises(EOFError):
        fb.parse_header(fb.header_bytes(fb.Header(nchans=1))[:-5])
    with pytest.raises(ValueError):
        fb.parse_header(b"\x05\x00\x00\x00hello")
    with pytest.raises(ValueError):
        fb.parse_header(fb.header_bytes(fb.Header(nchans=1, nbits=4)))


class Ranges(http.server.SimpleHTTPRequestHandler):
    honour = True

    def log_message(self, *a):
        pass

    def do_GET(self):
        data = open(self.directory + self.path, "rb").read()
        m = re.match(r"bytes=(\d+)-(\d*)", self.headers.get("Range") or "")
        if m and self.honour:
            a, b = int(m[1]), min(len(data), int(m[2] or len(data)) + 1)
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(data)}")
            part = data[a:b]
        else:
            self.send_response(200)
            part = data
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)


@pytest.fixture
def server(tmp_path):
    handler = type("H", (Ranges,), {})
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: handler(*a, directory=str(tmp_path)))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", handler
    s.shutdown()


def test_remote_window(tmp_path, server):
    z = make(tmp_path / "c.fil")
    url = f"{server[0]}/c.fil"
    assert fb.read_header(url).nsamples == 16
    assert (fb.read_window(url, 100, 200) == z[:, 100:200]).all()
    assert fb.download(url, str(tmp_path / "d.fil"), 10) and (tmp_path / "d.fil").stat().st_size == (tmp_path / "c.fil").stat().st_size
    with pytest.raises(ValueError):
        fb.download(url, str(tmp_path / "e.fil"), 0.01)


def test_server_without_ranges(tmp_path, server):
    make(tmp_path / "c.fil")
    server[1].honour = False
    with pytest.raises(fb.RangeNotSupported):
        fb.read_header(f"{server[0]}/c.fil")


def test_data_source_and_writer(spark, tmp_path):
    fb.register(spark)
    (tmp_path / "in").mkdir()
    z = make(tmp_path / "in/a.fil")
    (tmp_path / "in/bad.fil").write_bytes(b"\x05\x00\x00\x00hello")
    assert {bool(r["error"]) for r in fb.header_table(spark, str(tmp_path / "in")).collect()} == {True, False}
    (tmp_path / "in/bad.fil").unlink()
    units = spark.read.format("filterbank").option("width", 1024).option("pad", 100).load(str(tmp_path / "in"))
    rows = {r["unit_id"]: r for r in units.collect()}
    assert len(rows) == 4 and rows["a:1024-2048"]["n_f"] == 1224
    got = np.frombuffer(rows["a:1024-2048"]["z"], "<f8").reshape(16, 1224)
    assert (got == z[:, 924:2148]).all()
    units.write.format("filterbank").mode("append").option("path", str(tmp_path / "out")).save()
    assert (fb.read_window(str(tmp_path / "out/a_1024-2048.fil"), 0, 1224) == z[:, 924:2148]).all()


def test_overlapping_units_find_a_tone_once(spark, tmp_path):
    make(tmp_path / "t.fil", n_f=65536, tone=(16390, -2.5))
    fb.register(spark)
    meta = cli.analyze(spark, str(tmp_path / "t.fil"), str(tmp_path / "run"), SearchConfig(channels_per_unit=16384))
    found = spark.read.parquet(str(tmp_path / "run/candidates.parquet")).collect()
    assert meta["stats"]["work_units"] == 4 and meta["stats"]["errors"] == 0
    assert [abs(r["channel"] - 16390) <= 3 and abs(r["drift"] + 2.5) < 0.5 for r in found] == [True]


def test_stream_takes_each_file_once_in_any_order_of_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(tmp_path / "in/m.fil")
    make(tmp_path / "in/z.fil", seed=1)
    cfg, seen = SearchConfig(channels_per_unit=8192), lambda: {(r["obs"], r["units"], r["errors"]) for r in crunch.ledger(spark, str(tmp_path / "out")).collect()}
    run = lambda: crunch.crunch(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg).awaitTermination()
    run()
    first = seen()
    assert {o for o, _, _ in first} == {"m", "z"}
    make(tmp_path / "in/a.fil", seed=2)  # sorts before those that are done
    (tmp_path / "in/m.fil").unlink()
    (tmp_path / "in/bad.fil").write_bytes(b"\x05\x00\x00\x00hello")
    run()
    later = {o: (u, e) for o, u, e in seen()}
    assert set(later) == {"m", "z", "a", "bad"} and later["bad"][1] == 1
    assert later["z"] == next((u, e) for o, u, e in first if o == "z")  # not searched again


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make(tmp_path / "in/a.fil", tone=(2000, 1.5))
    make(tmp_path / "in/b.fil", seed=1)
    cfg = SearchConfig(channels_per_unit=2048)
    for _ in range(2):  # the second run finds nothing new
        crunch.crunch(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg, pad=100).awaitTermination()
        assert {(r["obs"], r["units"], r["errors"]) for r in crunch.ledger(spark, str(tmp_path / "out")).collect()} == {("a", 2, 0), ("b", 2, 0)}
    make(tmp_path / "in/c.fil", seed=2)
    crunch.crunch(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg, pad=100).awaitTermination()
    assert len(crunch.ledger(spark, str(tmp_path / "out")).collect()) == 3
    assert abs(crunch.best_so_far(spark, str(tmp_path / "out")).first()["drift_rate_hz_s"]) > 0


TONES = [(13_000, 1.4), (30_000, -2.3), (55_000, 3.1)]


def observation(path):
    """Three drifting tones among steady and broad ones."""
    rng = np.random.default_rng(3)
    z = rng.normal(10, 1, (16, 1 << 16))
    t = np.arange(16)
    for c, drift in TONES:
        z[t, np.rint(c + drift * t).astype(int)] += 8
    for c in rng.integers(2000, 60_000, 8):
        z[:, c] += 7
        z[:, c + 300 : c + 330] += 1
    fb.write_file(str(path), z.astype(np.float32), fb.Header(fch1=1420.0, foff=-2.7939677238464355e-06, tsamp=18.253611008, tstart=59000.0, source_name="DEMO"))
    return str(path)


def test_tones_among_interference(spark, tmp_path):
    meta = cli.analyze(spark, observation(tmp_path / "demo.fil"), str(tmp_path / "run"), SearchConfig(channels_per_unit=1 << 15))
    assert meta["stats"]["errors"] == 0
    found = spark.read.parquet(str(tmp_path / "run/candidates.parquet")).where("NOT stationary").collect()
    for c, drift in TONES:
        assert any(abs(r["channel"] - c) <= 3 and abs(r["drift"] - drift) < 0.3 for r in found)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"snr_threshold": 12, "unknown": 1, "known_rfi_bands_mhz": [[1, 2]]}')
    c = SearchConfig.load(str(tmp_path / "c.json"))
    assert c.snr_threshold == 12 and c.known_rfi_bands_mhz == ((1, 2),)
    assert SearchConfig.load(str(tmp_path / "none.json")) == SearchConfig()


def t0_steps(n):
    """Time steps, and so channels at one channel a step, from the first scan to the n-th."""
    return n * 0.0035 * 86400 / 18.253611008


def test_cadence_over_files(spark, tmp_path):
    fb.register(spark)
    files = []
    for n, (name, tone) in enumerate([("A_ON1", True), ("B_OFF1", False), ("A_ON2", True), ("B_OFF2", False)]):
        t0 = 59000 + n * 0.0035
        make(tmp_path / f"{name}.fil", seed=n, tone=(2000 + t0_steps(n), 1.0) if tone else None, tstart=t0)
        files.append(str(tmp_path / f"{name}.fil"))
    got = cli.cadence(spark, files, str(tmp_path / "out"), SearchConfig(channels_per_unit=4096)).collect()
    assert [(r["on_scans_matched"], r["n_on_scans"], r["off_scans_checked"], r["matched_in"]) for r in got] == [(2, 2, 2, "A_ON2")]


def test_share_sends_once(spark, tmp_path):
    fb.register(spark)
    cli.analyze(spark, observation(tmp_path / "demo.fil"), str(tmp_path / "run"), SearchConfig(channels_per_unit=1 << 15))
    cfg = SearchConfig(share_min_interest=20.0)
    first = cli.share_run(spark, str(tmp_path / "run"), str(tmp_path / "s"), cfg).count()
    assert 0 < first <= 3
    assert spark.read.text(str(tmp_path / "s/bundle")).count() == first
    again = {r["finding_id"] for r in spark.read.parquet(str(tmp_path / "s/shared")).collect()}
    assert len(again) == first


def test_probe_cache_and_versions():
    from skydrift.operators import ledger

    calls, cache = [], {}
    for now in (0, 3600, 90_000):
        ledger.probed(cache, "k", lambda k: calls.append(k), now)
    assert len(calls) == 2
    assert ledger.results_version({"a": 1}, "1") != ledger.results_version({"a": 2}, "1")


def test_publishing(spark):
    import json

    from skydrift.operators import share
    from skydrift.plans.results import classed
    from skydrift.sources import publish

    from .conftest import SF

    seen = []

    class Hook(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, body, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            known = any(u == "/repos/a/b/issues" and re.search(r"AIS-[0-9A-F]{12}", self.path)[0] in x["title"] for u, x in seen)
            self.answer({"total_count": int(known)})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/bad":
                return self.answer({}, 500)
            seen.append((self.path, body))
            self.answer({"html_url": "http://x/1"})

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    from pyspark.sql import functions as F

    found = share.records(classed(spark, SF).withColumn("finding_id", share.finding_id(F.col("target"))).orderBy("hit_id").limit(3))
    assert all(r["ok"] for r in publish.to_webhook(found, f"{url}/hook", "slack").collect())
    assert len(seen) == 3 and all(len(b["text"]) <= 1990 for _, b in seen)
    assert {r["detail"] for r in publish.to_issues(found, url, "a/b", "t").collect()} == {"http://x/1"}
    assert {r["detail"] for r in publish.to_issues(found, url, "a/b", "t").collect()} == {"there already"}
    assert not any(r["ok"] for r in publish.to_webhook(found, f"{url}/bad").collect())
    s.shutdown()


def test_filters_on_headers_open_fewer_windows(spark, tmp_path, monkeypatch):
    fb.register(spark)
    (tmp_path / "in").mkdir()
    make(tmp_path / "in/a.fil", fch1=1420.0)
    make(tmp_path / "in/b.fil", fch1=1500.0, source_name="Y")
    (tmp_path / "in/c.fil").write_bytes((tmp_path / "in/b.fil").read_bytes()[:-20_000])  # its last windows can't be read
    load = lambda: spark.read.format("filterbank").option("width", 1024).load(str(tmp_path / "in"))
    whole = {r["unit_id"]: r for r in load().collect()}
    assert len(whole) == 12
    step = -2.7939677238464355e-06
    inside = load().where(f"f_high >= {1420 + step * 1500} AND f_low <= {1420 + step * 1030}")
    assert {r["unit_id"] for r in inside.collect()} == {"a:1024-2048"} and inside.rdd.getNumPartitions() == 1
    asked = load().where("source_name = 'Y' AND core_start IN (0, 1024) AND unit_id LIKE 'b%'")
    assert {r["unit_id"] for r in asked.collect()} == {"b:0-1024", "b:1024-2048"} and asked.rdd.getNumPartitions() == 2
    assert {r["unit_id"] for r in load().where("error IS NOT NULL AND nchans > 5").collect()} == {k for k, r in whole.items() if r["error"]} != set()
    assert {r["unit_id"] for r in load().where("f_low > 1450 OR n_t = 3").collect()} == {k for k in whole if k[0] in "bc"}
    for r in whole.values():
        assert r["f_low"] < r["f_high"] and r["f_high"] == r["fch1"] + step * r["core_start"]


def test_offsets_stay_small_and_batches_bounded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        make(tmp_path / f"in/{9 - k}.fil", n_f=256, seed=k)
    stream = fb.FilterbankStream({"path": str(tmp_path / "in"), "width": "256", "files_per_batch": "2"})
    at, taken = stream.initialOffset(), []
    for _ in range(4):
        end = stream.latestOffset()
        taken.append([fb.stem(u.location) for u in stream.partitions(at, end)])
        at = end
    assert taken == [["9", "8"], ["7", "6"], ["5"], []] and set(at) == {"at", "path"}
    import os

    make(tmp_path / "in/old.fil", n_f=256)
    os.utime(tmp_path / "in/old.fil", (1, 1))  # its content is old, but it has just come
    (tmp_path / "in/9.fil").unlink()
    again = fb.FilterbankStream({"path": str(tmp_path / "in"), "width": "256", "files_per_batch": "2"})  # goes on where the other one stopped
    end = again.latestOffset()
    assert [fb.stem(u.location) for u in again.partitions(at, end)] == ["old"]
    assert again.partitions(end, again.latestOffset()) == []
    empty = fb.FilterbankStream({"path": str(tmp_path / "none")})
    assert empty.partitions(empty.initialOffset(), empty.latestOffset()) == []
