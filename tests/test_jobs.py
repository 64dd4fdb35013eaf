import json
import logging
import os
import shutil
import subprocess
import sys
from urllib.parse import urldefrag, urljoin, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import catalogue, links, queries
from jobs.common import settings
from skydrift.sources import crawl

from .conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["job1_catalogue", "job2_links"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    want = sorted(rel.select(*df.columns).fetchall(), key=repr)
    got = rows(df)
    assert len(got) == len(want) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for a, b in zip(got, want) for x, y in zip(a, b))


BASES = ["https://Data.Example.org/obs/2020/index.html?x=1", "http://h.org", "http://h.org/a", "https://h.org/a/b/", "http://h.org/a/b/c.html#top"]
HREFS = ["x.fil", "/x/y.h5", "//CDN.org/z", "?page=2", "../up.fil", "../../../far.fil", "./here/./a", "sub/../b/c", "HTTP://Other.org/P?q=/a/../b", "https://o.org", "/a/../../b?c=..", "x?next=/../z"]


def test_addresses_as_in_browsers(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "base string, href string")
    for r in df.withColumn("got", crawl.resolved(F.col("href"), F.col("base"))).collect():
        want = urlsplit(urljoin(r["base"], r["href"]))
        assert urlsplit(r["got"])._replace(netloc="") == want._replace(netloc="", path=want.path or "/"), r
        if not r["href"].startswith("//"):
            assert urlsplit(r["got"]).netloc == want.netloc.lower(), r


def test_what_is_no_web_address(spark):
    df = spark.createDataFrame([("", "x.fil"), ("nonsense", "/x"), ("http://h.org/", ""), ("http://h.org/", "mailto:a@b"), ("http://h.org/", "javascript:void(0)"), (None, "y")], "base string, href string")
    assert {r["u"] for r in df.select(crawl.resolved(F.col("href"), F.col("base")).alias("u")).collect()} == {None}
    assert spark.createDataFrame([("", "http://h.org/x")], "base string, href string").select(crawl.resolved(F.col("href"), F.col("base"))).first()[0] == "http://h.org/x"


def test_anchors_of_odd_pages(spark):
    html = """<A class='x' HREF = "a.fil?x=1&amp;y=2#f">1</A><a\nhref='b c.h5'>2</a><a href=bare>3</a><area href="no"><a name="n">4</a><a href="">5</a><a href="a.fil?x=1&amp;y=2">6</a>"""
    df = spark.createDataFrame([(html,), (None,), ("",), ("<a href=",)], "html string")
    assert [r[0] for r in df.select(crawl.hrefs(F.col("html"))).collect()] == [["a.fil?x=1&y=2", "b c.h5", "bare", "", "a.fil?x=1&y=2"], None, [], []]


SCAN = "guppi_58000_43200_HIP99_0004.gpuspec.0000.fil"
PAGES = [(1, "http://h.org/d/", f'<a href="{SCAN}">s</a><a href="{SCAN}#x">again</a><a href="/">root</a>'), (2, "http://h.org/", '<a href="/">root</a>'), (3, None, '<a href="x">lost</a><a href="http://h.org/">root</a>'), (4, "http://h.org/e", None), (None, "http://h.org/f", '<a href="/">root</a>')]


def pages(spark, some, path, mode="append"):
    spark.createDataFrame(some, "page_id long, url string, html string").withColumn("link", F.lit("clash")).coalesce(1).write.mode(mode).parquet(path)


def test_inventory_of_odd_pages(spark, tmp_path):
    pages(spark, PAGES, str(tmp_path / "pages"))
    got = {r["link"]: r for r in links.run(spark, str(tmp_path / "pages") + "/", str(tmp_path / "out")).collect()}
    assert {k: (r["n_pages"], r["first_page"]) for k, r in got.items()} == {"http://h.org/": (4, 1), f"http://h.org/d/{SCAN}": (1, 1)}
    scan = got[f"http://h.org/d/{SCAN}"]
    assert (scan["host"], scan["suffix"], scan["kind"], scan["object"], scan["mjd"]) == ("h.org", "fil", "observation", "HIP99", 58000.5)
    pages(spark, [], str(tmp_path / "none"))
    assert links.run(spark, str(tmp_path / "none"), str(tmp_path / "out0")).count() == 0


def read_pages(caplog):
    return [int(r.getMessage().split()[1]) for r in caplog.records if r.getMessage().startswith("read")]


def test_growing_input_is_taken_once(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    all_pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder, out = str(tmp_path / "pages"), str(tmp_path / "out")
    half = F.col("page_id") % 2 == 0  # two files, one after the other
    all_pages.where(half).coalesce(1).write.parquet(folder)
    first = links.run(spark, folder, out)
    before = rows(first)
    assert before == rows(links.run(spark, f"{SF}/pages.parquet", str(tmp_path / "x")).join(first.select("link"), "link", "left_semi").select("link", *[c for c in links.COLUMNS if c not in ("link", "n_pages", "first_page")]).join(first.select("link", "n_pages", "first_page"), "link").select(*links.COLUMNS))
    all_pages.where(~half).coalesce(1).write.mode("append").parquet(folder)
    second = links.run(spark, folder, out)
    n = all_pages.count()
    assert read_pages(caplog) == [all_pages.where(half).count(), n, all_pages.where(~half).count()]
    whole = rows(links.run(spark, f"{SF}/pages.parquet", str(tmp_path / "whole")))
    assert rows(second) == whole and len(whole) > len(before)
    files = sorted(p for p in (tmp_path / "out" / "inventory").rglob("*.parquet"))
    assert rows(links.run(spark, folder, out)) == whole  # nothing new
    assert read_pages(caplog)[-1] == 0 and files == sorted(p for p in (tmp_path / "out" / "inventory").rglob("*.parquet"))


def test_runs_that_broke_off(spark, tmp_path):
    folder, out = str(tmp_path / "pages"), str(tmp_path / "out")
    pages(spark, PAGES[:2], folder)
    links.run(spark, folder, out)
    pages(spark, PAGES[2:], folder)
    want = rows(links.run(spark, folder, str(tmp_path / "whole")))
    assert rows(links.run(spark, folder, out)) == want
    # after the parts were written, before the mark
    shutil.rmtree(tmp_path / "out" / "marks")
    shutil.rmtree(tmp_path / "out" / "inventory")
    assert rows(links.run(spark, folder, out)) == want
    # after a batch's part was written, before the batch was committed
    last = max((int(p.name) for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir() if p.name.isdigit()))
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert rows(links.run(spark, folder, out)) == want


def test_shards_stay_what_they_were(spark, tmp_path):
    pages(spark, PAGES, str(tmp_path / "pages"))
    links.run(spark, str(tmp_path / "pages"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="64 shards"):
        links.run(spark, str(tmp_path / "pages"), str(tmp_path / "out"), settings("links") | {"shards": 8})


def hits(spark, path, some):
    named = {"hit_id": "long", "target": "string", "file": "string", "frequency_mhz": "double", "drift": "double", "drift_rate_hz_s": "double", "snr": "double", "channel": "long", "bandwidth_ch": "double", "on_fraction": "double", "anomaly": "double", "p_a": "double", "p_rfi_b": "double", "drift_unresolved": "boolean", "cadence": "string", "rank": "string"}
    spark.createDataFrame(some, ", ".join(f"{k} {v}" for k, v in named.items())).write.mode("overwrite").parquet(path)
    return settings("catalogue") | {"hits": {k: k for k in named if k != "rank"}, "classes": ["a", "rfi_b"]}


def hit(i, target, mhz=1400.0, snr=20.0, p=0.9, **more):
    row = dict(hit_id=i, target=target, file=target, frequency_mhz=mhz, drift=2.0, drift_rate_hz_s=0.3, snr=snr, channel=100 * (i or 0), bandwidth_ch=1.0, on_fraction=1.0, anomaly=None, p_a=p, p_rfi_b=0.5, drift_unresolved=False, cadence=None, rank="clash") | more
    return tuple(row.values())


def test_catalogue_of_odd_hits(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    path, out = str(tmp_path / "hits"), str(tmp_path / "out")
    some = [hit(1, "A b/=%"), hit(2, "A b/=%", 1402.0), hit(3, "B", 1404.0, snr=30.0), hit(4, "C", 1404.001, snr=30.0), hit(5, "C", 1300.0), hit(6, "C", 1410.0, cadence="failed"), hit(7, "C", 1411.0, p=None, anomaly=1.0), hit(None, "C"), hit(8, None), hit(9, "")]
    cfg = hits(spark, path, some)
    got = {r["hit_id"]: r for r in catalogue.run(spark, path, out, cfg).collect()}
    assert set(got) == set(range(1, 8))
    assert {k: r["reason"] for k, r in got.items()} == {1: None, 2: None, 3: "multi_target", 4: "multi_target", 5: "known_rfi_band", 6: "cadence_failed", 7: "ai_rfi"}
    order = sorted(got.values(), key=lambda r: (-r["interest"], r["hit_id"]))
    assert [r["rank"] for r in order] == list(range(1, 8))
    for target in ("A b/=%", "B", "C"):
        assert [r["target_rank"] for r in order if r["target"] == target] == list(range(1, 1 + sum(r["target"] == target for r in order)))
    assert any(r.getMessage().startswith("read 10 hits") and "3 of them without" in r.getMessage() for r in caplog.records) and any(r.getMessage().startswith("wrote 7 hits") for r in caplog.records)
    assert rows(catalogue.run(spark, path, out, cfg)) == rows(spark.createDataFrame(list(got.values()), catalogue.run(spark, path, out, cfg).schema))


def test_partitions_are_replaced_and_others_stay(spark, tmp_path):
    path, out = str(tmp_path / "hits"), str(tmp_path / "out")
    cfg = hits(spark, path, [hit(1, "A"), hit(2, "B", 1403.0)])
    catalogue.run(spark, path, out, cfg)
    hits(spark, path, [hit(3, "B", 1406.0)])
    assert {(r["hit_id"], r["target"], r["rank"]) for r in catalogue.run(spark, path, out, cfg).collect()} == {(1, "A", 1), (3, "B", 1)}
    hits(spark, path, [])
    assert catalogue.run(spark, path, out, cfg).count() == 2 and spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_settings(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"shards": 4}))
    assert settings("links", str(tmp_path / "own.json")) == settings("links") | {"shards": 4}
    (tmp_path / "bad.json").write_text(json.dumps({"shard": 4}))
    with pytest.raises(ValueError, match="shard"):
        settings("links", str(tmp_path / "bad.json"))


@pytest.mark.parametrize("job", ["catalogue", "links"])
def test_command_line(spark, tmp_path, job):
    source, table = {"catalogue": ("--hits", "orders"), "links": ("--pages", "pages")}[job]
    (tmp_path / "own.json").write_text("{}")
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", source, f"{SF}/{table}.parquet", "--out", str(tmp_path / "out"), "--config", str(tmp_path / "own.json")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job} read" in done.stderr and f"jobs.{job} wrote" in done.stderr
    made = catalogue.COLUMNS if job == "catalogue" else links.COLUMNS
    at = str(tmp_path / "out") + ("/inventory" if job == "links" else "")
    assert spark.read.parquet(at).count() == queries.queries()[{"catalogue": "job1_catalogue", "links": "job2_links"}[job]](spark, SF).count() and set(made) <= set(spark.read.parquet(at).columns)


def test_jobs_stand_alone():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            text = open(f"{ROOT}/jobs/{name}").read()
            assert "llm" not in text and "corpus_pipeline" not in text
