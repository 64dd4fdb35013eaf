"""python -m skydrift.cli COMMAND ...: the search from the command line."""

from __future__ import annotations

import argparse
import json
import math
import os
import time
import urllib.request

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SearchConfig
from .functions.exprs import is_off_scan
from .operators import learn, report, rfi, rollup, share
from .operators.search import candidates, cut, guard, searched, unpacked
from .operators.siblings import scan_table, tested
from .sources import archive, filterbank, publish
from .sources.shared import kept


def session() -> SparkSession:
    spark = SparkSession.builder.appName("skydrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    filterbank.register(spark)
    return spark


def too_large(h: filterbank.Header, cfg: SearchConfig) -> str | None:
    """Why a unit of this file would not fit, or None (as axis.unit_too_large)."""
    mb = min(min(cfg.channels_per_unit, h.nchans) + 2 * guard(h, cfg), h.nchans) * h.nsamples * 4 / (1 << 20)
    return f"a unit would be {math.ceil(mb)} MB; the limit is {cfg.max_download_mb}" if mb > cfg.max_download_mb else None


def analyze(spark: SparkSession, location: str, out: str, cfg: SearchConfig, f_start: float | None = None, f_stop: float | None = None, scans: dict[str, bool] | None = None, cache: str | None = None) -> dict:
    """Searches one file, or a frequency range of it, and writes the run below out. scans: the files of its cadence, and
    which are ON; hits are then looked for in the others, whose results are kept in the folder `cache`."""
    began = time.perf_counter()
    filterbank.register(spark)
    h = filterbank.read_header(location)
    if reason := too_large(h, cfg):
        raise ValueError(f"{location} is not searched: {reason}")
    c0, c1 = 0, h.nchans
    if f_start is not None or f_stop is not None:
        ends = [((f - h.fch1) / h.foff) for f in (h.fch1 if f_start is None else f_start, h.fch1 + h.foff * (h.nchans - 1) if f_stop is None else f_stop)]
        c0, c1 = max(0, int(np.floor(min(ends)))), min(h.nchans, int(np.ceil(max(ends))) + 1)
    units = spark.read.format("filterbank").options(**cut(cfg), c0=c0, c1=c1).load(location)
    hits = searched(units, cfg).cache()
    model, why = learn.load(spark, cfg.model_path) if cfg.use_ai else (None, "switched off")
    found = candidates(hits, cfg, model)
    if scans:
        found = tested(found, scan_table(spark, scans), location, cfg, cache or f"{out}/cadence-cache")
    meta = report.write_run(spark, hits, found, out, cfg, os.path.basename(location), time.perf_counter() - began, why and f"hits have no classes: {why}")
    hits.unpersist()
    return meta


def observed(spark: SparkSession, location: str, cfg: SearchConfig) -> tuple[DataFrame, filterbank.Header, int]:
    """(normalised samples of a file's units, header, channels a unit): obs is the unit's first channel. Units are whole,
    so a last one that is narrower is left out."""
    filterbank.register(spark)
    h = filterbank.read_header(location)
    width = min(cfg.channels_per_unit, h.nchans)
    units = spark.read.format("filterbank").option("width", width).option("c1", h.nchans // width * width).load(location)
    return unpacked(units, cfg), h, width


def planted_in(spark: SparkSession, location: str, cfg: SearchConfig, snrs: tuple[float, ...], drifts: tuple[float, ...]) -> dict:
    """The arguments of learn's tests with planted tones for a file."""
    samples, h, width = observed(spark, location, cfg)
    k = max(1, math.ceil(max(drifts)))
    return {"samples": samples, "n_t": h.nsamples, "n_f": width, "k_max": k, "threshold": cfg.snr_threshold, "snrs": snrs, "drifts": drifts}


def siblings(spark: SparkSession, folder: str, product: str) -> dict[str, bool]:
    """Scans of one product in a folder that make a cadence by their names: path, and whether the scan is ON its target."""
    listing = "".join(f'<a href="{n}">' for n in sorted(os.listdir(folder)) if '"' not in n)
    scans = archive.cadence_scans(spark.createDataFrame([(folder, listing)], "folder string, listing string"), product)
    return {os.path.join(folder, r["name"]): r["is_on"] for r in scans.orderBy("mjd").collect()}


def cadence(spark: SparkSession, files: list[str], out: str, cfg: SearchConfig, is_on: dict[str, bool] | None = None) -> DataFrame:
    """Searches ON and OFF scans (names with _OFF are OFF, if is_on doesn't say) and writes the signals that come again
    in every ON scan along their drift, and in no OFF scan."""
    filterbank.register(spark)
    heads = {os.path.splitext(os.path.basename(f))[0]: filterbank.read_header(f) for f in files}
    units = spark.read.format("filterbank").options(**cut(cfg)).load(",".join(files))
    hits = searched(units, cfg).where("channel IS NOT NULL")
    hits = hits.select(F.xxhash64("unit_id", "channel").alias("hit_id"), F.regexp_replace("unit_id", ":[^:]*$", "").alias("name"), "frequency_mhz", "drift_rate_hz_s", "snr")
    hits.write.mode("overwrite").parquet(f"{out}/hits")
    scans = spark.createDataFrame([(n, h.tstart) for n, h in heads.items()], "name string, mjd double").withColumn("is_on", ~is_off_scan("name"))
    if is_on:
        told = {os.path.splitext(os.path.basename(f))[0]: v for f, v in is_on.items()}
        scans = spark.createDataFrame([(n, h.tstart, told[n]) for n, h in heads.items()], "name string, mjd double, is_on boolean")
    rfi.cadence_events(scans, spark.read.parquet(f"{out}/hits")).write.mode("overwrite").parquet(f"{out}/events")
    return spark.read.parquet(f"{out}/events")


def share_run(spark: SparkSession, run: str, out: str, cfg: SearchConfig, to: tuple[str, ...] = ("bundle",)) -> DataFrame:
    """Sends the run's best findings that pass the gate to each place that doesn't hold them yet, and remembers what
    arrived: (finding_id, destination, ok, detail)."""
    found = spark.read.parquet(f"{run}/candidates.parquet").where(F.col("interest") >= cfg.share_min_interest)
    lacking = {c: F.lit(None).cast(t) for c, t in (("multi_target", "boolean"), ("synthetic", "boolean")) if c not in found.columns}
    found = found.withColumns(lacking | {"cadence": F.col("cadence") if "cadence" in found.columns else F.lit("not_run"), "finding_id": share.finding_id(F.col("file"))})
    try:
        done = spark.read.parquet(f"{out}/shared")
    except AnalysisException:  # nothing has been shared
        done = spark.createDataFrame([], "finding_id string, destination string")
    chosen = share.decisions(found, to, done, cfg.share_require_cadence).where("action = 'send'").select("finding_id", "destination")
    results = None
    for place in to:
        best = share.records(found.join(chosen.where(F.col("destination") == place), "finding_id", "left_semi"))
        if place == "bundle":
            sent = share.write_bundle(best, f"{out}/bundle", cfg.share_top).select("finding_id", F.lit(True).alias("ok"), F.lit("written").alias("detail"))
        else:
            top = best.orderBy(F.desc("interest"), "finding_id").limit(cfg.share_top).select("finding_id", "record").repartition(1)  # a few, one after the other
            if place == "webhook" and cfg.webhook_url:
                sent = publish.to_webhook(top, cfg.webhook_url, cfg.webhook_format)
            elif place == "issues" and cfg.github_repo:
                sent = publish.to_issues(top, os.environ.get("ISSUES_API", "https://api.github.com"), cfg.github_repo, os.environ.get("GITHUB_TOKEN", ""))
            else:
                raise ValueError(f"the settings don't say where {place} is")
        sent = sent.withColumn("destination", F.lit(place))
        results = sent if results is None else results.unionByName(sent)
    results = spark.createDataFrame(results.collect(), results.schema)  # sent once; share_top rows a place
    results.where("ok").select("finding_id", "destination").write.mode("append").parquet(f"{out}/shared")
    return results


def status(spark: SparkSession, archive_url: str | None, volunteers_url: str | None) -> list[str]:
    """What the two kinds of servers answer: an archive's query for one row, and a project's status page."""
    def fetch(url: str) -> bytes:
        with urllib.request.urlopen(url, timeout=10) as r:
            return r.read()

    out = [f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} tasks at once"]
    if archive_url:
        rows = archive.observations(spark, archive_url, {"target": "HIP", "limit": 1}, fetch).collect()
        bad = [r["target"] for r in rows if r["kind"] == "error"]
        out.append(f"archive: unreachable ({bad[0]})" if bad else "archive: reachable" if rows else "archive: answered, but returned no rows")
    if volunteers_url:
        try:
            r = archive.ready_to_send(spark.createDataFrame([(1, fetch(volunteers_url).decode())], "id int, body string")).first()
            out.append(f"volunteers: reachable, {r['ready']} results ready" if r["distributing"] else "volunteers: reachable, sends out no work")
        except Exception as e:  # noqa: BLE001 - a status says what is wrong
            out.append(f"volunteers: unreachable ({type(e).__name__})")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skydrift")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"inspect": ["path"], "analyze": ["path", "out"], "crunch": ["folder", "out"], "train": ["path", "out"], "benchmark": ["path", "out"], "summary": ["root"], "share": ["run", "out"], "status": []}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        s.add_argument("--config")
        if name == "crunch":
            s.add_argument("--limit", type=int, help="files of a visit")
            s.add_argument("--max-units", type=int, help="units of a file on a visit; the next visit goes on from there")
        if name == "share":
            s.add_argument("--to", help="bundle, webhook, issues; comma-separated")
        if name == "summary":
            s.add_argument("--out")
        if name == "status":
            s.add_argument("--archive", help="base address of an archive's queries")
            s.add_argument("--volunteers", help="address of a project's status page")
        if name == "analyze":
            s.add_argument("--cadence", metavar="PRODUCT", help="look for hits in the other scans of this product in the file's folder, e.g. 0000.fil")
            s.add_argument("--cache", help="folder that keeps what scans of a cadence gave")
            s.add_argument("--f-start", type=float)
            s.add_argument("--f-stop", type=float)
    s = sub.add_parser("cadence")
    s.add_argument("out")
    s.add_argument("files", nargs="+", help="scans, or one folder whose names tell the cadence")
    s.add_argument("--product", default="0000.fil", help="which of a folder's products")
    s.add_argument("--config")
    a = p.parse_args(argv)
    spark, cfg = session(), SearchConfig.load(a.config)
    if a.command == "inspect":
        filterbank.header_table(spark, a.path).show(truncate=False)
    elif a.command == "analyze":
        scans = siblings(spark, os.path.dirname(os.path.abspath(a.path)), a.cadence) if a.cadence else None
        print(json.dumps(analyze(spark, os.path.abspath(a.path) if scans else a.path, a.out, cfg, a.f_start, a.f_stop, scans, a.cache)["stats"]))
    elif a.command == "crunch":
        from .streaming.crunch import crunch, ledger, visit

        if a.limit or a.max_units:
            visit(spark, a.folder, a.out, cfg, a.limit or 1000, a.max_units).show(truncate=False)
        else:
            crunch(spark, a.folder, a.out, cfg).awaitTermination()
            ledger(spark, a.out).show()
    elif a.command == "train":
        rows = kept(learn.examples(**planted_in(spark, a.path, cfg, (12.0, 20.0, 40.0), (0.0, 0.5, 2.0, 8.0))), "training")
        model, _, right = learn.train(rows)
        learn.save(model, a.out)
        print(f"right on the held-out quarter: {right:.3f}")
    elif a.command == "benchmark":
        rollup.recovery(learn.recovery_trials(**planted_in(spark, a.path, cfg, (6.0, 8.0, 10.0, 12.0, 20.0), (0.0, 0.5, 2.0, 8.0)))).write.mode("overwrite").option("header", True).csv(a.out)
        spark.read.option("header", True).csv(a.out).orderBy("snr", "drift").show()
    elif a.command == "summary":
        table, notes, best = report.summary(spark, a.root, a.out or a.root)
        table.show(1000, truncate=False)
        print(json.dumps({"warnings": notes, "best": best}, default=str))
    elif a.command == "cadence":
        on = siblings(spark, a.files[0], a.product) if len(a.files) == 1 and os.path.isdir(a.files[0]) else None
        cadence(spark, list(on) if on is not None else a.files, a.out, cfg, on).show(truncate=False)
    elif a.command == "share":
        share_run(spark, a.run, a.out, cfg, tuple(a.to.split(",")) if a.to else cfg.share_to).show(truncate=False)
    elif a.command == "status":
        for line in status(spark, a.archive, a.volunteers):
            print(line)


if __name__ == "__main__":
    main()
