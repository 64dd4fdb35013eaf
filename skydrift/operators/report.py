"""What a run leaves: tables, metadata and a page to look at."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from . import rollup
from .search import pulses_of, spikes_of

STAGES = ("preprocess", "dedoppler", "features", "detectors")


def public(df: DataFrame) -> DataFrame:
    """Without columns whose name begins with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def write_run(spark: SparkSession, hits: DataFrame, found: DataFrame, folder: str, cfg: SearchConfig, title: str, wall_seconds: float = 0.0, ai_note: str | None = None) -> dict:
    """candidates, spikes, pulses (Parquet and CSV), snippets, metadata.json and report.html below the folder;
    returns the metadata. hits: as searched gives them."""
    public(found).write.mode("overwrite").parquet(f"{folder}/candidates.parquet")
    kept = spark.read.parquet(f"{folder}/candidates.parquet")
    kept.drop("img", "stage_seconds", "spikes", "pulses").write.mode("overwrite").option("header", True).csv(f"{folder}/candidates.csv")
    for name, df in (("spikes", spikes_of(hits)), ("pulses", pulses_of(hits))):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    if "img" in found.columns:  # the snippets of the strongest
        kept.orderBy(F.desc("interest"), "hit_id").limit(200).select("hit_id", "img").write.mode("overwrite").parquet(f"{folder}/snippets.parquet")
    lone, all_spikes, flat = F.filter("spikes", lambda x: x["isolated"]), F.sum(F.size("spikes")), F.filter("pulses", lambda x: x["likely_rfi"])
    s = hits.agg(
        F.count_distinct("unit_id").alias("work_units"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("n_channels"), F.lit(0)).alias("channels"), F.count("channel").alias("hits"), F.coalesce(F.sum(F.size(lone)), F.lit(0)).alias("spikes"),
        F.coalesce(all_spikes - F.sum(F.size(lone)), F.lit(0)).alias("spikes_on_tones"), F.coalesce(F.sum(F.size("pulses")), F.lit(0)).alias("pulses"), F.coalesce(F.sum(F.size(flat)), F.lit(0)).alias("pulses_undispersed"), F.coalesce(F.round(F.sum("seconds"), 3), F.lit(0.0)).alias("cpu_seconds"),
        F.min("drift_searched_hz_s").alias("drift_searched_hz_s"), *[F.round(F.sum(F.col("stage_seconds")[k]), 3).alias(f"stage_{k}") for k in STAGES]).first().asDict()
    s["stage_seconds"] = {k: s.pop(f"stage_{k}") or 0.0 for k in STAGES}
    if wall_seconds:
        s |= {"wall_seconds": round(wall_seconds, 2), "channels_per_second": round(s["channels"] / wall_seconds, 1)}
    if ai_note:
        s["ai_note"] = ai_note
    if (s["drift_searched_hz_s"] or cfg.max_drift_rate_hz_s) < cfg.max_drift_rate_hz_s * 0.999:
        s["drift_note"] = f"units are too narrow: drifts up to {s['drift_searched_hz_s']:g} of {cfg.max_drift_rate_hz_s:g} Hz/s were searched"
    meta = {"title": title, "processed_utc": datetime.now(UTC).isoformat(timespec="seconds"), "config": cfg.to_dict(), "stats": s}
    top = [r.asDict() for r in kept.orderBy(F.desc("interest"), "hit_id").limit(25).select("hit_id", "frequency_mhz", "drift_rate_hz_s", "snr", "interest", "ai_class").collect()]
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.json")
    spark.createDataFrame([(page(title, s, top),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.html")
    return meta


def page(title: str, stats: dict, top: list[dict]) -> str:
    """A self-contained page with the strongest candidates and their data as JSON."""
    names = list(top[0]) if top else []
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in top)
    data = json.dumps(top, default=str).replace("</", "<\\/")
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{html.escape(json.dumps(stats))}</p><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>{cells}</table><script type=\"application/json\">{data}</script>"


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """A row for each finished run below root; a folder without metadata, or with broken ones, gives none."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True, pathGlobFilter="part-*.txt").withColumn("path", F.col("_metadata.file_path")).where(F.col("path").contains("/metadata.json/"))
    meta = F.from_json("value", "title string, processed_utc string, stats struct<work_units:long,errors:long,channels:long,hits:long,spikes:long,pulses:long,cpu_seconds:double,wall_seconds:double,channels_per_second:double,drift_searched_hz_s:double,ai_note:string>, config struct<max_drift_rate_hz_s:double>")
    run = F.regexp_extract("path", "/([^/]+)/metadata[.]json/", 1)
    at = F.regexp_extract("path", "^(.*)/metadata[.]json/", 1)
    return raw.select(run.alias("run"), at.alias("at"), meta.alias("m")).where("m.stats IS NOT NULL").select("run", "at", "m.title", "m.processed_utc", "m.stats.*", "m.config.max_drift_rate_hz_s")


def summary(spark: SparkSession, root: str, out: str) -> tuple[DataFrame, dict, dict]:
    """All runs below root with their best candidate and flags, and a row of totals, as summary.csv and summary.html
    below out; (the table, warnings, the best run)."""
    runs = read_runs(spark, root)
    paths = [f"{r['at']}/candidates.parquet" for r in runs.select("at").toLocalIterator()]  # an address a run
    if not paths:
        return runs.drop("at"), {}, {}
    found = spark.read.option("mergeSchema", "true").parquet(*paths)  # one scan for all runs, whose columns may differ
    lacking = {c: F.lit(None).cast("boolean") for c in ("mirror_image", "multi_target") if c not in found.columns}
    found = found.withColumns(lacking | {"run": F.regexp_extract("_metadata.file_path", "/([^/]+)/candidates[.]parquet/", 1)})
    found = found.select("run", "hit_id", "frequency_mhz", "drift_rate_hz_s", "snr", "interest", "ai_class", "mirror_image", "multi_target")
    table = rollup.per_run(runs.drop("at"), found)
    table = table.withColumn("flags", rollup.run_flags())
    notes = rollup.warnings(table).first().asDict()
    best = (rollup.best_overall(table).first() or {}) and rollup.best_overall(table).first().asDict()
    whole = rollup.with_totals(table).orderBy(F.col("run").startswith("TOTAL"), "run")
    whole.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/summary.csv")  # a row a run
    lines = [r.asDict() for r in whole.collect()]
    spark.createDataFrame([(page("Runs", {k: v for k, v in notes.items() if v}, lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary.html")
    return whole, notes, best


def explain(found: DataFrame, threshold: float) -> list[str]:
    """In plain words: how many signals there were, why they were set aside, and what is left."""
    from .score import REASONS, set_aside

    x = set_aside(found.withColumns({c: F.lit(None).cast(t) for c, t in (("cadence", "string"), ("multi_target", "boolean")) if c not in found.columns}))
    n = {r["reason"]: r["count"] for r in x.groupBy("reason").count().collect()}
    if not n:
        return [f"Nothing rose above a signal to noise of {threshold:g}."]
    lines = [f"{sum(n.values())} signals rose above a signal to noise of {threshold:g}."]
    lines += [f"  {n[k]}: {k.replace('_', ' ')}" for k in REASONS if k in n]
    return [*lines, f"{n.get(None, 0)} passed every check." if n.get(None) else "All have an ordinary explanation."]
