"""The search as a stream: new files are searched once, failures are counted, and a restart goes on from there."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SearchConfig
from ..operators import learn
from ..operators import ledger as ledger_ops
from ..operators.rfi import multi_target
from ..operators.search import HITS, candidates, cut, searched
from ..sources import filterbank


def name_of(folder: str, location: str = "location") -> Column:
    """What a file of a folder is called in the ledger: its path below the folder, without .fil unless that would leave
    the name of another kind of file."""
    below = F.when(F.col(location).startswith(f"{folder.rstrip('/')}/"), F.expr(f"substring({location}, {len(folder.rstrip('/')) + 2})")).otherwise(F.col(location))
    return F.regexp_replace(below, r"(?<![.]fil|[.]h5|[.]hdf5)[.]fil$", "")


def crunch(spark: SparkSession, folder: str, out: str, cfg: SearchConfig = SearchConfig(), nfine: int | None = None, pad: int | None = None, forever_every: str | None = None) -> StreamingQuery:
    """Searches each new file of a folder as analyze does: guard bands and fine channels by its header, the model that
    the settings name. Batches write to folders by their number, so one that is run again after a failure overwrites
    itself. forever_every: how often to look (else what is there now, once)."""
    filterbank.register(spark)
    units = spark.readStream.format("filterbank").options(**cut(cfg) | ({} if pad is None else {"pad": str(pad)})).option("path", folder).load()

    def batch(df: DataFrame, n: int) -> None:
        session = df.sparkSession
        searched(df, cfg, nfine).write.mode("overwrite").parquet(f"{out}/hits/batch={n}")
        hits = session.read.schema(HITS).parquet(f"{out}/hits/batch={n}")
        model, why = learn.load(session, cfg.model_path) if cfg.use_ai else (None, "switched off")
        candidates(hits, cfg, model, run=f"batch{n}").withColumn("ai_note", F.lit(why and f"hits have no classes: {why}").cast("string")).write.mode("overwrite").parquet(f"{out}/candidates/batch={n}")
        hits.groupBy(name_of(folder).alias("obs")).agg(F.count_distinct("unit_id").alias("units"), F.count_if(F.col("error").isNotNull()).alias("errors")).write.mode("overwrite").parquet(f"{out}/ledger/batch={n}")

    w = units.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint")
    return (w.trigger(processingTime=forever_every) if forever_every else w.trigger(availableNow=True)).start()


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not yet written
        return spark.createDataFrame([], schema)


PROGRESS, FAILURES, SIGNALS = "obs string, nchans long, cursor long", "obs string, visit long, error string", "obs string, seq long, rank int, frequency_mhz double, target string, interest double"


def visit(spark: SparkSession, folder: str, out: str, cfg: SearchConfig = SearchConfig(), limit: int = 1000, max_units: int | None = None) -> DataFrame:
    """One visit: up to `limit` files that aren't done or given up, of each up to `max_units` units from where the last
    visit stopped, all of them in one job. Progress, failures, signals and candidates are kept below out, by visit; a
    visit with errors doesn't move a file's cursor, and after three of them it is left alone. A candidate whose
    frequency other targets have too is marked. Files of one name in several folders are apart (see name_of).
    Returns (obs, start, stop, errors, hits)."""
    filterbank.register(spark)
    heads = filterbank.header_table(spark, folder).withColumn("obs", name_of(folder))
    progress, failures = _kept(spark, f"{out}/progress", PROGRESS), _kept(spark, f"{out}/failures", FAILURES)
    number = (failures.select("visit").union(_kept(spark, f"{out}/visits", "visit long")).agg(F.max("visit")).first()[0] or 0) + 1
    cursor = progress.groupBy("obs").agg(F.max("cursor").alias("cursor"))
    files = heads.join(cursor, "obs", "left").join(ledger_ops.given_up(failures).select("obs"), "obs", "left_anti").withColumn("nchans", F.coalesce("nchans", F.lit(1)))
    todo = ledger_ops.next_range(files.select("obs", "nchans", "cursor"), max_units or 1 << 20, cfg.channels_per_unit).join(files.select("obs", "location", "nchans", "source_name"), "obs")
    todo = todo.orderBy(F.col("start") > 0, "obs").limit(limit)
    ranges = {r["location"]: [r["start"], r["stop"]] for r in todo.collect()}  # a row a file of this visit
    todo = spark.createDataFrame([(k, *v) for k, v in ranges.items()], "location string, start long, stop long").join(files.select("obs", "location", "nchans", "source_name"), "location")
    units = spark.read.format("filterbank").options(**cut(cfg), lenient="true", ranges=json.dumps(ranges)).load(folder)
    searched(units, cfg).write.mode("overwrite").parquet(f"{out}/hits/visit={number}")
    hits = spark.read.schema(HITS).parquet(f"{out}/hits/visit={number}").withColumn("obs", name_of(folder))
    sums = hits.groupBy("obs").agg(F.count_if(F.col("error").isNotNull()).cast("int").alias("errors"), F.count("channel").cast("int").alias("hits"), F.min("error").alias("error"))
    todo.join(sums, "obs", "left").select("obs", "start", "stop", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("hits", F.lit(0)).alias("hits"), F.col("source_name").alias("target"), "nchans", "error").write.mode("overwrite").parquet(f"{out}/seen/visit={number}")
    seen = spark.read.parquet(f"{out}/seen/visit={number}")
    model, _ = learn.load(spark, cfg.model_path) if cfg.use_ai else (None, "")
    found = candidates(hits, cfg, model, run=F.col("obs")).join(seen.select("obs", "target"), "obs")
    found.write.mode("overwrite").parquet(f"{out}/scored/visit={number}")
    found = spark.read.schema(found.schema).parquet(f"{out}/scored/visit={number}")
    old = _kept(spark, f"{out}/signals", SIGNALS)
    both = ledger_ops.remembered(old).select("frequency_mhz", "target").union(found.select("frequency_mhz", "target"))
    multi_target(found.drop("multi_target"), both, cfg.multi_target_tol_khz, cfg.multi_target_band_khz, cfg.multi_target_band_hits).write.mode("overwrite").parquet(f"{out}/candidates/batch={number}")
    strong = found.withColumn("rank", F.row_number().over(Window.partitionBy("obs").orderBy(F.desc("interest"), "hit_id"))).where(F.col("rank") <= ledger_ops.PER_OBSERVATION)
    strong.select("obs", F.lit(number).cast("long").alias("seq"), F.col("rank").cast("int").alias("rank"), "frequency_mhz", "target", "interest").write.mode("append").parquet(f"{out}/signals")
    progress = ledger_ops.advanced(files.select("obs", "nchans", "cursor"), seen.select("obs", "stop", "errors"))
    progress.select("obs", "nchans", "cursor").write.mode("append").parquet(f"{out}/progress")
    seen.where("errors > 0").select("obs", F.lit(number).cast("long").alias("visit"), "error").write.mode("append").parquet(f"{out}/failures")
    spark.createDataFrame([(number,)], "visit long").write.mode("append").parquet(f"{out}/visits")
    return seen.select("obs", "start", "stop", "errors", "hits")


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """Observations that have been searched, with their units and errors."""
    return spark.read.parquet(f"{out}/ledger").groupBy("obs").agg(F.sum("units").alias("units"), F.sum("errors").alias("errors"), F.max("batch").alias("batch"))


def best_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The best candidate of all batches: drifting ones first, then by interest and strength."""
    c = spark.read.parquet(f"{out}/candidates")
    best = F.max_by(F.struct("hit_id", "frequency_mhz", "drift_rate_hz_s", "interest"), F.struct(~F.col("stationary"), "interest", "snr")).alias("b")
    return c.agg(best).select("b.*")


def windowed_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and means of an event stream (ts, event_type, value) in tumbling windows; rows that come later than
    `late` behind the newest are left out, and state before that is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
