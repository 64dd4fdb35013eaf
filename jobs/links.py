"""An inventory of what crawled archive pages and folder listings link to, kept up to date as pages come.

    python -m jobs.links --pages FOLDER --out FOLDER [--config FILE]

Pages (url, html) are read as a stream of Parquet files with a checkpoint below the output, so a run takes only
files that no run has taken. Each batch adds one part of counts, a row a link, in a folder of its own that a
repeated batch replaces. Links lie in shards by their address. After the stream the shards that new batches
touched are summed up from their parts and replaced; the highest batch that has been summed up is kept as a mark,
written last, so a run that breaks off is made up for by the next one. A run without new files changes nothing.

The inventory has a row for each address: how many pages link to it, the first such page by number, the host,
suffix and kind, and for scans the object and day that their name tells. A page counts once for each address.
Pages without html have no links; links of a page without an address of its own count where they are full
addresses. The number of shards stays what the first run had.
"""

from __future__ import annotations

import argparse
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.sources import crawl

from .common import log, session, settings

COLUMNS = ("link", "host", "suffix", "kind", "object", "mjd", "n_pages", "first_page")
PARTS = "link string, n_pages long, first_page long, batch long, shard int"
INVENTORY = "link string, host string, suffix string, kind string, object string, mjd double, n_pages long, first_page long, shard int"
STATE = "batch long, shards int"


def links(pages: DataFrame, cfg: dict) -> DataFrame:
    """(link, n_pages, first_page, shard) of pages."""
    col = {k: F.expr(v) for k, v in cfg["columns"].items()}
    p = pages.select(F.coalesce(col["url"], F.lit("")).alias("url"), col["html"].alias("html"), col["page"].cast("long").alias("page"))
    each = F.array_distinct(F.transform(crawl.hrefs(F.col("html")), lambda h: crawl.resolved(h, F.col("url"))))
    found = p.select(F.explode(each).alias("link"), "page").where("link IS NOT NULL")
    return found.groupBy("link").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page")).withColumn("shard", F.pmod(F.xxhash64("link"), F.lit(cfg["shards"])).cast("int"))


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def inventory(spark: SparkSession, out: str) -> DataFrame:
    """The inventory as it stands."""
    return _kept(spark, f"{out}/inventory", INVENTORY).select(*COLUMNS)


def run(spark: SparkSession, pages_path: str, out: str, cfg: dict | None = None) -> DataFrame:
    """Takes the pages that are new at pages_path into the inventory below out, and returns it as it stands."""
    cfg, say = cfg or settings("links"), log("links")
    pages_path = pages_path.rstrip("/")
    mark, shards = _kept(spark, f"{out}/marks", STATE).agg(F.max("batch"), F.max("shards")).first()
    if shards not in (None, cfg["shards"]):
        raise ValueError(f"the inventory at {out} has {shards} shards, not {cfg['shards']}")
    schema = spark.read.parquet(pages_path).schema
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", cfg["files_per_trigger"]).parquet(f"{pages_path[:-1]}[{pages_path[-1]}]")  # as a pattern, a file or a folder

    def batch(df: DataFrame, n: int) -> None:
        # a batch that is run again writes its folder anew
        links(df, cfg).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/parts/batch={n}")

    query = pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [json.loads(p.json) for p in query.recentProgress]
    say.info("read %d new pages from %s in %d batches", sum(p["numInputRows"] for p in taken), pages_path, sum(p["numInputRows"] > 0 for p in taken))

    parts = _kept(spark, f"{out}/parts", PARTS)
    new = parts.where(F.col("batch") > F.lit(-1 if mark is None else mark))
    touched = [r["shard"] for r in new.select("shard").distinct().collect()]  # at most as many as there are shards
    last = new.agg(F.max("batch")).first()[0]
    if last is None:
        say.info("wrote nothing: no links since batch %s", mark)
        return inventory(spark, out)
    total = parts.where(F.col("shard").isin(touched) & (F.col("batch") <= last)).groupBy("shard", "link").agg(F.sum("n_pages").alias("n_pages"), F.min("first_page").alias("first_page"))
    rows = total.withColumns(crawl.described(F.col("link"), cfg["observation_suffixes"])).select(*COLUMNS, "shard")
    rows.hint("rebalance", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{out}/inventory")
    spark.createDataFrame([(last, cfg["shards"])], STATE).write.mode("append").parquet(f"{out}/marks")
    now = inventory(spark, out)
    say.info("wrote %d of %d shards up to batch %d to %s/inventory, which has %d links now", len(touched), cfg["shards"], last, out, now.count())
    return now


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.links", description="Inventory of what crawled pages link to")
    p.add_argument("--pages", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = session("links")
    try:
        run(spark, a.pages, a.out, settings("links", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
