"""The test tables seen as what the search works on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KNOWN_BANDS_MHZ
from ..functions.exprs import in_bands
from ..operators.ordering import numbered
from ..operators.rfi import mirror_channel
from ..operators.score import stationary

N_T, N_F, NFINE = 16, 64, 1024


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """16 consecutive embeddings are an observation of 16 samples and 64 channels; incomplete ones are left out."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / N_T).alias("obs"), (F.col("vec_id") % N_T).cast("int").alias("t"), "embedding")
    whole = e.groupBy("obs").agg(F.count("*").alias("n")).where(F.col("n") == N_T).select("obs")
    return e.join(whole, "obs", "left_semi").select("obs", "t", F.posexplode("embedding").alias("c", "z")).withColumn("z", F.col("z").cast("double"))


SAMPLES = """samples AS (SELECT vec_id // 16 AS obs, CAST(vec_id % 16 AS INTEGER) AS t, CAST(i - 1 AS INTEGER) AS c, CAST(embedding[i] AS DOUBLE) AS z
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id // 16 IN (SELECT vec_id // 16 FROM embeddings GROUP BY 1 HAVING count(*) = 16))"""


def event_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Values of events by six hours and user modulo 64, zero where there are none."""
    e = table(spark, d, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600).alias("h"), (F.col("user_id") % 64).cast("int").alias("c"), "value")
    low = e.agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    got = e.groupBy("h", "c").agg(F.sum("value").alias("z"))
    grid = low.select(F.explode(F.sequence("h0", "h1")).alias("h"), "h0").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return grid.join(got, ["h", "c"], "left").select(F.lit(0).alias("obs"), (F.col("h") - F.col("h0")).cast("int").alias("t"), "c", F.round(F.coalesce("z", F.lit(0.0)), 6).alias("z"))


EVENTS = """evt0 AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS h, CAST(user_id % 64 AS INTEGER) AS c, value FROM events),
    evt AS (SELECT 0 AS obs, CAST(h.h - (SELECT min(h) FROM evt0) AS INTEGER) AS t, CAST(c.c AS INTEGER) AS c, round(coalesce(z, 0.0), 6) AS z
    FROM (SELECT unnest(range((SELECT min(h) FROM evt0), (SELECT max(h) FROM evt0) + 1)) AS h) h, (SELECT unnest(range(0, 64)) AS c) c
    LEFT JOIN (SELECT h, c, sum(value) AS z FROM evt0 GROUP BY 1, 2) g ON g.h = h.h AND g.c = c.c)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as hits of eight files and six scans."""
    o, k, u = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    h = o.select(
        k.alias("hit_id"), (k % 6).cast("int").alias("scan_no"), (k % 2 == 0).alias("is_on"), F.concat(F.lit("T"), (u % 8).cast("string")).alias("target"), F.concat(F.lit("T"), (u % 8).cast("string")).alias("file"),
        (F.lit(1000.0) + F.col("o_totalprice") / 1000.0).alias("frequency_mhz"), ((k % 41 - 20) / 10.0).alias("drift"), ((k % 41 - 20) / 10.0).alias("drift_rate_hz_s"), (F.lit(10.0) + (u % 500) / 5.0).alias("snr"), ((k * 7919) % 65536).alias("channel"),
        (u % 12).cast("double").alias("bandwidth_ch"), ((k % 9) / 8.0).alias("on_fraction"), F.when(k % 10 != 0, (k % 100) / 100.0).alias("anomaly"),
        F.when(k % 7 != 0, (k % 97) / 97.0).alias("p_technosignature_like"), ((k % 89) / 89.0).alias("p_rfi_zero_drift"), ((k % 83) / 83.0).alias("p_noise"), (k % 13 == 0).alias("drift_unresolved"), F.when(k % 5 == 0, "failed").when(k % 3 == 0, "passed").otherwise("not_run").alias("cadence"), (k % 11 == 0).alias("synthetic"))
    h = h.withColumns({"mirror_channel": mirror_channel(NFINE), "stationary": stationary(N_T), "known_rfi_band": in_bands("frequency_mhz", KNOWN_BANDS_MHZ), "mirror_image": F.col("hit_id") % 17 == 0, "multi_target": F.col("hit_id") % 19 == 0})
    return h


_bands = " OR ".join(f"frequency_mhz BETWEEN {lo} AND {hi}" for lo, hi in KNOWN_BANDS_MHZ)
HITS = f"""h0 AS (SELECT o_orderkey AS hit_id, CAST(o_orderkey % 6 AS INTEGER) AS scan_no, o_orderkey % 2 = 0 AS is_on, 'T' || (o_custkey % 8) AS target, 'T' || (o_custkey % 8) AS file,
    1000.0::DOUBLE + o_totalprice / 1000.0::DOUBLE AS frequency_mhz, (o_orderkey % 41 - 20) / 10.0::DOUBLE AS drift, (o_orderkey % 41 - 20) / 10.0::DOUBLE AS drift_rate_hz_s, 10.0::DOUBLE + (o_custkey % 500) / 5.0::DOUBLE AS snr, (o_orderkey * 7919) % 65536 AS channel,
    CAST(o_custkey % 12 AS DOUBLE) AS bandwidth_ch, (o_orderkey % 9) / 8.0::DOUBLE AS on_fraction, CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS anomaly,
    CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 97) / 97.0::DOUBLE END AS p_technosignature_like, (o_orderkey % 89) / 89.0::DOUBLE AS p_rfi_zero_drift, (o_orderkey % 83) / 83.0::DOUBLE AS p_noise, o_orderkey % 13 = 0 AS drift_unresolved,
    CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'passed' ELSE 'not_run' END AS cadence, o_orderkey % 11 = 0 AS synthetic FROM orders),
    hits AS (SELECT *, (channel // 1024 * 1024 + 512) * 2 - channel AS mirror_channel, abs(drift) * 15 <= 1 + 1e-6::DOUBLE AS stationary, {_bands} AS known_rfi_band, hit_id % 17 = 0 AS mirror_image, hit_id % 19 = 0 AS multi_target FROM h0)"""


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as file headers of several products."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return p.select(
        k.alias("file_id"), F.concat(F.lit("scan_"), k.cast("string")).alias("stem"), (F.lit(1000.0) + k % 900).alias("fch1"),
        F.element_at(F.array(F.lit(-2.7939677238464355e-06), F.lit(-2.86102294921875e-03), F.lit(0.25), F.lit(-0.5)), (k % 4 + 1).cast("int")).alias("foff"),
        F.element_at(F.array(F.lit(18.253611008), F.lit(1.0737418239999998), F.lit(1e-4)), (k % 3 + 1).cast("int")).alias("tsamp"),
        F.element_at(F.array(*[F.lit(x).cast("long") for x in (1048576, 65536, 4096, 300, 2097152)]), (k % 5 + 1).cast("int")).alias("nchans"), F.element_at(F.array(*[F.lit(x).cast("long") for x in (16, 272, 1)]), (k % 3 + 1).cast("int")).alias("nsamples"))


HEADERS = """headers AS (SELECT p_partkey AS file_id, 'scan_' || p_partkey AS stem, 1000.0::DOUBLE + p_partkey % 900 AS fch1,
    ([-2.7939677238464355e-06::DOUBLE, -2.86102294921875e-03::DOUBLE, 0.25::DOUBLE, -0.5::DOUBLE])[p_partkey % 4 + 1] AS foff, ([18.253611008::DOUBLE, 1.0737418239999998::DOUBLE, 1e-4::DOUBLE])[p_partkey % 3 + 1] AS tsamp,
    CAST(([1048576, 65536, 4096, 300, 2097152])[p_partkey % 5 + 1] AS BIGINT) AS nchans, CAST(([16, 272, 1])[p_partkey % 3 + 1] AS BIGINT) AS nsamples FROM part)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders of every fifty customers as runs; their own numbers as what a run reports."""
    o = table(spark, d, "orders").withColumn("run", F.format_string("run%02d", F.col("o_custkey") % 50))
    return o.groupBy("run").agg(
        F.count("*").alias("work_units"), F.count_if(F.col("o_orderkey") % 97 == 0).alias("errors"), F.sum(F.col("o_orderkey") % 1000).alias("channels"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("hits"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("spikes"), F.count_if(F.col("o_orderkey") % 5 == 0).alias("pulses"),
        F.round(F.sum("o_totalprice") / 1000, 2).alias("cpu_seconds"), F.round(F.max("o_totalprice") / 1000, 2).alias("wall_seconds"), F.round(F.avg("o_totalprice") / 50000, 4).alias("drift_searched_hz_s"), F.lit(3.0).alias("max_drift_rate_hz_s"), F.when(F.max("o_custkey") % 4 == 0, "no classifier").otherwise("").alias("ai_note"))


RUNS = """runs AS (SELECT printf('run%02d', o_custkey % 50) AS run, count(*) AS work_units, count_if(o_orderkey % 97 = 0) AS errors, CAST(sum(o_orderkey % 1000) AS BIGINT) AS channels, count_if(o_orderkey % 2 = 0) AS hits, count_if(o_orderkey % 3 = 0) AS spikes, count_if(o_orderkey % 5 = 0) AS pulses,
    round(sum(o_totalprice) / 1000, 2) AS cpu_seconds, round(max(o_totalprice) / 1000, 2) AS wall_seconds, round(avg(o_totalprice) / 50000, 4) AS drift_searched_hz_s, 3.0::DOUBLE AS max_drift_rate_hz_s, CASE WHEN max(o_custkey) % 4 = 0 THEN 'no classifier' ELSE '' END AS ai_note FROM orders GROUP BY 1)"""


def ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, done, failures, partial) of observations, from orders by status and customer."""
    o = table(spark, d, "orders")
    rows = numbered(o.select(F.col("o_orderkey").alias("obs")), ["obs"], "place")
    done = o.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("obs"))
    failures = o.where("o_orderstatus = 'O'").select((F.col("o_custkey") % 400).alias("obs"))
    partial = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("obs"))
    return rows, done, failures, partial


LEDGER = """rows_ AS (SELECT o_orderkey AS obs, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders),
    done AS (SELECT o_orderkey AS obs FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0), failures AS (SELECT o_custkey % 400 AS obs FROM orders WHERE o_orderstatus = 'O'),
    partial AS (SELECT o_orderkey AS obs FROM orders WHERE o_orderkey % 3 = 0)"""
