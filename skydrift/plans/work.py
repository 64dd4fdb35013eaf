"""Queries over files, runs and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.exprs import file_stem, mjd_to_timestamp
from ..operators import axis, ledger, rollup
from ..sources import archive
from ..sources.shared import new_folder
from ..streaming import state
from .registry import query
from .results import CLASSED, classed
from .views import HEADERS, LEDGER, RUNS, headers, runs, table
from .views import ledger as books

CFG = SearchConfig()
H = "WITH " + HEADERS
CEIL = "CAST(greatest(1, least(CASE WHEN foff <> 0 THEN ceil(4.0::DOUBLE * tsamp / (abs(foff) * 1e6)) ELSE 1 END, 32)) AS BIGINT)"
PAD = f"({CEIL} * greatest(nsamples, 1) + 8)"


@query(H + " SELECT file_id, round(least(fch1, fch1 + foff * (nchans - 1)), 6) AS f_min, round(greatest(fch1, fch1 + foff * (nchans - 1)), 6) AS f_max, round(fch1 + foff * (nchans // 3), 6) AS f_third FROM headers")
def frequency_axis(spark: SparkSession, d: str) -> DataFrame:
    return axis.band_edges(headers(spark, d)).select("file_id", F.round("f_min", 6).alias("f_min"), F.round("f_max", 6).alias("f_max"), F.round(axis.frequency(F.floor(F.col("nchans") / 3)), 6).alias("f_third"))


@query(H + """, p AS (SELECT *, 2.9296875e6::DOUBLE / abs(foff * 1e6::DOUBLE) AS n FROM headers), q AS (SELECT *, CAST(CASE WHEN n > 1 THEN round_even(log2(n), 0) ELSE 0 END AS INTEGER) AS p FROM p)
    SELECT file_id, CASE WHEN p > 0 AND abs(pow(2, p) - n) / n < 0.01 AND nchans % CAST(pow(2, p) AS BIGINT) = 0 THEN CAST(pow(2, p) AS BIGINT) END AS nfine FROM q""")
def fine_per_coarse(spark: SparkSession, d: str) -> DataFrame:
    return headers(spark, d).select("file_id", axis.fine_per_coarse().alias("nfine"))


@query(H + """, b AS (SELECT *, fch1 + foff * nchans * 0.25::DOUBLE AS lo, fch1 + foff * nchans * 0.5::DOUBLE + 0.001::DOUBLE AS hi FROM headers), r AS (SELECT *, (lo - fch1) / foff AS a, (hi - fch1) / foff AS z FROM b),
    c AS (SELECT file_id, greatest(0, least(nchans, CAST(floor(least(a, z)) AS BIGINT))) AS c0, greatest(0, least(nchans, CAST(ceil(greatest(a, z)) AS BIGINT) + 1)) AS c1 FROM r) SELECT file_id, c0, greatest(c0, c1) AS c1 FROM c""")
def freq_to_channel(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.col("fch1") + F.col("foff") * F.col("nchans") * 0.25, F.col("fch1") + F.col("foff") * F.col("nchans") * 0.5 + 0.001
    c0, c1 = axis.channel_range(lo, hi)
    return headers(spark, d).select("file_id", c0.alias("c0"), c1.alias("c1"))


@query(H + f" SELECT file_id, {CEIL} AS ceiling, {PAD} AS pad, foff = 0 OR 4.0::DOUBLE * nsamples * tsamp >= abs(foff) * 1e6 AS resolvable, ceil(least(least(262144, nchans) + 2 * {PAD}, nchans) * nsamples * 4 / 1048576.0::DOUBLE) > 2048 AS too_large FROM headers")
def drift_padding(spark: SparkSession, d: str) -> DataFrame:
    return headers(spark, d).select("file_id", axis.drift_ceiling(CFG).alias("ceiling"), axis.padding(CFG).alias("pad"), axis.drift_resolvable(CFG).alias("resolvable"), axis.unit_too_large(CFG).isNotNull().alias("too_large"))


@query(H + """, l AS (SELECT *, CASE WHEN foff <> 0 THEN abs(4.0::DOUBLE * tsamp / (abs(foff) * 1e6)) ELSE 1.0::DOUBLE END AS need FROM headers WHERE abs(foff) * 1e6 * tsamp <= 1e6), m AS (SELECT *, least(greatest(0, CAST(ceil(need) AS BIGINT) - 1), 31) AS cfg FROM l), k AS (SELECT *, least(cfg, greatest(0, nchans // greatest(nsamples, 1) - 1)) AS k_max FROM m)
    SELECT file_id, round(need, 6) AS k_needed, cfg AS k_config, k_max, round(CASE WHEN foff = 0 OR tsamp = 0 THEN 4.0::DOUBLE ELSE least(4.0::DOUBLE, (k_max + 1) * abs(foff) * 1e6 / tsamp) END, 6) AS searched_hz_s, k_max < cfg AS degraded FROM k""")
def drift_limits(spark: SparkSession, d: str) -> DataFrame:
    h = headers(spark, d).where(F.abs("foff") * 1e6 * F.col("tsamp") <= 1e6).withColumns({"n_t": F.col("nsamples"), "n_f": F.col("nchans")})
    return axis.drift_limits(h, 4.0, 32).select("file_id", F.round("k_needed", 6).alias("k_needed"), "k_config", "k_max", F.round("searched_hz_s", 6).alias("searched_hz_s"), "degraded")


@query(H + f""", u AS (SELECT *, {PAD} AS pad, unnest(range(0, nchans, 262144)) AS core_start FROM headers), v AS (SELECT *, least(core_start + 262144, nchans) AS core_stop FROM u) SELECT stem || ':' || core_start || '-' || core_stop AS unit_id, core_start, core_stop, greatest(0, core_start - pad) AS chan_start, least(nchans, core_stop + pad) AS chan_stop FROM v""")
def split_units(spark: SparkSession, d: str) -> DataFrame:
    h = headers(spark, d).withColumns({"c0": F.lit(0).cast("long"), "c1": F.col("nchans")})
    return axis.split_units(h, CFG).select("unit_id", "core_start", "core_stop", "chan_start", "chan_stop")


@query("WITH " + LEDGER + ", g AS (SELECT obs, count(*) AS attempts FROM failures GROUP BY 1) SELECT obs, attempts FROM g WHERE attempts >= 3")
def failure_giveup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.given_up(books(spark, d)[2])


@query("WITH " + LEDGER + ", skip AS (SELECT obs FROM done UNION SELECT obs FROM (SELECT obs, count(*) AS n FROM failures GROUP BY 1) WHERE n >= 3) SELECT obs FROM rows_ WHERE obs NOT IN (SELECT obs FROM skip)")
def ledger_skip(spark: SparkSession, d: str) -> DataFrame:
    rows, done, failures, _ = books(spark, d)
    return ledger.not_skipped(rows, ledger.skip_set(done, failures)).select("obs")


@query("WITH " + LEDGER + """, new AS (SELECT r.obs, place, p.obs IS NOT NULL AS begun FROM rows_ r LEFT JOIN partial p ON p.obs = r.obs WHERE r.obs NOT IN (SELECT obs FROM done)),
    sizes AS (SELECT unnest([20, 80, 320, 1280, 2000]) AS n), ok AS (SELECT n, (SELECT count(*) FROM new WHERE place <= n) AS a, (SELECT count(*) FROM new WHERE place <= n AND NOT begun) AS f, (SELECT count(*) FROM rows_) AS total FROM sizes),
    pick AS (SELECT min(n) AS n FROM ok WHERE (a >= 20 AND f >= 10) OR total < n OR n = 2000), got AS (SELECT *, row_number() OVER (PARTITION BY begun ORDER BY place) AS r FROM new WHERE place <= (SELECT n FROM pick)),
    o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN NOT begun AND r <= 10 THEN 0 WHEN begun THEN 1 ELSE 2 END, r) AS slot FROM got WHERE r <= 20) SELECT obs, begun, slot FROM o WHERE slot <= 20""")
def query_widening(spark: SparkSession, d: str) -> DataFrame:
    rows, done, _, partial = books(spark, d)
    return ledger.widened(rows, done, partial, 20).withColumn("slot", F.col("slot").cast("long"))


PROGRESS = "pg AS (SELECT c_custkey AS obs, 65536 + c_custkey % 7 * 8192 AS nchans, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 12 * 8192 END AS cursor_ FROM customer)"


def _progress(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("obs"), (k % 7 * 8192 + 65536).alias("nchans"), F.when(k % 3 > 0, k % 12 * 8192).alias("cursor"))


@query("WITH " + PROGRESS + " SELECT obs, coalesce(cursor_, 0) AS start, least(coalesce(cursor_, 0) + 16384, nchans) AS stop FROM pg WHERE coalesce(cursor_, 0) < nchans")
def resume_range(spark: SparkSession, d: str) -> DataFrame:
    return ledger.next_range(_progress(spark, d), 2, 8192)


@query("WITH " + PROGRESS + """, vs AS (SELECT obs, least(coalesce(cursor_, 0) + 16384, nchans) AS stop, obs % 5 = 0 AS bad FROM pg WHERE coalesce(cursor_, 0) < nchans), n AS (SELECT pg.obs, nchans, greatest(coalesce(cursor_, 0), coalesce(CASE WHEN NOT bad THEN stop END, 0)) AS "cursor" FROM pg LEFT JOIN vs ON vs.obs = pg.obs)
    SELECT obs, nchans, "cursor", "cursor" >= nchans AS done FROM n""")
def advance_cursor(spark: SparkSession, d: str) -> DataFrame:
    p = _progress(spark, d)
    visits = ledger.next_range(p, 2, 8192).withColumn("errors", F.when(F.col("obs") % 5 == 0, 1).otherwise(0))
    return ledger.advanced(p, visits)


SIGNALS = "sg AS (SELECT o_custkey AS obs, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)"


@query("WITH " + SIGNALS + " SELECT obs, seq FROM (SELECT *, row_number() OVER (ORDER BY seq DESC, rank DESC, obs DESC) AS r FROM sg WHERE rank <= 5) WHERE r <= 1000")
def remembered_signals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("obs"), F.col("o_orderkey").alias("seq"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return ledger.remembered(s, 5, 1000).select("obs", "seq")


@query("SELECT 'v1' AS scoring_version, o_orderkey AS obs, o_totalprice AS interest FROM orders WHERE o_custkey % 2 = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def lifetime_best(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("interest"), F.concat(F.lit("v"), (F.col("o_custkey") % 2).cast("string")).alias("scoring_version"))
    return ledger.lifetime_best(r, "v1")


@query("SELECT o_orderkey AS unit, sha1(o_orderkey || '|' || o_orderstatus) AS key FROM orders WHERE o_orderkey % 4 <> 0")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), "o_orderkey", "o_orderstatus").withColumn("key", ledger.cache_key(["o_orderkey", "o_orderstatus"]))
    return ledger.misses(o.select("unit", "key"), o.where("unit % 4 = 0"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        k.alias("unit"), (k % 50).alias("run"), (F.col("l_suppkey") % 8).alias("pid"), F.when(k % 101 == 0, "timeout").alias("error"), (k % 1000 + 24).alias("n_channels"), F.col("l_linenumber").cast("long").alias("n_hits"), (k % 7).alias("n_spikes"), F.least(k % 7, k % 3).alias("n_isolated"),
        F.col("l_quantity").alias("cpu_seconds"), (F.lit(4.0) - F.col("l_discount")).alias("searched"), F.create_map(F.lit("load"), F.col("l_quantity") * 0.5, F.lit("search"), F.col("l_quantity") * 0.25, F.lit("score"), F.col("l_tax")).alias("timings"), (k % 4).cast("int").alias("pass_no"), F.lit(16).alias("n_t"), (F.col("l_quantity") + 1).alias("seconds"))


UNITS = """units AS (SELECT l_orderkey AS unit, l_orderkey % 50 AS run, l_suppkey % 8 AS pid, CASE WHEN l_orderkey % 101 = 0 THEN 'timeout' END AS error, l_orderkey % 1000 + 24 AS n_channels, CAST(l_linenumber AS BIGINT) AS n_hits, l_orderkey % 7 AS n_spikes, least(l_orderkey % 7, l_orderkey % 3) AS n_isolated,
    l_quantity AS cpu_seconds, 4.0::DOUBLE - l_discount AS searched, l_tax, CAST(l_orderkey % 4 AS INTEGER) AS pass_no, l_quantity + 1 AS seconds FROM lineitem)"""


@query("WITH " + UNITS + """ SELECT run, count(*) AS work_units, count(error) AS errors, CAST(sum(n_channels) AS BIGINT) AS channels, CAST(sum(n_hits) AS BIGINT) AS hits, CAST(sum(n_isolated) AS BIGINT) AS spikes, CAST(sum(n_spikes) - sum(n_isolated) AS BIGINT) AS spikes_on_tones, round(sum(cpu_seconds), 2) AS cpu_seconds, count(DISTINCT pid) AS workers, round(min(searched), 6) AS drift_searched_hz_s FROM units GROUP BY 1""")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return rollup.run_stats(_units(spark, d), ("run",)).withColumn("drift_searched_hz_s", F.round("drift_searched_hz_s", 6))


@query("WITH " + UNITS + " SELECT stage, round(sum(s), 4) AS seconds FROM (SELECT 'load' AS stage, cpu_seconds * 0.5::DOUBLE AS s FROM units UNION ALL SELECT 'search', cpu_seconds * 0.25::DOUBLE FROM units UNION ALL SELECT 'score', l_tax FROM units) GROUP BY 1")
def stage_seconds(spark: SparkSession, d: str) -> DataFrame:
    return rollup.stage_seconds(_units(spark, d)).withColumn("seconds", F.round("seconds", 4))


@query("WITH " + UNITS + " SELECT pass_no, count(*) AS units, round(sum(n_channels * 16 * 4) / 1048576.0::DOUBLE, 6) AS mb, round(sum(n_channels * 16 * 4) / 1048576.0::DOUBLE / sum(seconds), 6) AS mb_per_s, count(error) AS gave_up FROM units GROUP BY 1")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return rollup.throughput(_units(spark, d))


PER = "WITH " + RUNS + ", " + CLASSED[len("WITH "):] + """, cd AS (SELECT *, printf('run%02d', hit_id % 45) AS run FROM classed), bs AS (SELECT run, frequency_mhz, drift_rate_hz_s, snr, interest, ai_class, mirror_image, multi_target FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY interest DESC, hit_id) AS rn FROM cd) WHERE rn = 1),
    ec AS (SELECT run, count_if(ai_class = 'technosignature_like') AS et FROM cd GROUP BY 1), per AS (SELECT r.*, coalesce(drift_searched_hz_s < max_drift_rate_hz_s * 0.999::DOUBLE, false) AS drift_degraded, round(frequency_mhz, 6) AS best_frequency_mhz, drift_rate_hz_s AS best_drift_hz_s, snr AS best_snr, interest AS best_interest, ai_class AS best_ai_class,
    coalesce(mirror_image, false) AS best_mirror_image, coalesce(multi_target, false) AS best_multi_target, coalesce(et, 0) AS et_count FROM runs r LEFT JOIN bs ON bs.run = r.run LEFT JOIN ec ON ec.run = r.run)"""


def _per_run(spark: SparkSession, d: str) -> DataFrame:
    c = classed(spark, d).withColumn("run", F.format_string("run%02d", F.col("hit_id") % 45))
    return rollup.per_run(runs(spark, d), c).withColumn("best_frequency_mhz", F.round("best_frequency_mhz", 6))


@query(PER + " SELECT * FROM per")
def run_rows(spark: SparkSession, d: str) -> DataFrame:
    return _per_run(spark, d)


@query(PER + """, tot AS (SELECT 'TOTAL (' || count(*) || ' runs)' AS run, round(CAST(sum(work_units) AS DOUBLE), 2) AS work_units, round(CAST(sum(errors) AS DOUBLE), 2) AS errors, round(CAST(sum(channels) AS DOUBLE), 2) AS channels, round(CAST(sum(hits) AS DOUBLE), 2) AS hits, round(CAST(sum(spikes) AS DOUBLE), 2) AS spikes, round(CAST(sum(pulses) AS DOUBLE), 2) AS pulses, round(sum(cpu_seconds), 2) AS cpu_seconds, round(sum(wall_seconds), 2) AS wall_seconds, max(best_interest) AS best_interest, bool_or(drift_degraded) AS drift_degraded FROM per)
    SELECT run, CAST(work_units AS DOUBLE) AS work_units, CAST(errors AS DOUBLE) AS errors, CAST(channels AS DOUBLE) AS channels, CAST(hits AS DOUBLE) AS hits, CAST(spikes AS DOUBLE) AS spikes, CAST(pulses AS DOUBLE) AS pulses, cpu_seconds, wall_seconds, best_interest, drift_degraded, CAST(NULL AS DOUBLE) AS cpu_hours, CAST(NULL AS DOUBLE) AS wall_hours FROM per
    UNION ALL SELECT *, round_even(cpu_seconds / 3600 * 1000, 0) / 1000, round_even(wall_seconds / 3600 * 1000, 0) / 1000 FROM tot""")
def runs_totals(spark: SparkSession, d: str) -> DataFrame:
    return rollup.with_totals(_per_run(spark, d)).select("run", *rollup.TOTALS, "best_interest", "drift_degraded", "cpu_hours", "wall_hours")


@query(PER + " SELECT run, best_frequency_mhz, best_interest FROM per WHERE best_interest IS NOT NULL ORDER BY best_interest DESC, run LIMIT 1")
def best_overall(spark: SparkSession, d: str) -> DataFrame:
    return rollup.best_overall(_per_run(spark, d)).select("run", "best_frequency_mhz", "best_interest")


@query(PER + " SELECT count_if(errors > 0) AS with_errors, count_if(ai_note <> '') AS without_ai, count_if(drift_degraded) AS degraded, count_if(best_mirror_image OR best_multi_target) AS artefact_on_top FROM per")
def run_warnings(spark: SparkSession, d: str) -> DataFrame:
    return rollup.warnings(_per_run(spark, d))


@query(PER + " SELECT run, concat_ws(', ', CASE WHEN best_mirror_image THEN 'mirror' END, CASE WHEN best_multi_target THEN 'multi-target' END, CASE WHEN drift_degraded THEN 'drift degraded' END, CASE WHEN ai_note <> '' THEN 'AI inactive' END, CASE WHEN errors > 0 THEN 'failed units' END) AS flags FROM per")
def run_flags(spark: SparkSession, d: str) -> DataFrame:
    return _per_run(spark, d).select("run", rollup.run_flags().alias("flags"))


@query("SELECT run, best FROM (SELECT printf('run%02d', o_custkey % 50) AS run, max(o_totalprice) AS best FROM orders GROUP BY 1 ORDER BY best DESC NULLS LAST, run LIMIT 10)")
def top_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.format_string("run%02d", F.col("o_custkey") % 50).alias("run")).agg(F.max("o_totalprice").alias("best"))
    return o.orderBy(F.desc_nulls_last("best"), "run").limit(10)


LISTING = r"""ls AS (SELECT c_custkey % 40 AS folder, 'guppi_' || (58000 + c_custkey % 3) || '_' || lpad(CAST(10000 + c_custkey % 50000 AS VARCHAR), 5, '0') || '_' || CASE WHEN c_custkey % 80 < 40 THEN 'STAR' || (c_custkey % 40) ELSE 'OFF' || (c_custkey % 7) END || '_0001.gpuspec.' || CASE WHEN c_custkey % 11 = 0 THEN '0002' ELSE '0000' END || '.fil' AS name FROM customer),
    sc AS (SELECT DISTINCT folder, name, regexp_extract(name, 'guppi_([0-9]{5})_([0-9]{5})_(.+)_[0-9]{4}[.]gpuspec[.](.+)$', 3) AS target, CAST(regexp_extract(name, 'guppi_([0-9]{5})', 1) AS INTEGER) + CAST(regexp_extract(name, 'guppi_[0-9]{5}_([0-9]{5})', 1) AS INTEGER) / 86400.0::DOUBLE AS mjd FROM ls WHERE name LIKE '%gpuspec.0000.fil'),
    ct AS (SELECT folder, target, count(*) AS n FROM sc GROUP BY 1, 2), onn AS (SELECT folder, target AS on_target FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, target) AS rn, count(*) OVER (PARTITION BY folder) AS kinds FROM ct) WHERE rn = 1 AND n >= 2 AND kinds >= 2)"""


@query("WITH " + LISTING + " SELECT sc.folder, name, target, round(mjd, 6) AS mjd, target = on_target AS is_on FROM sc JOIN onn ON onn.folder = sc.folder")
def cadence_siblings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit('<a href="guppi_'), (k % 3 + 58000).cast("string"), F.lit("_"), F.lpad((k % 50000 + 10000).cast("string"), 5, "0"), F.lit("_"), F.when(k % 80 < 40, F.concat(F.lit("STAR"), (k % 40).cast("string"))).otherwise(F.concat(F.lit("OFF"), (k % 7).cast("string"))), F.lit("_0001.gpuspec."), F.when(k % 11 == 0, "0002").otherwise("0000"), F.lit('.fil">'))
    pages = table(spark, d, "customer").groupBy((k % 40).alias("folder")).agg(F.array_join(F.collect_list(name), "\n").alias("listing"))
    return archive.cadence_scans(pages, "0000.fil").select("folder", "name", "target", F.round("mjd", 6).alias("mjd"), "is_on")


@query("SELECT n_nationkey AS id, n_nationkey * 3 + n_nationkey % 5 AS ready, n_nationkey * 3 + n_nationkey % 5 > 0 AS distributing FROM nation")
def volunteer_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    xml = F.concat(F.lit("<results_ready_to_send>"), (k * 3).cast("string"), F.lit("</results_ready_to_send><x/><results_ready_to_send>"), (k % 5).cast("string"), F.lit("</results_ready_to_send>"))
    return archive.ready_to_send(table(spark, d, "nation").select(k.alias("id"), xml.alias("body"))).withColumn("ready", F.col("ready").cast("int"))


@query("SELECT o_orderkey AS id, 'scan_' || o_orderkey AS stem, epoch_us(CAST('1970-01-01' AS TIMESTAMP) + INTERVAL 1 SECOND * (1514764800 + (o_orderkey % 86400))) // 1000000 AS seconds FROM orders")
def url_and_time(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://archive.example.org/a/scan_"), k.cast("string"), F.lit(".fil?x=1"))
    when = mjd_to_timestamp(F.lit(58119.0) + (k % 86400) / 86400.0)
    return table(spark, d, "orders").select(k.alias("id"), file_stem(url).alias("stem"), F.round(F.unix_millis(when) / 1000).cast("long").alias("seconds"))


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
    SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    a, b = k.where("k % 2 = 0"), k.where("k % 3 = 0")
    parts = {"union": a.union(b).distinct(), "union_all": a.union(b), "difference": a.exceptAll(b).distinct(), "intersection": a.intersect(b)}
    out = None
    for name, p in parts.items():
        row = p.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH v AS (SELECT CAST(o_custkey AS VARCHAR) AS obs, o_orderkey AS seq, (o_orderkey % 9 + 1) * 100 AS stop, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS errors, 'v' || lpad(CAST(o_orderkey // 10000 AS VARCHAR), 6, '0') AS version,
      CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000, 0) END AS interest FROM orders),
    n AS (SELECT obs, count(*) AS visits, coalesce(max(stop) FILTER (WHERE errors = 0), 0) AS reach, count_if(errors > 0) AS failures, max(version) AS version FROM v GROUP BY 1),
    b AS (SELECT v.obs, interest, seq, row_number() OVER (PARTITION BY v.obs ORDER BY interest DESC, seq) AS r FROM v JOIN n ON n.obs = v.obs AND n.version = v.version WHERE errors = 0 AND interest IS NOT NULL)
    SELECT n.obs, visits, reach, CAST(800 AS BIGINT) AS nchans, failures, reach >= 800 AS done, failures >= 3 AS given_up, version, interest, seq FROM n LEFT JOIN b ON b.obs = n.obs AND r = 1""")
def ledger_state(spark: SparkSession, d: str) -> DataFrame:
    """Orders as visits to what their customers observe, taken from a stream into keyed state."""
    k = F.col("o_orderkey")
    path = f"{d}/orders.parquet"
    orders = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a file or a folder
    visits = orders.select(
        F.col("o_custkey").alias("obs"), k.alias("seq"), ((k % 9 + 1) * 100).cast("long").alias("stop"), F.lit(800).cast("long").alias("nchans"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("errors"),
        F.concat(F.lit("v"), F.lpad(F.floor(k / 10000).cast("string"), 6, "0")).alias("version"), F.when(k % 7 != 0, F.round(F.col("o_totalprice") / 1000, 0)).alias("interest"))
    out = new_folder(spark, "ledger-state")
    state.keep(visits, out)
    return state.ledger(spark, out)
