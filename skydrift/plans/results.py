"""Queries over hits: interference, cadences, scores, sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KNOWN_BANDS_MHZ
from ..functions.exprs import finite, half_even, in_bands, is_off_scan, sinc
from ..operators import rfi, rollup, score, selection, share
from .registry import query
from .views import HITS, hits

W = "WITH " + HITS


def _scans(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.concat(F.lit("scan"), F.col("id").cast("string")).alias("name"), (F.lit(58000.0) + F.col("id") * 0.0035).alias("mjd"), (F.col("id") % 2 == 0).alias("is_on"))


SCANS = "scans AS (SELECT 'scan' || i AS name, 58000.0::DOUBLE + i * 0.0035::DOUBLE AS mjd, i % 2 = 0 AS is_on, i AS place FROM (SELECT unnest(range(0, 6)) AS i))"


@query(W + " SELECT hit_id, round(frequency_mhz, 6) AS frequency_mhz FROM hits WHERE known_rfi_band")
def rfi_band_semi(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where(in_bands("frequency_mhz", KNOWN_BANDS_MHZ)).select("hit_id", F.round("frequency_mhz", 6).alias("frequency_mhz"))


@query(W + """, p AS (SELECT a.hit_id AS i, b.hit_id AS j, a.snr AS si, b.snr AS sj FROM hits a JOIN hits b ON a.file = b.file AND a.hit_id <> b.hit_id AND abs(b.channel - a.mirror_channel) <= 3 AND abs(a.drift + b.drift) <= greatest(0.25, 0.1 * abs(a.drift)) WHERE a.mirror_channel >= 0),
    m AS (SELECT i AS hit_id, greatest(si, sj) < 2 * least(si, sj) OR NOT (sj < si OR (sj = si AND j < i)) AS image FROM p UNION ALL SELECT j, greatest(si, sj) < 2 * least(si, sj) OR (sj < si OR (sj = si AND j < i)) FROM p)
    SELECT h.hit_id, g.hit_id IS NOT NULL AS mirror_pair, coalesce(image, false) AS mirror_image FROM hits h LEFT JOIN (SELECT hit_id, bool_or(image) AS image FROM m GROUP BY 1) g ON g.hit_id = h.hit_id""")
def mirror_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).drop("mirror_image")
    return rfi.mirror_pairs(h).select("hit_id", "mirror_pair", "mirror_image")


SCORED = W + """, sc AS (SELECT *, snr > 3.0 * 40.24 AS ood, 0.55::DOUBLE * CASE WHEN snr > 3.0 * 40.24 THEN rule ELSE coalesce(p_technosignature_like, 0.0) END + 0.20::DOUBLE * greatest(0.0, least(1.0, 1 - exp(-(snr - 10) / 10))) + 0.25::DOUBLE * coalesce(anomaly, 0.5) AS s0
      FROM (SELECT *, CASE WHEN NOT stationary AND bandwidth_ch <= 4 AND on_fraction >= 0.5 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS rule FROM hits)),
    sd AS (SELECT *, round_even(100 * (s0 * CASE WHEN stationary AND NOT drift_unresolved THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN known_rfi_band THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN bandwidth_ch > 8 THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN mirror_image THEN 0.2::DOUBLE ELSE 1 END * CASE WHEN ood THEN 0.3::DOUBLE ELSE 1 END) * 10, 0) / 10 AS v FROM sc),
    scored AS (SELECT *, CASE WHEN ood THEN least(v, 50.0) ELSE v END AS interest FROM sd)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return score.interest(hits(spark, d), 10.0)


@query(SCORED + " SELECT hit_id, ood, interest FROM scored")
def interest_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("hit_id", "ood", "interest")


@query(SCORED.replace("3.0 * 40.24", "3.0 * 25.0") + " SELECT hit_id, interest FROM scored WHERE ood")
def ood_cap(spark: SparkSession, d: str) -> DataFrame:
    """Under a classifier trained up to a signal to noise of 25."""
    return score.interest(hits(spark, d), 10.0, snr_max=25.0).where("ood").select("hit_id", "interest")


CLASSED = SCORED + """, classed AS (SELECT *, CASE WHEN ood THEN 'out_of_distribution' WHEN coalesce(p_technosignature_like, -1) >= p_rfi_zero_drift AND coalesce(p_technosignature_like, -1) >= p_noise THEN 'technosignature_like' WHEN p_rfi_zero_drift >= p_noise THEN 'rfi_zero_drift' ELSE 'noise' END AS ai_class FROM scored)"""


def classed(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("ai_class", F.when(F.col("ood"), "out_of_distribution").otherwise(score.best_class(["p_technosignature_like", "p_rfi_zero_drift", "p_noise"])))


@query(CLASSED + " SELECT hit_id, ai_class FROM classed")
def class_argmax(spark: SparkSession, d: str) -> DataFrame:
    return classed(spark, d).select("hit_id", "ai_class")


@query(SCORED + ", r AS (SELECT hit_id, target, interest, row_number() OVER (PARTITION BY target ORDER BY interest DESC, hit_id) AS rank FROM scored) SELECT hit_id, target, interest, rank FROM r WHERE rank <= 25")
def rank_topk(spark: SparkSession, d: str) -> DataFrame:
    return score.ranked(scored(spark, d), keys=("target",)).where("rank <= 25").select("hit_id", "target", "interest", F.col("rank").cast("long").alias("rank"))


MULTI = SCORED + """, seen AS (SELECT target, frequency_mhz FROM hits), mt AS (SELECT hit_id, (SELECT 1) AS one FROM scored WHERE false),
    cnt AS (SELECT h.hit_id, count_if(s.frequency_mhz BETWEEN h.frequency_mhz - 0.002::DOUBLE AND h.frequency_mhz + 0.002::DOUBLE) AS same, count(*) AS band FROM scored h JOIN seen s ON s.target <> h.target AND s.frequency_mhz BETWEEN h.frequency_mhz - 0.025::DOUBLE AND h.frequency_mhz + 0.025::DOUBLE GROUP BY 1),
    multi AS (SELECT h.*, coalesce(same > 0 OR band >= 2, false) AS mtf FROM scored h LEFT JOIN cnt ON cnt.hit_id = h.hit_id)"""


@query(MULTI + " SELECT hit_id, mtf AS multi_target, CASE WHEN mtf THEN round_even(interest * 0.2::DOUBLE * 10, 0) / 10 ELSE interest END AS interest FROM multi")
def multi_target(spark: SparkSession, d: str) -> DataFrame:
    h = scored(spark, d).drop("multi_target")
    return rfi.multi_target(h, hits(spark, d).select("target", "frequency_mhz")).select("hit_id", "multi_target", "interest")


@query("""WITH k AS (SELECT o_custkey AS cadence, count_if(o_orderkey % 2 = 0) AS n_on, count_if(o_orderkey % 2 <> 0) AS n_off FROM orders GROUP BY 1)
    SELECT cadence, n_on, n_off, n_on >= 2 AND n_off > 0 AS testable, CASE WHEN n_on < 2 THEN 'only ' || n_on || ' ON scan(s); a test needs 2' WHEN n_off = 0 THEN 'no OFF scan' ELSE n_on || ' ON / ' || n_off || ' OFF scans' END AS reason FROM k""")
def cadence_testable(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the scans of a cadence."""
    scans = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("cadence"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 2 == 0).alias("is_on"))
    return rfi.testable(scans).select("cadence", "n_on", "n_off", "testable", "reason")


TOL = 20_000.0
CADENCE = W + ", " + SCANS + f""", ref AS (SELECT hit_id, frequency_mhz, drift_rate_hz_s AS rate FROM hits WHERE scan_no = 0), met AS (
      SELECT r.hit_id, s.name, s.is_on, s.place FROM ref r JOIN scans s ON s.place > 0 JOIN hits h ON h.scan_no = s.place
       AND abs(h.frequency_mhz - (r.frequency_mhz + r.rate * ((s.mjd - 58000.0::DOUBLE) * 86400.0::DOUBLE) / 1e6::DOUBLE)) <= ({TOL}::DOUBLE + abs(r.rate) * 60.0::DOUBLE) / 1e6::DOUBLE AND (NOT s.is_on OR abs(h.drift_rate_hz_s - r.rate) <= greatest(0.2, 0.5 * abs(r.rate))) GROUP BY ALL),
    k AS (SELECT hit_id, count_if(is_on) AS on_found, count_if(NOT is_on) AS off_found, string_agg(name, ';' ORDER BY place) FILTER (WHERE is_on) AS matched FROM met GROUP BY 1),
    ev AS (SELECT r.hit_id, frequency_mhz, rate, coalesce(on_found, 0) + 1 AS on_scans_matched, coalesce(matched, '') AS matched_in FROM ref r LEFT JOIN k ON k.hit_id = r.hit_id WHERE (coalesce(on_found, 0) + 1) / 3.0 >= 0.6 AND coalesce(off_found, 0) = 0)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("name", F.concat(F.lit("scan"), F.col("scan_no").cast("string")))
    return rfi.cadence_events(_scans(spark), h.select("hit_id", "name", "frequency_mhz", "drift_rate_hz_s"), tol_hz=TOL, min_on_fraction=0.6)


@query(CADENCE + " SELECT hit_id, round(frequency_mhz, 6) AS frequency_mhz, on_scans_matched, CAST(3 AS BIGINT) AS n_on_scans, CAST(3 AS BIGINT) AS off_scans_checked, matched_in FROM ev")
def cadence_on_off(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("hit_id", F.round("frequency_mhz", 6).alias("frequency_mhz"), F.col("on_scans_matched").cast("long").alias("on_scans_matched"), "n_on_scans", "off_scans_checked", "matched_in")


APPLIED = CADENCE + SCORED[len(W):] + """, ap AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE abs(scored.frequency_mhz - ev.frequency_mhz) <= 50.0::DOUBLE / 1e6::DOUBLE) AS pass FROM scored)"""


@query(APPLIED + " SELECT hit_id, CASE WHEN pass THEN 'passed' ELSE 'failed' END AS cadence, CASE WHEN pass THEN interest ELSE round_even(interest * 0.2::DOUBLE * 10, 0) / 10 END AS interest FROM ap")
def cadence_apply(spark: SparkSession, d: str) -> DataFrame:
    return rfi.apply_cadence(scored(spark, d).drop("cadence"), _events(spark, d)).select("hit_id", "cadence", "interest")


@query(CADENCE + """, e2 AS (SELECT frequency_mhz AS ef, CASE WHEN hit_id % 4 = 0 THEN 1 ELSE 3 END AS n_on, CASE WHEN hit_id % 5 = 0 THEN 0 ELSE 3 END AS n_off FROM ev), q AS (SELECT h.hit_id, max(n_on) AS a, max(n_off) AS b FROM hits h JOIN e2 ON abs(h.frequency_mhz - ef) < 50e-6::DOUBLE GROUP BY 1)
    SELECT h.hit_id, CASE WHEN coalesce(a, 0) >= 2 AND coalesce(b, 0) >= 1 THEN 'passed' ELSE 'failed' END AS cadence_status FROM hits h LEFT JOIN q ON q.hit_id = h.hit_id""")
def share_cadence_status(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).withColumns({"n_on_scans": F.when(F.col("hit_id") % 4 == 0, 1).otherwise(3), "off_scans_checked": F.when(F.col("hit_id") % 5 == 0, 0).otherwise(3)})
    return share.cadence_of(hits(spark, d), ev).select("hit_id", "cadence_status")


@query(W + """, tones AS (SELECT c_custkey AS tone_id, (c_custkey * 131) % 65536 AS start_channel, (c_custkey % 21 - 10) / 10.0::DOUBLE AS true_drift FROM customer), rk AS (SELECT channel, row_number() OVER (ORDER BY snr DESC, hit_id) AS rank FROM hits)
    SELECT tone_id, min(rank) AS best_rank FROM tones LEFT JOIN rk ON abs(channel - start_channel) <= abs(true_drift * 16) + 4 GROUP BY 1""")
def injection_recovery(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tones = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("tone_id"), ((k * 131) % 65536).alias("start_channel"), ((k % 21 - 10) / 10.0).alias("true_drift"))
    return rfi.truth_join(tones, score.ranked(hits(spark, d), "snr"), 16).select("tone_id", F.col("best_rank").cast("long").alias("best_rank"))


@query(W + """, pl AS (SELECT s_suppkey AS place_id, 'T' || (s_suppkey % 8) AS file, (s_suppkey * 977) % 65536 AS at_ FROM supplier)
    SELECT place_id, hit_id, off AS distance FROM (SELECT place_id, hit_id, abs(channel - at_) AS off, row_number() OVER (PARTITION BY place_id ORDER BY abs(channel - at_), hit_id) AS rn FROM pl JOIN hits ON hits.file = pl.file) WHERE rn = 1""")
def nearest_hit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    places = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("place_id"), F.concat(F.lit("T"), (k % 8).cast("string")).alias("file"), ((k * 977) % 65536).alias("at"))
    return rfi.nearest(hits(spark, d), places)


ASIDE = CLASSED + """, rs AS (SELECT *, CASE WHEN mirror_image THEN 'mirror_image' WHEN cadence = 'failed' THEN 'cadence_failed' WHEN multi_target THEN 'multi_target' WHEN known_rfi_band THEN 'known_rfi_band' WHEN stationary AND NOT drift_unresolved THEN 'stationary' WHEN ai_class = 'out_of_distribution' THEN 'out_of_distribution' WHEN drift_unresolved THEN 'drift_unresolved' WHEN ai_class LIKE 'rfi\\_%' ESCAPE '\\' THEN 'ai_rfi' WHEN ai_class = 'noise' THEN 'ai_noise' END AS reason FROM classed)"""


@query(ASIDE + " SELECT reason, count(*) AS n FROM rs GROUP BY 1")
def set_aside_reasons(spark: SparkSession, d: str) -> DataFrame:
    return score.set_aside(classed(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query(CLASSED + """ SELECT count_if(mirror_image) AS mirror_image, count_if(cadence = 'failed') AS cadence_failed, count_if(multi_target) AS multi_target, count_if(known_rfi_band) AS known_rfi_band, count_if(stationary AND NOT drift_unresolved) AS stationary, count_if(ai_class = 'out_of_distribution') AS out_of_distribution,
    count_if(drift_unresolved) AS drift_unresolved, count_if(ai_class LIKE 'rfi%') AS ai_rfi, count_if(ai_class = 'noise') AS ai_noise FROM classed""")
def set_aside_masks(spark: SparkSession, d: str) -> DataFrame:
    return classed(spark, d).agg(*[F.count_if(m).alias(k) for k, m in score.set_aside_masks().items()])


@query(ASIDE + " SELECT hit_id, frequency_mhz, interest FROM (SELECT hit_id, round(frequency_mhz, 6) AS frequency_mhz, interest FROM rs WHERE reason IS NULL ORDER BY interest DESC, hit_id LIMIT 8)")
def survivors(spark: SparkSession, d: str) -> DataFrame:
    return score.set_aside(classed(spark, d)).where(F.col("reason").isNull()).orderBy(F.desc("interest"), "hit_id").limit(8).select("hit_id", F.round("frequency_mhz", 6).alias("frequency_mhz"), "interest")


@query(W + """ SELECT hit_id, CASE WHEN drift_unresolved THEN NULL ELSE NOT stationary END AS drifts, bandwidth_ch <= 4 AS narrowband, on_fraction >= 0.75 AS steady, NOT known_rfi_band AS outside_bands, NOT mirror_image AS no_mirror, NOT multi_target AS one_target, CASE WHEN cadence = 'not_run' THEN NULL ELSE cadence = 'passed' END AS cadence, CAST(NULL AS BOOLEAN) AS cross_checked, CAST(NULL AS BOOLEAN) AS reobserved FROM hits""")
def checklist(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", *[c.alias(k) for k, c in share.checklist().items()])


GATE = """CASE WHEN drift_unresolved THEN 'drift not measurable' WHEN stationary THEN 'zero drift' WHEN known_rfi_band THEN 'known band' WHEN mirror_image THEN 'mirror image' WHEN multi_target THEN 'another target'"""


@query(W + f" SELECT hit_id, {GATE} ELSE 'ok' END AS gate, {GATE} WHEN cadence <> 'passed' THEN 'cadence ' || cadence ELSE 'ok' END AS strict_gate FROM hits")
def share_gate(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", share.gate().alias("gate"), share.gate(True).alias("strict_gate"))


FID = "'AIS-' || upper(substr(sha256(concat_ws('|', target, CAST(CAST(round_even(frequency_mhz * 1e5::DOUBLE, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(drift_rate_hz_s / 0.05::DOUBLE, 0) AS BIGINT) AS VARCHAR))), 1, 12))"


@query(W + f" SELECT hit_id, {FID} AS finding_id FROM hits")
def finding_id(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", share.finding_id(F.col("target")).alias("finding_id"))


@query(W + f""", f AS (SELECT *, {FID} AS finding_id, {GATE} ELSE 'ok' END AS gate FROM hits), old AS (SELECT DISTINCT {FID} AS finding_id, CASE WHEN hit_id % 2 = 0 THEN 'bundle' ELSE 'webhook' END AS destination FROM hits WHERE hit_id % 23 = 0),
    x AS (SELECT f.finding_id, t.destination, CASE WHEN gate <> 'ok' THEN gate WHEN old.finding_id IS NOT NULL THEN 'already shared' WHEN t.destination <> 'bundle' AND cadence <> 'passed' THEN 'no cadence pass' WHEN t.destination <> 'bundle' AND synthetic THEN 'synthetic data' ELSE 'ok' END AS reason
          FROM f JOIN (SELECT unnest(['bundle', 'webhook']) AS destination) t ON true LEFT JOIN old ON old.finding_id = f.finding_id AND old.destination = t.destination)
    SELECT finding_id, destination, CASE WHEN reason = 'ok' THEN 'send' ELSE 'skip' END AS action, reason FROM x""")
def share_decisions(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).withColumn("finding_id", share.finding_id(F.col("target")))
    old = h.where("hit_id % 23 = 0").select("finding_id", F.when(F.col("hit_id") % 2 == 0, "bundle").otherwise("webhook").alias("destination"))
    return share.decisions(h, ("bundle", "webhook"), old)


@query(W + f""", f AS (SELECT {FID} AS finding_id, hit_id FROM hits), old AS (SELECT DISTINCT finding_id FROM f WHERE hit_id % 23 = 0) SELECT hit_id, finding_id FROM f WHERE finding_id NOT IN (SELECT finding_id FROM old)""")
def share_dedupe(spark: SparkSession, d: str) -> DataFrame:
    f = hits(spark, d).select("hit_id", share.finding_id(F.col("target")).alias("finding_id"))
    return f.join(f.where("hit_id % 23 = 0").select("finding_id"), "finding_id", "left_anti").select("hit_id", "finding_id")


def _json(**of: str) -> str:
    """SQL of a JSON object; fields that are null are left out."""
    return "'{' || array_to_string([" + ", ".join(f"""'"{k}":' || {v}""" for k, v in of.items()) + "], ',') || '}'"


def _text(x: str) -> str:
    return f"""('"' || {x} || '"')"""


def _plain(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


RECORD = _json(
    assessment=_json(ai_class=_text("ai_class"), anomaly=_plain("anomaly"), cadence=_text("cadence"), interest=_plain("interest"), known_rfi_band=_plain("known_rfi_band")),
    checks=_json(cadence=_plain("CASE WHEN cadence <> 'not_run' THEN cadence = 'passed' END"), drifts=_plain("CASE WHEN NOT drift_unresolved THEN NOT stationary END"), narrowband=_plain("(bandwidth_ch <= 4)"), no_mirror=_plain("(NOT mirror_image)"),
        one_target=_plain("(NOT multi_target)"), outside_bands=_plain("(NOT known_rfi_band)"), steady=_plain("(on_fraction >= 0.75)")),
    finding_id=_text("finding_id"),
    schema="'\"drift-finding/1\"'",
    signal=_json(**{k: _plain(k) for k in ("bandwidth_ch", "drift_rate_hz_s", "frequency_mhz", "on_fraction", "snr")}))


@query(CLASSED + f", f AS (SELECT *, {FID} AS finding_id FROM classed), j AS (SELECT hit_id, finding_id, {RECORD} AS record FROM f) SELECT hit_id, finding_id, record, sha256(record) AS payload_sha256 FROM j")
def finding_records(spark: SparkSession, d: str) -> DataFrame:
    h = classed(spark, d).withColumn("finding_id", share.finding_id(F.col("target")))
    return share.records(h).select("hit_id", "finding_id", "record", "payload_sha256")


@query(W + """, n AS (SELECT hit_id, CASE WHEN hit_id % 50 = 0 THEN NULL WHEN hit_id % 51 = 0 THEN NULL ELSE snr END AS snr FROM hits) SELECT hit_id, snr FROM n""")
def json_clean(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("hit_id") % 50 == 0, F.lit(float("nan"))).when(F.col("hit_id") % 51 == 0, F.lit(float("inf"))).otherwise(F.col("snr"))
    return hits(spark, d).select("hit_id", finite(odd).alias("snr"))


@query(W + " SELECT hit_id, round_even(snr * 0.25::DOUBLE * 10, 0) / 10 AS even_1, round_even(drift * 2.5::DOUBLE, 0) AS even_0, round(CASE WHEN drift = 0 THEN 1.0 ELSE sin(drift * 3.141592653589793::DOUBLE) / (drift * 3.141592653589793::DOUBLE) END, 6) + 0.0 AS sinc, contains(upper(target || '_off'), '_OFF') AS off_scan FROM hits")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", half_even(F.col("snr") * 0.25, 1).alias("even_1"), half_even(F.col("drift") * 2.5).alias("even_0"), (F.round(sinc("drift"), 6) + 0.0).alias("sinc"), is_off_scan(F.concat("target", F.lit("_off"))).alias("off_scan"))


@query(W + """, tr AS (SELECT CAST(floor(snr / 20) AS INTEGER) AS snr, CAST(floor(abs(drift)) AS INTEGER) AS drift, hit_id % 3 = 0 AS found FROM hits) SELECT snr, drift, round(avg(CAST(found AS INTEGER)), 6) AS rate, count(*) AS n FROM tr GROUP BY 1, 2""")
def recovery_table(spark: SparkSession, d: str) -> DataFrame:
    t = hits(spark, d).select(F.floor(F.col("snr") / 20).cast("int").alias("snr"), F.floor(F.abs("drift")).cast("int").alias("drift"), (F.col("hit_id") % 3 == 0).alias("found"))
    return rollup.recovery(t).withColumn("rate", F.round("rate", 6))


@query(CLASSED + " SELECT CASE WHEN hit_id % 4 = 0 THEN 'noise' WHEN hit_id % 4 = 1 THEN 'rfi_zero_drift' ELSE 'technosignature_like' END AS label, ai_class AS predicted, count(*) AS n FROM classed GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rollup.confusion(_labelled(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("hit_id") % 4
    return classed(spark, d).select(F.when(k == 0, "noise").when(k == 1, "rfi_zero_drift").otherwise("technosignature_like").alias("label"), F.col("ai_class").alias("predicted"), "drift")


@query(CLASSED + """, l AS (SELECT CASE WHEN hit_id % 4 = 0 THEN 'noise' WHEN hit_id % 4 = 1 THEN 'rfi_zero_drift' ELSE 'technosignature_like' END AS label, ai_class, CAST(CASE WHEN abs(drift) < 0.5 THEN 0 WHEN abs(drift) < 1.0 THEN 1 ELSE 2 END AS INTEGER) AS band FROM classed) SELECT label, band, round(avg(CASE WHEN label = ai_class THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, count(*) AS n FROM l GROUP BY 1, 2""")
def recall_by_drift(spark: SparkSession, d: str) -> DataFrame:
    return rollup.recall_by_band(_labelled(spark, d), (0.5, 1.0)).withColumn("recall", F.round("recall", 6))


@query(W + " SELECT target, round(quantile_cont(snr, 0.95), 6) AS threshold FROM hits GROUP BY 1")
def calibration_quantile(spark: SparkSession, d: str) -> DataFrame:
    return selection.quantiles(hits(spark, d), "snr", {"threshold": 0.95}, ("target",)).withColumn("threshold", F.round("threshold", 6))


@query(CLASSED + """ SELECT target, hit_id, interest FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY NOT stationary DESC, coalesce(p_technosignature_like, -1) DESC, snr DESC, hit_id) AS rn FROM classed) WHERE rn = 1""")
def live_best(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("hit_id", "interest"), F.struct(~F.col("stationary"), F.coalesce("p_technosignature_like", F.lit(-1.0)), "snr", -F.col("hit_id"))).alias("b")
    return classed(spark, d).groupBy("target").agg(best).select("target", "b.hit_id", "b.interest")
