"""Queries of the search itself: normalisation, drift search, detectors, features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import axis, dedoppler, detect, features, kernel, learn, normalize, rollup
from ..sources.shared import kept
from ..streaming import crunch
from .registry import query
from .views import EVENTS, N_F, N_T, SAMPLES, event_waterfall, samples

K_MAX, BLOCK, NF = 3, 16, 32
r6 = lambda c: F.round(c, 6).alias(c)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in names})


REPAIR = SAMPLES + """, fixed AS (SELECT obs, t, c, CASE WHEN c % 32 = 16 THEN 0.5 * (coalesce(lag(z) OVER w, z) + coalesce(lead(z) OVER w, z)) ELSE z END AS z FROM samples WINDOW w AS (PARTITION BY obs, t ORDER BY c))"""
KNOTS = REPAIR + """, spec AS (SELECT obs, c, avg(z) AS z FROM fixed GROUP BY 1, 2), kn AS (SELECT obs, c // 16 AS b, median(z) AS v, (min(c) + max(c)) * 0.5::DOUBLE AS pos FROM spec GROUP BY 1, 2)"""
LERP = """CASE WHEN c < pos AND v0 IS NOT NULL THEN v0 + (v - v0) * (c - pos0) / (pos - pos0) WHEN c > pos AND v1 IS NOT NULL THEN v + (v1 - v) * (c - pos) / (pos1 - pos) ELSE v END"""
NEAR = "lag(v) OVER (PARTITION BY obs ORDER BY b) AS v0, lag(pos) OVER (PARTITION BY obs ORDER BY b) AS pos0, lead(v) OVER (PARTITION BY obs ORDER BY b) AS v1, lead(pos) OVER (PARTITION BY obs ORDER BY b) AS pos1"
FLAT = KNOTS + f""", kn2 AS (SELECT *, {NEAR} FROM kn), flat AS (SELECT f.obs, t, c, z - {LERP} AS z FROM fixed f JOIN kn2 k ON f.obs = k.obs AND f.c // 16 = k.b)"""
NOISE = FLAT + """, mid AS (SELECT obs, c // 16 AS b, median(z) AS m FROM flat GROUP BY 1, 2), nk AS (SELECT f.obs, f.c // 16 AS b, 1.4826::DOUBLE * median(abs(z - m)) AS v, (min(c) + max(c)) * 0.5::DOUBLE AS pos FROM flat f JOIN mid ON f.obs = mid.obs AND f.c // 16 = mid.b GROUP BY 1, 2)"""
NORMAL = NOISE + f""", nk2 AS (SELECT *, {NEAR} FROM nk), sd AS (SELECT obs, stddev_pop(z) AS s FROM flat GROUP BY 1), sig AS (SELECT f.obs, t, c, z, {LERP} AS sigma FROM flat f JOIN nk2 k ON f.obs = k.obs AND f.c // 16 = k.b),
    norm AS (SELECT sig.obs, t, c, z / CASE WHEN sigma > 0 THEN sigma WHEN s > 0 THEN s ELSE 1 END AS z FROM sig JOIN sd ON sig.obs = sd.obs)"""


@query("WITH " + REPAIR + " SELECT obs, t, c, round(z, 6) AS z FROM fixed")
def dc_repair(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.repair_dc(samples(spark, d), NF), "z")


@query("WITH " + KNOTS + " SELECT obs, CAST(b AS INTEGER) AS b, round(v, 6) AS v, pos FROM kn")
def block_median(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.knots(normalize.mean_spectrum(normalize.repair_dc(samples(spark, d), NF)), BLOCK, F.median("z")), "v")


@query("WITH " + FLAT + " SELECT obs, t, c, round(z, 6) AS z FROM flat")
def bandpass_interp(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.bandpass_removed(normalize.repair_dc(samples(spark, d), NF), BLOCK).select("obs", "t", "c", "z"), "z")


@query("WITH " + NOISE + " SELECT obs, CAST(b AS INTEGER) AS b, round(v, 6) AS v, pos FROM nk")
def robust_noise(spark: SparkSession, d: str) -> DataFrame:
    flat = normalize.bandpass_removed(normalize.repair_dc(samples(spark, d), NF), BLOCK).select("obs", "t", "c", "z")
    return _round(normalize.block_noise(flat, BLOCK), "v")


@query("WITH " + NORMAL + " SELECT obs, t, c, round(z, 6) AS z FROM norm")
def normalized(spark: SparkSession, d: str) -> DataFrame:
    return _round(normalize.normalize(samples(spark, d), BLOCK, NF).select("obs", "t", "c", "z"), "z")


COLNOISE = SAMPLES + """, cs AS (SELECT obs, c, sum(z) AS s FROM samples GROUP BY 1, 2), cm AS (SELECT obs, median(s) AS med FROM cs WHERE c % 3 = 0 GROUP BY 1),
    noise AS (SELECT cs.obs, med, CASE WHEN median(abs(s - med)) > 0 THEN 1.4826::DOUBLE * median(abs(s - med)) ELSE 4.0 END AS scale FROM cs JOIN cm ON cs.obs = cm.obs WHERE c % 3 = 0 GROUP BY cs.obs, med)"""


@query("WITH " + COLNOISE + " SELECT obs, round(med, 6) AS med, round(scale, 6) AS scale FROM noise")
def column_noise_scale(spark: SparkSession, d: str) -> DataFrame:
    return _round(dedoppler.column_noise(samples(spark, d), N_T), "med", "scale")


_off = " + ".join(f"((t >> {3 - j}) & 1) * ((d >> {j}) - (d >> {j + 1}))" for j in range(4))
PATHS = f"""paths AS (SELECT CAST(sign AS INTEGER) AS sign, CAST(k AS INTEGER) AS k, CAST(d AS INTEGER) AS d, CAST(t AS INTEGER) AS t, CAST(sign * (k * t + {_off}) AS INTEGER) AS delta
    FROM (SELECT unnest([1, -1]) AS sign), (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 16)) AS d), (SELECT unnest(range(0, 16)) AS t) WHERE (d < 15 OR k = 3) AND (sign = 1 OR k + d > 0))"""
BEST = COLNOISE + ", " + PATHS + """, sums AS (SELECT obs, s.c - p.delta AS start, sign, k, d, round(sum(z), 9) AS power FROM samples s JOIN paths p ON s.t = p.t WHERE s.c - p.delta BETWEEN 0 AND 63 GROUP BY ALL),
    best AS (SELECT obs, start AS c, power, sign * (k * 15 + d) / 15.0::DOUBLE AS drift FROM (SELECT *, row_number() OVER (PARTITION BY obs, start ORDER BY power DESC, sign DESC, k * 15 + d) AS rn FROM sums) WHERE rn = 1)"""
SNR = BEST + ", snr AS (SELECT best.obs, c, (power - med) / scale AS snr, drift FROM best JOIN noise ON best.obs = noise.obs)"
PEAKS = SNR + f""", peaks AS (SELECT * FROM (SELECT *, max(snr) OVER (PARTITION BY obs ORDER BY c ROWS BETWEEN 64 PRECEDING AND 64 FOLLOWING) AS near FROM snr) WHERE snr = near AND snr >= 3)"""


@query("WITH " + BEST + " SELECT obs, CAST(sign AS INTEGER) AS sign, CAST(k AS INTEGER) AS k, CAST(d AS INTEGER) AS d, count(*) AS n, round(sum(power), 4) AS total, round(max(power), 4) AS strongest FROM sums GROUP BY obs, sign, k, d")
def drift_paths(spark: SparkSession, d: str) -> DataFrame:
    """What lies on each path of an observation, over all channels that it can begin at; each path adds its own samples."""
    sums = dedoppler.path_sums(samples(spark, d), dedoppler.paths(spark, N_T, K_MAX), N_F).withColumn("power", F.round("power", 9))
    return sums.groupBy("obs", "sign", "k", "d").agg(F.count("*").alias("n"), (F.round(F.sum("power"), 4) + 0.0).alias("total"), (F.round(F.max("power"), 4) + 0.0).alias("strongest"))


@query("WITH " + BEST + " SELECT obs, c, round(power, 6) AS power, round(drift, 6) AS drift FROM best")
def drift_paths_best(spark: SparkSession, d: str) -> DataFrame:
    x = samples(spark, d)
    best = dedoppler.best_paths(dedoppler.tree_sums(x, N_T, N_F, K_MAX), N_T)
    return _round(best, "power", "drift")


@query("WITH " + SNR + " SELECT obs, c, round(snr, 6) AS snr, round(drift, 6) AS drift FROM snr")
def snr_map(spark: SparkSession, d: str) -> DataFrame:
    return _round(dedoppler.snr_map(samples(spark, d), N_T, N_F, K_MAX), "snr", "drift")


def _whole(sql: str) -> str:
    """The same with the noise of all columns, not of every third."""
    return sql.replace(" WHERE c % 3 = 0", "")


@query("WITH " + _whole(PEAKS) + " SELECT obs, c, round(snr, 6) AS snr, round(drift, 6) AS drift FROM peaks")
def nms_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _round(dedoppler.peaks(dedoppler.snr_map(samples(spark, d), N_T, N_F, K_MAX, every=1), dedoppler.nms_window(N_T, N_F, K_MAX), 3.0), "snr", "drift")


@query("WITH " + _whole(PEAKS) + """ SELECT obs, c, round(snr, 6) AS snr, round(drift, 6) AS drift, round(drift * -2.7939677238464355 / 18.253611008::DOUBLE, 6) AS drift_rate_hz_s, round(1420.0::DOUBLE + -2.7939677238464355e-06::DOUBLE * c, 6) AS frequency_mhz FROM peaks WHERE snr >= 4""")
def dedoppler_hits(spark: SparkSession, d: str) -> DataFrame:
    found = dedoppler.hits(samples(spark, d), N_T, N_F, K_MAX, 4.0, every=1)
    return _round(dedoppler.with_rates(found, 18.253611008, -2.7939677238464355e-06, 1420.0), "snr", "drift", "drift_rate_hz_s", "frequency_mhz")


@query("WITH " + PEAKS + " SELECT CAST(obs AS VARCHAR) AS unit_id, CAST(c AS BIGINT) AS channel, round(drift, 6) AS drift, round(snr, 6) AS snr FROM peaks")
def kernel_hits(spark: SparkSession, d: str) -> DataFrame:
    """The vectorised kernel against the relational form's SQL."""
    units = kernel.packed(samples(spark, d), N_T, N_F)
    return _round(kernel.kernel_hits(units, K_MAX, 3.0).drop("error"), "drift", "snr")


@query("WITH " + SAMPLES + """, u AS (SELECT obs, cs AS core_start, cs + 16 AS core_stop, greatest(0, cs - 8) AS a, least(64, cs + 24) AS b FROM (SELECT DISTINCT obs FROM samples), (SELECT unnest([0, 16, 32, 48]) AS cs))
    SELECT s.obs, t, c, round(z, 6) AS z FROM samples s JOIN u ON s.obs = u.obs AND s.c >= u.a AND s.c < u.b WHERE c >= core_start AND c < core_stop""")
def core_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping units, each sample kept by the one that owns it."""
    x = samples(spark, d)
    cs = F.explode(F.array(*[F.lit(v) for v in (0, 16, 32, 48)]))
    units = x.select("obs").distinct().withColumn("core_start", cs).withColumns({"core_stop": F.col("core_start") + 16, "chan_start": F.greatest(F.lit(0), F.col("core_start") - 8), "chan_stop": F.least(F.lit(64), F.col("core_start") + 24), "unit_id": F.concat_ws(":", "obs", "core_start")})
    inside = axis.samples_of_units(x, units).withColumn("c", F.col("c") + F.col("chan_start"))
    return _round(axis.owned(inside, "c").select("obs", "t", "c", "z"), "z")


@query("WITH " + NORMAL + """, f AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY z DESC, t, c) AS rn FROM norm WHERE z >= 3) SELECT obs, t, c, round(z, 6) AS power_sigma FROM f WHERE rn <= 20""")
def spikes_topk(spark: SparkSession, d: str) -> DataFrame:
    x = normalize.normalize(samples(spark, d), BLOCK, NF).select("obs", "t", "c", "z")
    return _round(detect.spikes(x, 3.0, 20), "power_sigma")


@query("WITH " + PEAKS + """, sp AS (SELECT obs, t, c, z FROM samples WHERE z >= 0.3) SELECT obs, t, c, round(z, 6) AS power_sigma FROM sp WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE p.obs = sp.obs AND abs(p.c + p.drift * sp.t - sp.c) <= 3 + 2)""")
def isolated_spikes(spark: SparkSession, d: str) -> DataFrame:
    x = samples(spark, d)
    found = dedoppler.hits(x, N_T, N_F, K_MAX, 3.0).select("obs", F.col("c").alias("channel"), "drift", F.lit(2.0).alias("bandwidth_ch"))
    return _round(detect.isolated(detect.spikes(x, 0.3, 10**6), found), "power_sigma")


@query("WITH " + SAMPLES + " SELECT obs, t, CAST(c // 6 AS INTEGER) AS g, round(max(z), 6) AS z FROM samples WHERE c < 60 GROUP BY 1, 2, 3")
def pool_columns(spark: SparkSession, d: str) -> DataFrame:
    return _round(detect.pooled(samples(spark, d), 10, N_F), "z")


SUB = EVENTS + """, sb AS (SELECT obs, t, CAST(c // 4 AS INTEGER) AS s, avg(z) AS z FROM evt GROUP BY 1, 2, 3), sm AS (SELECT s, median(z) AS m FROM sb GROUP BY 1), sg AS (SELECT sb.s, m, 1.4826::DOUBLE * median(abs(z - m)) AS sig FROM sb JOIN sm ON sb.s = sm.s GROUP BY 1, 2),
    sub AS (SELECT obs, t, sb.s, (z - m) / CASE WHEN sig > 0 THEN sig ELSE 1 END AS z FROM sb JOIN sg ON sb.s = sg.s)"""
NSUB, TS = 16, 1.0


def _sub(spark: SparkSession, d: str) -> DataFrame:
    return detect.subbands(event_waterfall(spark, d), N_F, NSUB)


@query("WITH " + SUB + " SELECT obs, t, s, round(z, 6) AS z FROM sub")
def subband_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _round(_sub(spark, d), "z")


DM = """lag AS (SELECT CAST(s AS INTEGER) AS s, 4148.808::DOUBLE * (pow(200.0::DOUBLE - 1.5::DOUBLE * (s * 4 + 1.5::DOUBLE), -2) - pow(200.0::DOUBLE - 1.5::DOUBLE * 1.5::DOUBLE, -2)) / 1.0 AS delay FROM (SELECT unnest(range(0, 16)) AS s)),
    nt AS (SELECT CAST(max(t) + 1 AS BIGINT) AS n FROM evt), top AS (SELECT least(1000.0::DOUBLE, any_value(n) / 2.0::DOUBLE / greatest(max(delay), 1e-12::DOUBLE)) AS top FROM lag, nt), dms AS (SELECT CAST(i AS INTEGER) AS i, top * i / 7 AS dm FROM top, (SELECT unnest(range(0, 8)) AS i))"""


def _bins(spark: SparkSession, d: str) -> int:
    """Time steps of the event table, as a header would say."""
    return (event_waterfall(spark, d).agg(F.max("t")).first()[0] or 0) + 1


@query("WITH " + EVENTS + ", " + DM + " SELECT i, round(dm, 6) AS dm FROM dms")
def dm_trials(spark: SparkSession, d: str) -> DataFrame:
    return _round(detect.trials(detect.delays(spark, N_F, NSUB, 200.0, -1.5, TS), _bins(spark, d), 1000.0, 8), "dm")


DEDISP = SUB + ", " + DM + """, sh AS (SELECT s, i, dm, CAST(round_even(delay * dm, 0) AS INTEGER) AS shift FROM lag, dms), ser0 AS (SELECT i, t - shift AS t, sum(z) / 4.0::DOUBLE AS v FROM sub JOIN sh ON sub.s = sh.s WHERE t - shift >= 0 GROUP BY 1, 2),
    ser AS (SELECT dms.i, dm, CAST(g.t AS INTEGER) AS t, coalesce(v, 0.0) AS v FROM dms, (SELECT unnest(range(0, (SELECT n FROM nt))) AS t) g LEFT JOIN ser0 ON ser0.i = dms.i AND ser0.t = g.t)"""


def _series(spark: SparkSession, d: str) -> DataFrame:
    lag = detect.delays(spark, N_F, NSUB, 200.0, -1.5, TS)
    n = _bins(spark, d)
    return detect.dedispersed(_sub(spark, d), lag, detect.trials(lag, n, 1000.0, 8), n, NSUB)


@query("WITH " + DEDISP + " SELECT i, round(dm, 6) AS dm, t, round(v, 6) AS v FROM ser")
def dedisperse(spark: SparkSession, d: str) -> DataFrame:
    return _round(_series(spark, d).select("i", "dm", "t", "v"), "dm", "v")


BOX = DEDISP + """, bx AS (""" + " UNION ALL ".join(f"SELECT i, dm, t, {w} AS w, sum(v) OVER (PARTITION BY i ORDER BY t ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) / sqrt({w}::DOUBLE) AS box FROM ser" for w in (1, 2, 4, 8, 16)) + """),
    bz AS (SELECT * FROM bx WHERE t <= (SELECT n FROM nt) - w), bm AS (SELECT i, w, median(box) AS m FROM bz GROUP BY 1, 2), bs AS (SELECT bz.i, bz.w, m, 1.4826::DOUBLE * median(abs(box - m)) AS sd FROM bz JOIN bm ON bz.i = bm.i AND bz.w = bm.w GROUP BY 1, 2, 3),
    bq AS (SELECT bz.i, dm, bz.w, t, round((box - m) / CASE WHEN sd <> 0 THEN sd ELSE 1 END, 9) AS snr FROM bz JOIN bs ON bz.i = bs.i AND bz.w = bs.w), bb AS (SELECT i, dm, w, t, snr FROM (SELECT *, row_number() OVER (PARTITION BY i, w ORDER BY snr DESC, t) AS rn FROM bq) WHERE rn = 1)"""


@query("WITH " + BOX + " SELECT i, round(dm, 6) AS dm, w, t, round(snr, 6) AS snr FROM bb")
def boxcar_snr(spark: SparkSession, d: str) -> DataFrame:
    return _round(detect.boxcars(_series(spark, d), _bins(spark, d)).select("i", "dm", "w", "t", "snr"), "dm", "snr")


@query("WITH " + BOX + """, bu AS (SELECT *, t // greatest(w, 4) AS bucket FROM bb WHERE snr >= 1.5), b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY snr DESC, i, w) AS r FROM bu) WHERE r = 1)
    SELECT i, round(dm, 6) AS dm, w, t, round(snr, 6) AS snr, dm < 1 AS likely_rfi FROM (SELECT *, row_number() OVER (ORDER BY snr DESC, t, i, w) AS q FROM b1) WHERE q <= 50""")
def pulses(spark: SparkSession, d: str) -> DataFrame:
    return _round(detect.pulses(detect.boxcars(_series(spark, d), _bins(spark, d)), 1.5).select("i", "dm", "w", "t", "snr", "likely_rfi"), "dm", "snr")


@query("WITH " + EVENTS + """, sp AS (SELECT c, median(z) AS level FROM evt GROUP BY 1), md AS (SELECT median(level) AS m, stddev_pop(level) AS sd FROM sp), mx AS (SELECT m, sd, 1.4826::DOUBLE * median(abs(level - m)) AS mad FROM sp, md GROUP BY 1, 2)
    SELECT c, round(level, 6) AS level, round((level - m) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1e-12 END, 6) AS robust_z FROM sp, mx WHERE (level - m) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1e-12 END >= 1""")
def legacy_robust_z(spark: SparkSession, d: str) -> DataFrame:
    return _round(detect.robust_z(event_waterfall(spark, d), 1.0).select("c", "level", "robust_z"), "level", "robust_z")


SNIP = PEAKS + """, hh AS (SELECT obs * 1000 + c AS hit_id, obs, c AS channel, drift, snr FROM peaks),
    snip AS (SELECT hit_id, CAST(g.t AS INTEGER) AS t, CAST(x.x AS INTEGER) AS x, coalesce(z, 0.0) AS v FROM hh, (SELECT unnest(range(0, 16)) AS t) g, (SELECT unnest(range(0, 64)) AS x) x LEFT JOIN samples s ON s.obs = hh.obs AND s.t = g.t AND s.c = CAST(round_even(channel + drift * g.t, 0) AS INTEGER) - 32 + x.x)"""


def _found(spark: SparkSession, d: str, every: int = 3) -> tuple[DataFrame, DataFrame]:
    x = samples(spark, d)
    h = dedoppler.hits(x, N_T, N_F, K_MAX, 3.0, every=every).select((F.col("obs") * 1000 + F.col("c")).alias("hit_id"), "obs", F.col("c").alias("channel"), "drift", "snr")
    h = kept(h, "found")  # read by each of the measures
    return h, features.snippets(h, x, N_T)


@query("WITH " + SNIP + " SELECT hit_id, t, x, round(v, 6) AS v FROM snip")
def dedrifted_snippets(spark: SparkSession, d: str) -> DataFrame:
    return _round(_found(spark, d)[1], "v")


@query("WITH " + SNIP + ", im AS (SELECT hit_id, t AS r, CAST(x // 4 AS INTEGER) AS q, avg(v) AS v FROM snip GROUP BY 1, 2, 3), tp AS (SELECT hit_id, max(abs(v)) + 1e-6::DOUBLE AS top FROM im GROUP BY 1) SELECT im.hit_id, r, q, round(v / top, 6) AS v FROM im JOIN tp ON im.hit_id = tp.hit_id")
def snippet_16x16(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.images(_found(spark, d)[1], N_T), "v")


@query("WITH " + SNIP + """, pr AS (SELECT hit_id, x, round(avg(v), 9) AS p FROM snip GROUP BY 1, 2), pk AS (SELECT hit_id, max(CASE WHEN x BETWEEN 31 AND 33 THEN p END) AS peak, avg(CASE WHEN x BETWEEN 12 AND 27 OR x BETWEEN 37 AND 52 THEN p END) AS side FROM pr GROUP BY 1),
    ed AS (SELECT pr.hit_id, max(CASE WHEN p <= 0.5 * greatest(peak, 1e-6) AND x < 32 THEN x END) AS lo, min(CASE WHEN p <= 0.5 * greatest(peak, 1e-6) AND x > 32 THEN x END) AS hi FROM pr JOIN pk ON pr.hit_id = pk.hit_id GROUP BY 1),
    rw AS (SELECT hit_id, t, max(CASE WHEN x BETWEEN 31 AND 33 THEN v END) AS on_, sum(CASE WHEN x NOT BETWEEN 28 AND 36 THEN v END) AS off, arg_max(x, v) FILTER (WHERE x BETWEEN 26 AND 38) - 32 AS w FROM (SELECT * FROM snip ORDER BY hit_id, t, x) GROUP BY 1, 2),
    tt AS (SELECT hit_id, avg(on_) AS mo, stddev_pop(on_) AS sd, max(on_) AS mx, avg(CASE WHEN on_ > 2.0 THEN 1.0::DOUBLE ELSE 0 END) AS onf, count_if(on_ > 1.5) AS ns, avg(CASE WHEN on_ > 1.5 THEN w * w END) AS w2, sum(off) / (16 * 55) AS ofl FROM rw GROUP BY 1),
    mm AS (SELECT rw.hit_id, avg(pow(on_ - mo, 4)) AS m4, avg(pow(on_ - mo, 2)) AS m2 FROM rw JOIN tt ON rw.hit_id = tt.hit_id GROUP BY 1)
    SELECT hh.hit_id, round(snr, 6) AS snr, round(abs(drift), 6) AS abs_drift_ch, CASE WHEN abs(drift) < 0.02 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS zero_drift, CAST(coalesce(hi, 64) - coalesce(lo, -1) - 1 AS DOUBLE) AS bandwidth_ch, round(onf, 6) AS on_fraction, round(sd / (abs(mo) + 1e-3), 6) AS modulation,
    round(m4 / pow(CASE WHEN m2 <> 0 THEN m2 ELSE 1e-9 END, 2), 6) AS kurtosis, round(CASE WHEN ns >= 2 THEN sqrt(w2) ELSE 6.0 END, 6) AS wobble_rms, round(side / (peak + 1e-3), 6) AS sidelobe_ratio, round(ofl, 6) AS off_track_level, round(mx / (abs(mo) + 1e-3), 6) AS peak_to_mean
    FROM hh JOIN pk ON hh.hit_id = pk.hit_id JOIN ed ON hh.hit_id = ed.hit_id JOIN tt ON hh.hit_id = tt.hit_id JOIN mm ON hh.hit_id = mm.hit_id""")
def scalar_features(spark: SparkSession, d: str) -> DataFrame:
    h, s = _found(spark, d)
    return _round(features.scalars(h, s), *[c for c in features.SCALARS])


def _sql_of(name: str) -> str:
    from .registry import _sql

    return _sql[name]


@query(_whole("SELECT hit_id, unnest(range(0, 11)) AS place, unnest([" + ", ".join(features.SCALARS) + "]) + 0.0 AS v FROM (" + _sql_of("scalar_features") + ") UNION ALL SELECT hit_id, 11 + r * 16 + q AS place, v + 0.0 AS v FROM (" + _sql_of("snippet_16x16") + ")"))
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 267 numbers of each hit, a row each."""
    v = features.vectors(*_found(spark, d, 1), N_T)
    return v.select("hit_id", F.posexplode("features").alias("place", "v")).select("hit_id", F.col("place").cast("long").alias("place"), (F.round("v", 6) + 0.0).alias("v"))


@query("WITH " + PEAKS + " SELECT obs, CAST(c AS BIGINT) AS channel, round(drift, 6) AS drift, round(snr, 6) AS snr FROM peaks")
def table_function_hits(spark: SparkSession, d: str) -> DataFrame:
    """The search called from SQL. Samples come out of a join, so they are dealt anew (see tables)."""
    tables.register(spark)
    found = spark.sql("SELECT * FROM dedoppler_hits(k_max => 3, threshold => 3.0, samples => TABLE(SELECT obs, t, c, z FROM {x}) PARTITION BY (obs, hash(obs)))", x=samples(spark, d))
    return _round(found, "drift", "snr")


def _in_units(units: DataFrame, rows, schema: str) -> DataFrame:
    """rows(unit_id, samples [time, channel]) of each packed unit, a task for some units, as the search has them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit, n_t, n_f, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                out += rows(int(unit), np.frombuffer(raw, "<f8").reshape(n_t, n_f))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(kind), kind)], schema=kind)

    return units.select("unit_id", "n_t", "n_f", "z").mapInArrow(task, schema)


def _unit_hits(z: np.ndarray) -> list[tuple[int, float, float]]:
    snr, drift = kernel.search(z, K_MAX)
    return [(int(c), float(drift[c]), float(snr[c])) for c in kernel.peaks(snr, dedoppler.nms_window(*z.shape, K_MAX), 3.0)]


@query(_sql_of("scalar_features"))
def unit_measures(spark: SparkSession, d: str) -> DataFrame:
    """What a unit's task measures of its hits, against the relational form's SQL."""
    rows = lambda obs, z: [(obs * 1000 + c, *learn.measures(z, c, drift, snr)) for c, drift, snr in _unit_hits(z)]
    return _round(_in_units(kernel.packed(samples(spark, d), N_T, N_F), rows, "hit_id long, " + ", ".join(f"{x} double" for x in features.SCALARS)), *features.SCALARS)


@query(_sql_of("snippet_16x16"))
def unit_images(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda obs, z: [(obs * 1000 + c, k // 16, k % 16, float(v)) for c, drift, _ in _unit_hits(z) for k, v in enumerate(learn.image(z, c, drift))]
    return _round(_in_units(kernel.packed(samples(spark, d), N_T, N_F), rows, "hit_id long, r int, q int, v double"), "v")


@query(_sql_of("isolated_spikes"))
def unit_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Single samples that a unit's task finds off its own tracks."""
    rows = lambda obs, z: [(obs, s["t"], s["channel"], s["power_sigma"]) for s in detect.spike_array(z, [(c, drift, 2.0) for c, drift, _ in _unit_hits(z)], 0.3, 0, z.shape[1], 10**6, first=10**6) if s["isolated"]]
    return _round(_in_units(kernel.packed(samples(spark, d), N_T, N_F), rows, "obs long, t int, c int, power_sigma double"), "power_sigma")


@query(_sql_of("pulses"))
def unit_pulses(spark: SparkSession, d: str) -> DataFrame:
    """The dispersion search of a unit's task."""
    def rows(obs: int, z: np.ndarray) -> list[tuple]:
        return [(p["i"], p["dm"], p["w"], p["t"], p["snr"], p["likely_rfi"]) for p in detect.pulse_array(z, 200.0 - 1.5 * np.arange(z.shape[1]), TS, 1.5, 1000.0, 8, NSUB)]

    return _round(_in_units(kernel.packed(event_waterfall(spark, d), _bins(spark, d), N_F), rows, "i int, dm double, w int, t int, snr double, likely_rfi boolean"), "dm", "snr")


@query(None)
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    """Isolation forest over the measures of all hits of the embeddings."""
    h, s = _found(spark, d)
    return learn.anomalies(features.scalars(h, s).withColumn("run", F.lit("all")))


TONES, DRIFTS = (3.0, 6.0, 12.0), (0.0, 0.5, 2.0)
_cells = [(0.0, 0.0), *((s, d) for s in TONES for d in DRIFTS)]
PLANTED = SAMPLES.replace("samples AS", "base AS") + f""", bs AS (SELECT obs, c, sum(z) AS s FROM base GROUP BY 1, 2), bm AS (SELECT obs, median(s) AS med FROM bs WHERE c % 3 = 0 GROUP BY 1),
    bn AS (SELECT bs.obs, CASE WHEN median(abs(s - med)) > 0 THEN 1.4826::DOUBLE * median(abs(s - med)) ELSE 4.0 END AS scale FROM bs JOIN bm ON bs.obs = bm.obs WHERE c % 3 = 0 GROUP BY bs.obs, med),
    cells AS (SELECT * FROM (VALUES {", ".join(f"({k}, {s}::DOUBLE, {d}::DOUBLE)" for k, (s, d) in enumerate(_cells))}) AS v(cell, tone_snr, tone_drift)),
    trials AS (SELECT bn.obs * {len(_cells)} + cell AS obs, bn.obs AS source, cell, tone_snr, tone_drift, 4 + (bn.obs * 7919 + cell * 104729) % CAST(56 - ceil(tone_drift * 15) AS BIGINT) AS start, tone_snr * scale / 16 AS power FROM bn, cells),
    samples AS (SELECT trials.obs, t, c, z + CASE WHEN c = start + round_even(tone_drift * t, 0) THEN power ELSE 0.0::DOUBLE END AS z FROM base JOIN trials ON base.obs = trials.source)"""


@query("SELECT x.*, CASE WHEN cell = 0 THEN 'noise' WHEN tone_drift = 0 THEN 'rfi_zero_drift' ELSE 'technosignature_like' END AS label FROM (" + _sql_of("scalar_features").replace(SAMPLES, PLANTED) + f""") x
    JOIN (WITH {PLANTED + PEAKS[len(SAMPLES):]} SELECT p.obs * 1000 + p.c AS id, cell, tone_drift FROM peaks p JOIN trials t ON t.obs = p.obs WHERE cell = 0 OR (abs(p.c - start) <= 3 AND abs(p.drift - tone_drift) <= 0.5)) y ON y.id = x.hit_id""")
def synthetic_examples(spark: SparkSession, d: str) -> DataFrame:
    """Training rows: hits of the embeddings as they are, and tones planted in them that are found again."""
    return _round(_examples(spark, d).select("hit_id", "label", *features.SCALARS), *features.SCALARS)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return learn.examples(samples(spark, d), N_T, N_F, K_MAX, 3.0, TONES, DRIFTS)


@query(None)
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """A forest learnt from tones planted in the embeddings, applied to the hits of the embeddings."""
    model, _, _ = learn.train(kept(_examples(spark, d), "training"))  # read several times
    h, s = _found(spark, d)
    n = len(features.SCALARS)
    x = features.vectors(h, s, N_T).select("hit_id", *[F.col("features")[k].alias(c) for k, c in enumerate(features.SCALARS)], F.slice("features", n + 1, 256).alias("img"))
    return learn.probabilities(model, x).drop("img")


@query("WITH " + PLANTED + PEAKS[len(SAMPLES):] + """, f AS (SELECT t.obs, tone_snr, tone_drift, bool_or(coalesce(abs(p.c - start) <= 3 AND abs(p.drift - tone_drift) <= 0.5, false)) AS found FROM trials t LEFT JOIN peaks p ON p.obs = t.obs WHERE cell > 0 GROUP BY 1, 2, 3)
    SELECT tone_snr AS snr, tone_drift AS drift, round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate, count(*) AS n FROM f GROUP BY 1, 2""")
def recovery_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Share of tones planted in each observation of the embeddings that are found, by strength and drift."""
    return rollup.recovery(learn.recovery_trials(samples(spark, d), N_T, N_F, K_MAX, 3.0, TONES, DRIFTS)).withColumn("rate", F.round("rate", 6))


@query("WITH e AS (SELECT date_trunc('hour', ts) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY 1, 2")
def windowed_rates(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return _round(crunch.windowed_rates(e), "mean")
