"""The jobs as queries: each runs twice over the whole tables into one new folder, and gives what stands there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skydrift.config import KNOWN_BANDS_MHZ
from skydrift.sources.shared import new_folder

from . import catalogue, links


def job1_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1-catalogue")
    catalogue.run(spark, f"{sf_dir}/orders.parquet", out)
    return catalogue.run(spark, f"{sf_dir}/orders.parquet", out)


def job2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2-links")
    links.run(spark, f"{sf_dir}/pages.parquet", out)
    return links.run(spark, f"{sf_dir}/pages.parquet", out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_catalogue": job1_catalogue, "job2_links": job2_links}


_bands = " OR ".join(f"frequency_mhz BETWEEN {lo} AND {hi}" for lo, hi in KNOWN_BANDS_MHZ)
CATALOGUE_SQL = f"""
    WITH h AS (SELECT o_orderkey AS hit_id, 'T' || (o_custkey % 8) AS target, 1000.0::DOUBLE + o_totalprice / 1000.0::DOUBLE AS frequency_mhz, (o_orderkey % 41 - 20) / 10.0::DOUBLE AS drift,
                      10.0::DOUBLE + (o_custkey % 500) / 5.0::DOUBLE AS snr, (o_orderkey * 7919) % 65536 AS channel, o_custkey % 12 AS bandwidth_ch, (o_orderkey % 9) / 8.0::DOUBLE AS on_fraction,
                      CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS anomaly, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 97) / 97.0::DOUBLE END AS p_tech,
                      (o_orderkey % 89) / 89.0::DOUBLE AS p_rfi, (o_orderkey % 83) / 83.0::DOUBLE AS p_noise, o_orderkey % 13 = 0 AS drift_unresolved, o_orderkey % 5 = 0 AS cadence_failed FROM orders),
         f AS (SELECT *, (channel // 1024 * 1024 + 512) * 2 - channel AS mirror_channel, abs(drift) * 15 <= 1 + 1e-6::DOUBLE AS stationary, {_bands} AS known_rfi_band, snr > 3.0::DOUBLE * 40.24::DOUBLE AS ood FROM h),
         p AS (SELECT a.hit_id AS i, b.hit_id AS j, a.snr AS si, b.snr AS sj FROM f a JOIN f b ON a.target = b.target AND a.hit_id <> b.hit_id AND abs(b.channel - a.mirror_channel) <= 3
                      AND abs(a.drift + b.drift) <= greatest(0.25, 0.1 * abs(a.drift)) WHERE a.mirror_channel >= 0),
         m AS (SELECT hit_id, bool_or(image) AS image FROM (
                 SELECT i AS hit_id, greatest(si, sj) < 2 * least(si, sj) OR NOT (sj < si OR (sj = si AND j < i)) AS image FROM p
                 UNION ALL SELECT j, greatest(si, sj) < 2 * least(si, sj) OR (sj < si OR (sj = si AND j < i)) FROM p) GROUP BY 1),
         s AS (SELECT f.*, coalesce(image, false) AS mirror_image, 0.55::DOUBLE * CASE WHEN NOT ood THEN coalesce(p_tech, 0.0) WHEN NOT stationary AND bandwidth_ch <= 4 AND on_fraction >= 0.5 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
                      + 0.20::DOUBLE * greatest(0.0, least(1.0, 1 - exp(-(snr - 10) / 10))) + 0.25::DOUBLE * coalesce(anomaly, 0.5) AS raw FROM f LEFT JOIN m ON m.hit_id = f.hit_id),
         v AS (SELECT *, round_even(100 * (raw * CASE WHEN stationary AND NOT drift_unresolved THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN known_rfi_band THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN bandwidth_ch > 8 THEN 0.4::DOUBLE ELSE 1 END
                      * CASE WHEN mirror_image THEN 0.2::DOUBLE ELSE 1 END * CASE WHEN ood THEN 0.3::DOUBLE ELSE 1 END) * 10, 0) / 10 AS v FROM s),
         c AS (SELECT a.hit_id, count_if(b.frequency_mhz BETWEEN a.frequency_mhz - 0.002::DOUBLE AND a.frequency_mhz + 0.002::DOUBLE) > 0 OR count(*) >= 2 AS other
               FROM f a JOIN f b ON b.target <> a.target AND b.frequency_mhz BETWEEN a.frequency_mhz - 0.025::DOUBLE AND a.frequency_mhz + 0.025::DOUBLE GROUP BY 1),
         w AS (SELECT v.*, coalesce(other, false) AS multi_target, CASE WHEN ood THEN least(v, 50.0) ELSE v END AS whole FROM v LEFT JOIN c ON c.hit_id = v.hit_id),
         x AS (SELECT *, CASE WHEN multi_target THEN round_even(whole * 0.2::DOUBLE * 10, 0) / 10 ELSE whole END AS interest,
                      CASE WHEN ood THEN 'out_of_distribution' WHEN coalesce(p_tech, -1) >= p_rfi AND coalesce(p_tech, -1) >= p_noise THEN 'technosignature_like' WHEN p_rfi >= p_noise THEN 'rfi_zero_drift' ELSE 'noise' END AS ai_class FROM w)
    SELECT hit_id, target, frequency_mhz, drift AS drift_rate_hz_s, snr, interest, ai_class,
           CASE WHEN mirror_image THEN 'mirror_image' WHEN cadence_failed THEN 'cadence_failed' WHEN multi_target THEN 'multi_target' WHEN known_rfi_band THEN 'known_rfi_band' WHEN stationary AND NOT drift_unresolved THEN 'stationary'
                WHEN ood THEN 'out_of_distribution' WHEN drift_unresolved THEN 'drift_unresolved' WHEN starts_with(ai_class, 'rfi_') THEN 'ai_rfi' WHEN ai_class = 'noise' THEN 'ai_noise' END AS reason,
           mirror_image, multi_target, row_number() OVER (ORDER BY interest DESC, hit_id) AS rank, row_number() OVER (PARTITION BY target ORDER BY interest DESC, hit_id) AS target_rank FROM x"""

LINKS_SQL = r"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1) AS hs FROM pages),
         e AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) AS scheme, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)) AS site,
                      regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) AS path, unnest(hs) AS h FROM p),
         b AS (SELECT page_id, scheme, CASE WHEN site <> '' THEN scheme || '://' || site END AS base, CASE WHEN path = '' THEN '/' ELSE path END AS path,
                      trim(regexp_replace(replace(regexp_replace(h, '^["'']|["'']$', '', 'g'), '&amp;', '&'), '#.*$', ''), ' ') AS h FROM e),
         w AS (SELECT page_id, CASE WHEN h = '' THEN NULL
                      WHEN regexp_matches(h, '^(?i)https?://[^/?#]') THEN lower(regexp_extract(h, '^[^/]*//[^/?#]*')) || regexp_replace(h, '^[^/]*//[^/?#]*', '')
                      WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                      WHEN starts_with(h, '//') THEN scheme || ':' || h WHEN starts_with(h, '/') THEN base || h
                      WHEN starts_with(h, '?') THEN base || path || h ELSE base || regexp_replace(path, '[^/]*$', '') || h END AS link FROM b),
         d AS (SELECT page_id, link, regexp_extract(link, '^[^/]*//[^/?#]*') AS front, regexp_extract(link, '^[^/]*//[^/?#]*([^?#]*)', 1) AS way FROM w WHERE link IS NOT NULL),
         l AS (SELECT DISTINCT page_id, CASE WHEN way = '' THEN front || '/' || regexp_replace(link, '^[^/]*//[^/?#]*', '') WHEN contains(way, '/.') THEN front || array_to_string(list_reduce(list_transform(split(way, '/'), lambda s: [s]),
                      lambda got, s: CASE WHEN s[1] = '..' THEN CASE WHEN len(got) > 1 THEN got[:-2] ELSE got END WHEN s[1] = '.' THEN got ELSE list_concat(got, s) END), '/')
                      || regexp_replace(link, '^[^/]*//[^/?#]*[^?#]*', '') ELSE link END AS link FROM d),
         n AS (SELECT link, count(*) AS n_pages, min(page_id) AS first_page, regexp_extract(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '[^/]*$') AS name FROM l GROUP BY link)
    SELECT link, regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2) AS host, lower(regexp_extract(name, '[.]([A-Za-z0-9]+)$', 1)) AS suffix,
           CASE WHEN lower(regexp_extract(name, '[.]([A-Za-z0-9]+)$', 1)) IN ('fil', 'h5') THEN 'observation' ELSE 'page' END AS kind,
           CASE WHEN regexp_matches(name, 'guppi_(\d{5})_(\d{5})_(.+)_\d{4}\.gpuspec\.(.+)$') THEN regexp_extract(name, 'guppi_(\d{5})_(\d{5})_(.+)_\d{4}\.gpuspec\.(.+)$', 3) END AS object,
           TRY_CAST(regexp_extract(name, 'guppi_(\d{5})_(\d{5})_(.+)_\d{4}\.gpuspec\.(.+)$', 1) AS INTEGER) + TRY_CAST(regexp_extract(name, 'guppi_(\d{5})_(\d{5})_(.+)_\d{4}\.gpuspec\.(.+)$', 2) AS INTEGER) / 86400.0::DOUBLE AS mjd,
           n_pages, first_page FROM n"""


def oracle_sql() -> dict[str, str]:
    return {"job1_catalogue": CATALOGUE_SQL, "job2_links": LINKS_SQL}
