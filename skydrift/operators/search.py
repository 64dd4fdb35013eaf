"""An observation end to end: units are read, normalised, searched and measured in one stage of tasks, then
scored and checked against each other as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.exprs import in_bands
from ..sources.filterbank import guard_band
from .dedoppler import nms_window
from .features import SCALARS
from .kernel import peaks, search
from .detect import pulse_array, spike_array
from .learn import anomalies, image, measures, normalized
from .rfi import mirror_pairs
from .score import best_class, interest

HITS = "unit_id string, location string, channel long, drift double, drift_rate_hz_s double, frequency_mhz double, stationary boolean, drift_unresolved boolean, mirror_channel long, n_channels long, n_t int, n_spikes long, seconds double, error string, " + ", ".join(f"{s} double" for s in SCALARS) + ", img array<double>, drift_searched_hz_s double, degraded boolean, stage_seconds map<string,double>, " + "spikes array<struct<t:int,channel:long,power_sigma:double,isolated:boolean>>, pulses array<struct<i:int,dm:double,w:int,t:int,snr:double,likely_rfi:boolean>>"


def nfine_of(foff: float, nchans: int) -> int | None:
    """As axis.fine_per_coarse."""
    if not foff:
        return None
    n = 2.9296875e6 / abs(foff * 1e6)
    p = round(float(np.log2(n))) if n > 1 else 0
    return 1 << p if p > 0 and abs((1 << p) - n) / n < 0.01 and nchans % (1 << p) == 0 else None


def guard(h, cfg: SearchConfig) -> int:
    """Channels of padding on each side of a unit's core."""
    return guard_band(h, cfg.max_drift_rate_hz_s, cfg.max_drift_ch_per_step)


def cut(cfg: SearchConfig) -> dict[str, str]:
    """The options of the filterbank source under these settings: each file with the guard bands that its header asks for."""
    return {"width": str(cfg.channels_per_unit), "pad": "drift", "drift_rate": str(cfg.max_drift_rate_hz_s), "drift_steps": str(cfg.max_drift_ch_per_step), "most_mb": str(cfg.max_download_mb)}


def searched(units: DataFrame, cfg: SearchConfig, nfine: int | None = None) -> DataFrame:
    """units as the filterbank source gives them: a row for each hit, and one for each unit without hits or with
    an error. A hit is reported by the unit whose core it begins in. Fine channels of a coarse one follow from each
    unit's own header, if nfine doesn't say."""

    def one(unit_id, location, n_t, n_f, chan_start, core_start, core_stop, nchans, fch1, foff, tsamp, raw) -> tuple[list[dict], dict]:
        import time

        nfine = given or (nfine_of(foff, nchans) if nchans else None)

        clock = [time.perf_counter()]
        z = np.frombuffer(raw, "<f8").reshape(n_t, n_f).copy()
        if nfine and cfg.remove_dc_spike:
            for c in range((nfine // 2 - chan_start) % nfine, n_f, nfine):
                z[:, c] = 0.5 * (z[:, max(c - 1, 0)] + z[:, min(c + 1, n_f - 1)])
        z = normalized(z, cfg.bandpass_block)
        clock.append(time.perf_counter())
        hz = abs(foff) * 1e6
        if hz * tsamp > 1e6:
            raise ValueError("foff must be in MHz")
        need = cfg.max_drift_rate_hz_s * tsamp / hz if hz else 1.0
        k = max(0, min(int(np.ceil(need)) - 1, cfg.max_drift_ch_per_step - 1, n_f // max(n_t, 1) - 1))
        snr, drift = search(z.astype(np.float32), k, need)
        clock.append(time.perf_counter())
        out, tracks = [], []
        for c in peaks(snr, nms_window(n_t, n_f, k), cfg.snr_threshold, cfg.max_hits_per_unit):
            at, d = int(c) + chan_start, float(drift[c])
            found = dict(zip(SCALARS, measures(z, int(c), d, float(snr[c]))))
            tracks.append((float(c), d, found["bandwidth_ch"]))
            if not core_start <= at < core_stop:
                continue
            dc = at // nfine * nfine + nfine // 2 if nfine else None
            out.append({"channel": at, "drift": d, "drift_rate_hz_s": d * foff * 1e6 / tsamp, "frequency_mhz": fch1 + foff * at, "stationary": abs(d) * max(n_t - 1, 1) <= 1 + 1e-6, "drift_unresolved": bool(hz and cfg.max_drift_rate_hz_s * n_t * tsamp < hz), "mirror_channel": 2 * dc - at if dc is not None else -1, "img": image(z, int(c), d).tolist()} | found)
        clock.append(time.perf_counter())
        lo, hi = core_start - chan_start, core_stop - chan_start
        spikes = spike_array(z, tracks, cfg.spike_threshold, lo, hi)
        pulses = pulse_array(z, fch1 + foff * (chan_start + np.arange(n_f)), tsamp, cfg.pulse_threshold, cfg.max_dm, cfg.n_dm_trials)
        clock.append(time.perf_counter())
        wanted = max(0, min(int(np.ceil(need)) - 1, cfg.max_drift_ch_per_step - 1))
        return out, {
            "n_channels": core_stop - core_start, "n_t": n_t, "n_spikes": int((z[:, lo:hi] >= cfg.spike_threshold).sum()), "seconds": clock[-1] - clock[0],
            "drift_searched_hz_s": min(cfg.max_drift_rate_hz_s, (k + 1) * hz / tsamp) if hz and tsamp else cfg.max_drift_rate_hz_s, "degraded": k < wanted,
            "stage_seconds": dict(zip(("preprocess", "dedoppler", "features", "detectors"), np.diff(clock).tolist())),
            "spikes": [s | {"channel": s["channel"] + chan_start} for s in spikes], "pulses": pulses}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind, given = to_arrow_schema(_parse_datatype_string(HITS)), nfine

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *args, error in zip(*(batch.column(k).to_pylist() for k in range(13))):
                try:
                    if error:
                        raise OSError(error)
                    got, stats = one(*args)
                    rows += [{"unit_id": args[0], "location": args[1]} | h | (stats if n == 0 else {}) for n, h in enumerate(got or [{}])]
                except Exception as e:  # noqa: BLE001 - a unit that fails is a row that says why
                    rows.append({"unit_id": args[0], "location": args[1], "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    lacking = {c: F.lit(None).cast(t) for c, t in (("location", "string"), ("nchans", "long")) if c not in units.columns}
    return units.withColumns(lacking).select("unit_id", "location", "n_t", "n_f", "chan_start", "core_start", "core_stop", "nchans", "fch1", "foff", "tsamp", "z", "error").mapInArrow(task, HITS)


def unpacked(units: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Samples (obs, t, c, z) of units as the filterbank source gives them, normalised; obs is the unit's first channel."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n_t, n_f, first, raw, error in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if error:
                    raise OSError(error)
                z = normalized(np.frombuffer(raw, "<f8").reshape(n_t, n_f), cfg.bandpass_block)
                for t in range(n_t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n_f, first)), pa.array(np.full(n_f, t, np.int32)), pa.array(np.arange(n_f, dtype=np.int32)), pa.array(z[t])], names=["obs", "t", "c", "z"])

    return units.select("n_t", "n_f", "chan_start", "z", "error").mapInArrow(task, "obs long, t int, c int, z double")


def spikes_of(hits: DataFrame) -> DataFrame:
    """Single samples of all units that lie on no track."""
    return hits.where("spikes IS NOT NULL").select("unit_id", F.explode("spikes").alias("s")).select("unit_id", "s.*").where("isolated").drop("isolated")


def pulses_of(hits: DataFrame) -> DataFrame:
    """Dispersed and undispersed pulses of all units."""
    return hits.where("pulses IS NOT NULL").select("unit_id", F.explode("pulses").alias("p")).select("unit_id", "p.*")


def candidates(hits: DataFrame, cfg: SearchConfig, model=None, run: str | Column = "run") -> DataFrame:
    """Hits with anomaly, flags, interest and class. Mirror images are looked for within a file, by its location."""
    from .learn import LABELS, probabilities

    stem = F.regexp_replace("unit_id", ":[^:]*$", "")
    h = hits.where("channel IS NOT NULL").withColumns({"file": F.coalesce("location", stem), "run": F.lit(run) if isinstance(run, str) else run})
    h = h.withColumn("hit_id", F.xxhash64("location", "unit_id", "channel", "drift"))
    h = mirror_pairs(h).withColumn("file", stem)
    h = h.join(anomalies(h), "hit_id", "left").withColumn("known_rfi_band", in_bands("frequency_mhz", cfg.known_rfi_bands_mhz))
    if model is not None and cfg.use_ai:
        h = interest(probabilities(model, h), cfg.snr_threshold, getattr(model, "snr_max", None))
        return h.withColumns({"ai_class": F.when(F.col("ood"), "out_of_distribution").otherwise(best_class([f"p_{x}" for x in LABELS])), "status": F.lit("unverified")})
    h = interest(h, cfg.snr_threshold, any_probability=False)
    return h.withColumns({"ai_class": F.lit("model_unavailable" if cfg.use_ai else "ai_disabled"), "status": F.lit("unverified")})
