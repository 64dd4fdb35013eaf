"""Search settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

# Bands that satellites and radio services use, in MHz.
KNOWN_BANDS_MHZ = ((1164.0, 1189.0), (1215.0, 1240.0), (1200.0, 1341.0), (1559.0, 1591.0), (1597.0, 1607.0), (1616.0, 1626.5), (1525.0, 1559.0))


@dataclass(frozen=True)
class SearchConfig:
    # Names and defaults of the settings, as settings files have them.
    channels_per_unit: int = 262144
    max_drift_rate_hz_s: float = 4.0
    max_drift_ch_per_step: int = 32
    bandpass_block: int = 512
    remove_dc_spike: bool = True
    fine_channels_per_coarse: int | None = None
    snr_threshold: float = 10.0
    spike_threshold: float = 9.0
    pulse_threshold: float = 8.0
    max_hits_per_unit: int = 500
    max_dm: float = 1000.0
    n_dm_trials: int = 64
    use_ai: bool = True
    anomaly_contamination: float = 0.05
    model_path: str | None = None
    multi_target_tol_khz: float = 2.0
    multi_target_band_khz: float = 25.0
    multi_target_band_hits: int = 2
    share_to: tuple[str, ...] = ("bundle",)
    share_min_interest: float = 70.0
    share_top: int = 3
    share_require_cadence: bool | None = None
    github_repo: str | None = None
    webhook_url: str | None = None
    webhook_format: str = "json"
    reporter_handle: str | None = None
    workers: int = 0
    max_download_mb: int = 2048
    known_rfi_bands_mhz: tuple[tuple[float, float], ...] = KNOWN_BANDS_MHZ

    @classmethod
    def load(cls, path: str | None) -> SearchConfig:
        """From a JSON file; unknown keys, and a file that isn't there, are passed over."""
        try:
            with open(path or "") as f:
                given = json.load(f)
        except FileNotFoundError:
            return cls()
        known = {f.name for f in fields(cls)}
        made = {k: v for k, v in given.items() if k in known}
        for k in ("share_to", "known_rfi_bands_mhz"):
            if k in made:
                made[k] = tuple(tuple(x) if isinstance(x, list) else x for x in made[k])
        return cls(**made)

    def to_dict(self) -> dict:
        return asdict(self)
