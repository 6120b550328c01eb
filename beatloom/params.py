"""Fixed parameters of the physiological pipeline, in place of a mutable configuration file."""

from __future__ import annotations

from dataclasses import dataclass, field

# Keyword lists, rule order, channel neighbours, bands and windows that results depend on.
ECG_KEYWORDS = ("ecg", "ekg", "cardiac", "heart", "bio1")
PPG_KEYWORDS = ("ppg", "pleth", "pulse", "photo", "bio2", "bio3")
REST_KEYWORDS = ("rest", "baseline", "resting", "fixation", "eyes_closed", "eyes_opened")
CONDITION_INTS = {"simultaneous": 0, "slow": 1, "fast": 2, "fast_delay": 3}
DISCOVERY_PATTERNS = (
    ("simultaneous", ("simultaneous", "simul", "sim", "all_at_once", "encoding_set_simultaneous")),
    ("slow", ("slow", "slow_seq", "slow_sequential", "seq_slow", "retention_slow")),
    ("fast", ("fast", "fast_seq", "fast_sequential", "seq_fast", "retention_fast")),
    ("fast_delay", ("fast_delay", "fastdelay", "fast+delay", "delay_fast", "fd", "fast_del", "retention_fastdelay", "retention_fast_delay")),
)
LABEL_COLUMNS = ("trial_type", "condition", "description", "event_type", "stim_type", "value", "event_name", "label")
ONSET_COLUMNS = ("onset", "onset_s", "onset_sec", "onset (s)", "time")
NEIGHBOURS = {
    "Fz": ("F1", "F2", "AFz", "FCz"),
    "FCz": ("FC1", "FC2", "Cz", "Fz"),
    "Cz": ("C1", "C2", "FCz", "CPz"),
    "F3": ("F1", "F5", "AF3", "FC3"),
    "F4": ("F2", "F6", "AF4", "FC4"),
    "FC3": ("FC1", "FC5", "C3", "F3"),
    "FC4": ("FC2", "FC6", "C4", "F4"),
    "Pz": ("P1", "P2", "POz", "CPz"),
    "CPz": ("CP1", "CP2", "Pz", "Cz"),
}
BANDS = {"theta": (4.0, 7.0), "alpha_low": (8.0, 10.0), "alpha_high": (10.0, 13.0), "beta_low": (13.0, 18.0)}
PPG_FEATURES = (
    "ibi_mean", "ibi_range", "ibi_slope", "ibi_r2", "ibi_samp_en", "ibi_d1_mean",
    "ppg_amp_mean", "ppg_amp_var", "ppg_rise_mean", "ppg_width_mean", "ppg_area_mean", "ppg_area_var",
)
POSTERIOR = ("O1", "O2", "Oz", "P7", "P8", "P3", "P4", "Pz", "PO3", "PO4")
FRONTAL = ("Fz", "FCz", "Cz", "F3", "F4", "FC3", "FC4", "AFz", "AF3", "AF4")
MIN_FILE_BYTES = 1_048_576


@dataclass(frozen=True)
class Params:
    """Parameters of a run; times in seconds."""

    fs: float = 1000.0
    tmin: float = 0.0
    tmax: float = 6.0
    beat_before: float = 0.4
    beat_after: float = 0.4
    decimation: int = 5
    rest_min_beats: int = 3
    rr_length: int = 10
    wavelet: str = "as_computed"  # or "frequency_scaled"
    targets: tuple[str, ...] = field(default=tuple(NEIGHBOURS))

    @property
    def n_times(self) -> int:
        """Samples of a decimated beat window."""
        return -(-(int(self.beat_before * self.fs) + int(self.beat_after * self.fs)) // self.decimation)
