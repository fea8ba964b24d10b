"""Row types of detections, tracks, scenarios and projects, and the configurations of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Sensor constants: sample rate, FFT length, overlap of windows, least signal, width of a frequency bin, window step.
SAMPLE_KHZ, FFT_LENGTH, FFT_OVERLAP, SNR_MIN_DB = 200, 512, 2, 19
BIN_KHZ = SAMPLE_KHZ / FFT_LENGTH
WINDOW_MS = FFT_LENGTH / FFT_OVERLAP / SAMPLE_KHZ

#: Length of the buckets of time that a recording is dealt to tasks by: an hour.
BUCKET_MS = 3_600_000

DETECTION = "recording_id string, line_no long, time_ms long, pos_fme int, pos_fi int, pos_ft int, duration_windows int, snr_db int"
METADATA = "recording_id string, freq_khz double, lenfft double, overlap double, snr_min double, bin_khz double"
TRUTH = "dataset string, scenario_id string, case_type string, replicate_id int, individual_id string, species string, start_ms long, end_ms long, expected_count int, n_chirps int, fme_khz double, ici_ms double, phase string, notes string"
SCENARIO = "dataset string, scenario_id string, case_type string, replicate_id int, start_ms long, end_ms long, expected_count int, parameter_name string, parameter_value double"
TRACK_CSV = "track_id string, passage_id long, packet_id string, passage_species string, start_time_ms long, end_time_ms long, n_chirps int, fme_median_khz double, ici_median_ms double, suspicious_short_ici boolean"
#: A clip of a project: generated sequences and noise, and imported ones; the other kind's fields are null.
CLIP = (
    "clip_id string, kind string, track_id string, species_id string, species_name string, individual_id string, sequence_id string, start_ms double, duration_ms double, phase string,"
    " fme_khz double, fi_khz double, ft_khz double, chirp_duration_ms double, ici_mean_ms double, ici_jitter double, fme_std_khz double, snr_mean_db double, snr_std_db double,"
    " echo_enabled boolean, echo_probability double, echo_delay_min_ms double, echo_delay_max_ms double, echo_snr_loss_db double, echo_fme_delta_bins int, seed long,"
    " store_id string, row_start int, row_end int, original_start_ms double, ici_median_ms double"
)
SIM_DETECTION = "detection_id string, time_ms long, pos_fme int, pos_fi int, pos_ft int, pos_duration int, snr_db int, fme_khz double, fi_khz double, ft_khz double, individual_id string, species_name string, sequence_id string, is_echo boolean, is_noise boolean, source_clip_id string"


def struct(ddl: str) -> T.StructType:
    """The type of a DDL string."""
    return T._parse_datatype_string(ddl)  # type: ignore[return-value]


@dataclass(frozen=True)
class PreprocessConfig:
    """Gaps in ms and bins; strategy is drop_later or best_snr. bucket_ms cuts recordings into buckets of time; None orders each in one task."""

    passage_gap_ms: float = 100.0
    echo_gap_ms: float = 10.0
    echo_bins: float = 1.0
    fme_min_khz: float = 18.0
    min_passage_chirps: int = 1
    strategy: str = "drop_later"
    bin_khz: float = BIN_KHZ
    bucket_ms: int | None = BUCKET_MS

    def __post_init__(self) -> None:
        if self.strategy not in ("drop_later", "best_snr"):
            raise ValueError(f"unknown echo strategy: {self.strategy}")


@dataclass(frozen=True)
class MixtureConfig:
    """Density and mixture of frequencies; flavor is canonical or web, which differ in bandwidth, peaks and limits. n_init
    starts are made, the later ones drawn by the seed, and the likeliest model stays."""

    bandwidth: str | float = "scott"
    scale: float = 1.0
    prominence: float = 0.05
    min_distance_khz: float | None = None
    max_components: int = 8
    grid: int = 1000
    flavor: str = "canonical"
    n_init: int = 1
    seed: int = 0

    def __post_init__(self) -> None:
        if self.n_init < 1:
            raise ValueError("at least one start is needed")
        if self.max_components < 1 or self.grid < 3:
            raise ValueError("at least one component and three grid points are needed")
        if self.scale <= 0 or (isinstance(self.bandwidth, str) and self.bandwidth not in ("scott", "silverman")):
            raise ValueError("the bandwidth is scott, silverman or a factor, its scale above zero")


@dataclass(frozen=True)
class SplitConfig:
    """When and how a passage is split into species packets."""

    min_chirps: int = 15
    max_components: int = 4
    scale: float = 1.35
    prominence: float = 0.12
    distance_khz: float = 4.0


@dataclass(frozen=True)
class TrackingConfig:
    """Tolerances of the tracker."""

    ici_tolerance: float = 0.30
    fme_tolerance_bins: float = 2.0
    expiry_icis: float = 3.0
    min_chirps: int = 3
    bootstrap_ici_ms: float = 100.0
    suspicious_ici_ms: float = 45.0
