"""Settings of filters, sources and sessions, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from tidemark.functions.layout import LAYOUTS, StateLayout, get_layout
from tidemark.functions.numeric import GATES


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


# Names and defaults of the settings below, in every class, so that session files load alike.


@dataclass(frozen=True)
class FilterConfig:
    """Settings of the recursive filters.  Variances in SI units; densities per root hertz."""

    state_mode: str = "2d_cam_3d_imu"
    # process noise rates
    process_noise_pos: float = 1e-4
    process_noise_vel: float = 5e-3
    process_noise_heading: float = 5e-4
    process_noise_gyro_bias: float = 5e-8
    process_noise_accel_bias: float = 2e-5
    imu_gyro_noise_density: float = 1.7453e-4
    imu_accel_noise_density: float = 1.96133e-3
    imu_gravity_body: tuple[float, float, float] = (0.0, 0.0, 9.81)
    damping_coeff: float = 0.2
    enable_experimental_accel_translation: bool = False
    # camera
    measurement_noise_pos: float = 1e-4
    led_distance: float | None = 0.04
    use_mahalanobis_gating: bool = True
    mahalanobis_threshold_prob: float = 0.997
    num_iter: int = 1
    # heading from the LED pair
    use_heading_measurement: bool = True
    measurement_noise_heading: float = 2.5e-3
    led_distance_tolerance: float = 0.3
    adaptive_heading_noise: bool = True
    # without vision
    adaptive_q_during_dropout: bool = True
    dropout_q_pos_multiplier: float = 2.0
    dropout_q_vel_multiplier: float = 2.0
    dropout_q_bias_multiplier: float = 0.5
    freeze_bias_during_blackout: bool = True
    reduce_imu_noise_during_blackout: bool = True
    blackout_imu_noise_scale: float = 0.3
    # gravity direction, quaternion layouts
    use_gravity_orientation_update: bool = True
    gravity_orientation_measurement_noise: float = 2.5e-3
    gravity_accel_magnitude_tolerance_m_s2: float = 0.5
    gravity_gyro_norm_threshold_rad_s: float = 0.2
    # zero velocity
    enable_zupt: bool = True
    zupt_velocity_threshold: float = 0.02
    zupt_measurement_noise: float = 1e-4
    zupt_gyro_threshold_rad_s: float = 0.02
    zupt_accel_threshold_m_s2: float = 1.5
    zupt_camera_stationary_window_frames: int = 10
    zupt_visual_context_hold_frames: int = 10
    # sigma points
    alpha: float = 1.732
    beta: float = 2.0
    kappa: float = 1.0

    def __post_init__(self) -> None:
        _check(self.state_mode in LAYOUTS, f"unknown state_mode {self.state_mode!r}; one of {sorted(LAYOUTS)}")
        positive = {"measurement_noise_pos", "measurement_noise_heading", "gravity_orientation_measurement_noise", "zupt_measurement_noise", "alpha"}
        free = {"beta", "kappa"}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool":
                _check(isinstance(value, bool), f"{f.name} must be a bool")
            elif f.type == "float":
                _check(isinstance(value, (int, float)) and math.isfinite(value), f"{f.name} must be finite")
                _check(f.name in free or value > 0 or (value == 0 and f.name not in positive), f"{f.name} must be {'positive' if f.name in positive else '0 or more'}")
        _check(len(self.imu_gravity_body) == 3 and all(map(math.isfinite, self.imu_gravity_body)), "imu_gravity_body must be three finite numbers")
        _check(self.led_distance is None or (math.isfinite(self.led_distance) and self.led_distance > 0), "led_distance must be positive or None")
        _check(not self.use_mahalanobis_gating or any(abs(p - self.mahalanobis_threshold_prob) < 1e-3 for p in GATES), f"mahalanobis_threshold_prob must be one of {sorted(GATES)}")
        _check(not (self.state_mode == "vision_only" and self.enable_zupt), "vision_only needs enable_zupt=False")
        for name, least in (("zupt_camera_stationary_window_frames", 1), ("zupt_visual_context_hold_frames", 0), ("num_iter", 1)):
            value = getattr(self, name)
            _check(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name} must be an integer of at least {least}")
        _check(self.alpha**2 * (self.layout.n + self.kappa) >= 0.01, "alpha and kappa give sigma points without spread")

    @property
    def layout(self) -> StateLayout:
        return get_layout(self.state_mode)

    @property
    def sigma_scaling(self) -> float:
        """lambda of the unscented transform."""
        n = self.layout.n
        return self.alpha**2 * (n + self.kappa) - n

    def with_led_distance(self, distance: float) -> FilterConfig:
        return replace(self, led_distance=distance)

    @classmethod
    def vision_only(cls, **changes: Any) -> FilterConfig:
        return cls(**{"state_mode": "vision_only", "enable_zupt": False, "use_mahalanobis_gating": False} | changes)

    @classmethod
    def conservative(cls, **changes: Any) -> FilterConfig:
        """Narrow sigma points."""
        return cls(**{"alpha": 0.5, "beta": 2.0, "kappa": 0.0} | changes)

    @classmethod
    def aggressive(cls, **changes: Any) -> FilterConfig:
        """Wide sigma points, the default."""
        return cls(**{"alpha": 1.732, "beta": 2.0, "kappa": 1.0} | changes)


@dataclass(frozen=True)
class OrientationConfig:
    """Gains and gates of the complementary orientation filter."""

    gravity_m_s2: float = 9.80665
    accel_magnitude_tolerance_m_s2: float = 0.5
    gyro_norm_threshold_rad_s: float = 0.2
    camera_speed_threshold_m_s: float | None = None
    accel_correction_gain: float = 2.0
    accel_bias_correction_gain: float = 0.02
    camera_yaw_correction_gain: float = 0.2
    camera_yaw_bias_correction_gain: float = 0.02
    initial_gyro_bias: tuple[float, float, float] | None = None
    initial_quaternion: tuple[float, float, float, float] | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (int, float)):
                _check(math.isfinite(value) and (value > 0 if f.name == "gravity_m_s2" else value >= 0), f"{f.name} is out of range")
        if self.initial_quaternion is not None:
            _check(0.5 < math.sqrt(sum(x * x for x in self.initial_quaternion)) < 2, "initial_quaternion must be near unit length")


@dataclass(frozen=True)
class LedIdentityConfig:
    """Two-state label correction: 0 as recorded, 1 swapped."""

    mode: str = "auto"
    initial_state: str = "auto"
    transition_penalty: float = 10.0
    gyro_weight: float = 0.0
    max_speed_mps: float = 2.0

    def __post_init__(self) -> None:
        _check(self.mode in ("auto", "none") and self.initial_state in ("auto", "original", "swapped"), "unknown mode or initial_state")
        _check(self.transition_penalty >= 0 and self.gyro_weight >= 0 and self.max_speed_mps > 0, "weights must not be negative, max_speed_mps positive")


@dataclass(frozen=True)
class EventSource:
    """Where a trigger is and how well that fixes a position."""

    source_id: int
    kind: str
    anchor: tuple[float, float]
    cov: tuple[float, float, float, float]
    active_edge: str
    label: str = ""

    def __post_init__(self) -> None:
        _check(self.kind in ("beam", "zone", "rfid") and self.active_edge in ("rise", "fall"), "unknown kind or edge")
        a, b, c, d = self.cov
        _check(all(map(math.isfinite, (*self.anchor, *self.cov))) and abs(b - c) < 1e-12 and a >= 0 and d >= 0 and a * d - b * c >= -1e-15, "cov must be symmetric and positive")

    @classmethod
    def beam(cls, source_id: int, emitter: tuple[float, float], receiver: tuple[float, float], sigma_perp: float = 0.005, active_edge: str = "fall", label: str = "") -> EventSource:
        """A light beam: its middle, uniform along its length, narrow across."""
        dx, dy = receiver[0] - emitter[0], receiver[1] - emitter[1]
        length = math.hypot(dx, dy)
        across = sigma_perp**2
        along = max(sigma_perp, length / math.sqrt(12)) ** 2
        ux, uy = (dx / length, dy / length) if length > 0 else (1.0, 0.0)
        if length == 0:
            along = across
        cov = (along * ux * ux + across * uy * uy, (along - across) * ux * uy, (along - across) * ux * uy, along * uy * uy + across * ux * ux)
        return cls(source_id, "beam", ((emitter[0] + receiver[0]) / 2, (emitter[1] + receiver[1]) / 2), cov, active_edge, label)

    @classmethod
    def zone(cls, source_id: int, center: tuple[float, float], sigma: float, active_edge: str = "rise", label: str = "") -> EventSource:
        return cls(source_id, "zone", tuple(center), (sigma**2, 0.0, 0.0, sigma**2), active_edge, label)

    @classmethod
    def rfid(cls, source_id: int, center: tuple[float, float], radius: float, active_edge: str = "rise", label: str = "") -> EventSource:
        return cls(source_id, "rfid", tuple(center), (radius**2 / 2, 0.0, 0.0, radius**2 / 2), active_edge, label)


@dataclass(frozen=True)
class ImuColumns:
    """Columns of raw inertial tables, their signs and scales to SI."""

    time: str = "time"
    axes: dict[str, str] = field(default_factory=lambda: {"gx": "Headstage_GyroX", "gy": "Headstage_GyroY", "gz": "Headstage_GyroZ", "ax": "Headstage_AccelX", "ay": "Headstage_AccelY", "az": "Headstage_AccelZ"})
    signs: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("gx", "gy", "gz", "ax", "ay", "az"), 1))
    gyro_dps_per_lsb: float = 0.061
    accel_g_per_lsb: float = 0.000061
    dedup: str = "gyro_z"

    def __post_init__(self) -> None:
        names = {"gx", "gy", "gz", "ax", "ay", "az"}
        _check(set(self.axes) == names and set(self.signs) == names, f"axes and signs need exactly {sorted(names)}")
        _check(all(s in (-1, 1) for s in self.signs.values()), "signs must be 1 or -1")
        _check(self.dedup in ("gyro_z", "any_axis", "none"), "dedup must be gyro_z, any_axis or none")


@dataclass(frozen=True)
class CameraColumns:
    """Columns of raw position tables and their scale to metres."""

    time: str = "time"
    x1: str = "xloc"
    y1: str = "yloc"
    x2: str = "xloc2"
    y2: str = "yloc2"
    meters_per_pixel: float = 1.0
    confidence: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        _check(self.meters_per_pixel > 0, "meters_per_pixel must be positive")
        _check(self.confidence is None or len(self.confidence) == 2, "name both confidence columns or neither")


@dataclass(frozen=True)
class CalibrationGates:
    """What inertial data must show before they are fused."""

    run: bool = True
    min_stationary: int = 10
    min_yaw_corr: float = 0.5
    max_horizontal_gravity: float = 1.0
    min_accel_corr: float = 0.1


@dataclass(frozen=True)
class SafetyLimits:
    run: bool = True
    envelope_multiplier: float = 1.5
    extra_range_m: float = 0.25
    max_speed_mps: float = 2.0
    max_position_deviation_m: float = 0.5
    p95_position_deviation_m: float = 0.25
    min_dual_led_frames: int = 1


@dataclass(frozen=True)
class SessionConfig:
    """Everything about a run; paths stand relative to the file that named them."""

    imu_file: str | None = None
    position_file: str | None = None
    events_file: str | None = None
    imu: ImuColumns = field(default_factory=ImuColumns)
    camera: CameraColumns = field(default_factory=CameraColumns)
    filter: FilterConfig = field(default_factory=FilterConfig)
    led_identity: LedIdentityConfig = field(default_factory=LedIdentityConfig)
    gates: CalibrationGates = field(default_factory=CalibrationGates)
    safety: SafetyLimits = field(default_factory=SafetyLimits)
    sources: tuple[EventSource, ...] = ()
    max_events_per_frame: int | None = None
    imu_offset_s: float = 0.0
    camera_offset_s: float = 0.0

    def __post_init__(self) -> None:
        ids = [s.source_id for s in self.sources]
        _check(len(ids) == len(set(ids)), "source ids must be unique")
        _check(self.max_events_per_frame is None or self.max_events_per_frame >= 1, "max_events_per_frame must be 1 or more")


_SECTIONS = {"imu": ImuColumns, "camera": CameraColumns, "filter": FilterConfig, "led_identity": LedIdentityConfig, "gates": CalibrationGates, "safety": SafetyLimits}


def _section(kind: type, name: str, given: dict[str, Any]) -> Any:
    unknown = set(given) - {f.name for f in fields(kind)}
    _check(not unknown, f"unknown keys in {name}: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load_session_config(path: str | Path) -> SessionConfig:
    """A YAML file's settings; unknown keys are errors, relative paths start at its folder."""
    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text()) or {}
    out: dict[str, Any] = {}
    for key, value in raw.items():
        if key in _SECTIONS:
            if key == "filter" and value.get("state_mode") == "vision_only":
                value = {"enable_zupt": False, "use_mahalanobis_gating": False} | value
            out[key] = _section(_SECTIONS[key], key, value)
        elif key == "sources":
            out[key] = tuple(getattr(EventSource, s["kind"])(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k != "kind"}) for s in value)
        elif key in ("imu_file", "position_file", "events_file"):
            out[key] = value if "://" in value or Path(value).is_absolute() else str(path.parent / value)
        else:
            _check(key in {f.name for f in fields(SessionConfig)}, f"unknown key {key}")
            out[key] = value
    return SessionConfig(**out)
