"""Orientation from gyroscope and accelerometer, nudged by camera headings: a complementary filter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.functions import numeric as nm
from tidemark.plans.config import OrientationConfig


@dataclass
class Orientation:
    quaternions: np.ndarray
    biases: np.ndarray
    gravity_used: np.ndarray
    camera_used: np.ndarray
    camera_heading: np.ndarray

    def angles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return nm.euler_angles(self.quaternions)

    def diagnostics(self) -> dict[str, float | None]:
        roll, pitch, yaw = self.angles()
        norm = np.linalg.norm(self.quaternions, axis=1)
        seen = np.isfinite(self.camera_heading)
        rmse = float(np.sqrt(np.mean(nm.wrap_angle(yaw[seen] - self.camera_heading[seen]) ** 2))) if seen.any() else None
        spans = {f"{name}_{end}": float(f(a)) for name, a in (("roll", roll), ("pitch", pitch), ("yaw", yaw)) for end, f in (("min", np.min), ("max", np.max))}
        return {"norm_min": float(norm.min()), "norm_max": float(norm.max()), **spans, "gravity_fraction": float(self.gravity_used.mean()), "camera_fraction": float(self.camera_used.mean()), "yaw_camera_rmse": rmse}


def camera_on_samples(t: np.ndarray, t_cam: np.ndarray, leds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heading at the first sample from each dual frame on (NaN elsewhere; the later of two frames wins), and speed at all samples."""
    dual = np.isfinite(leds).all(axis=(1, 2))
    if dual.sum() < 2:
        raise ValueError("camera headings need two frames with both LEDs")
    delta = leds[dual, 1] - leds[dual, 0]
    heading = np.full(len(t), np.nan)
    at = np.searchsorted(t, t_cam[dual], side="left")
    inside = at < len(t)
    heading[at[inside]] = np.unwrap(np.arctan2(delta[:, 1], delta[:, 0]))[inside]
    index = np.arange(len(t_cam))
    middle = leds.mean(axis=1)
    filled = np.stack([np.interp(index, index[dual], middle[dual, c]) for c in range(2)], axis=1)
    velocity = np.gradient(filled, t_cam, axis=0, edge_order=2 if len(t_cam) > 2 else 1)
    return heading, np.interp(t, t_cam, np.linalg.norm(velocity, axis=1))


def estimate(cfg: OrientationConfig, t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, t_cam: np.ndarray | None = None, leds: np.ndarray | None = None) -> Orientation:
    """One quaternion and gyro bias a sample.  The gyro of the sample before turns; the gravity of this one corrects."""
    n = len(t)
    if n < 2 or gyro.shape != (n, 3) or accel.shape != (n, 3) or not all(np.isfinite(a).all() for a in (t, gyro, accel)) or not (np.diff(t) > 0).all():
        raise ValueError("two or more finite samples of three axes at ascending times are needed")
    heading, speed = np.full(n, np.nan), None
    if t_cam is not None:
        heading, speed = camera_on_samples(t, t_cam, leds)
    size = np.linalg.norm(accel, axis=1)
    calm = (np.abs(size - cfg.gravity_m_s2) <= cfg.accel_magnitude_tolerance_m_s2) & (np.linalg.norm(gyro, axis=1) <= cfg.gyro_norm_threshold_rad_s) & (size > 0)
    if cfg.camera_speed_threshold_m_s is not None:
        if speed is None:
            raise ValueError("a camera speed threshold needs camera frames")
        calm &= speed <= cfg.camera_speed_threshold_m_s
    up = np.array([0.0, 0.0, 1.0])
    if cfg.initial_quaternion is not None:
        q = nm.canonical_quaternion(np.array(cfg.initial_quaternion, float))
    else:
        q = nm.align_vectors(np.median(accel[calm], axis=0), up) if calm.any() else np.eye(4)[0]
    bias = np.array(cfg.initial_gyro_bias or (0.0, 0.0, 0.0), float)
    quaternions, biases = np.empty((n, 4)), np.empty((n, 3))
    quaternions[0], biases[0] = q, bias
    seen = np.isfinite(heading)
    seen[0] = False
    for i in range(1, n):
        dt = t[i] - t[i - 1]
        q = nm.canonical_quaternion(nm.integrate_gyro(q, gyro[i - 1] - bias, dt))
        if calm[i]:
            error = np.cross(accel[i] / size[i], nm.world_to_body(q, up))
            bias = bias - cfg.accel_bias_correction_gain * error * dt
            q = nm.canonical_quaternion(nm.integrate_gyro(q, cfg.accel_correction_gain * error, dt))
        if seen[i]:
            error = float(nm.wrap_angle(heading[i] - nm.quaternion_yaw(q)))
            q = nm.canonical_quaternion(nm.quaternion_multiply(nm.quaternion_from_rotation_vector([0, 0, cfg.camera_yaw_correction_gain * error]), q))
            bias = bias - np.array([0, 0, cfg.camera_yaw_bias_correction_gain * error * dt])
        quaternions[i], biases[i] = q, bias
    return Orientation(quaternions, biases, calm, seen, heading)
