"""Forward filters of one session: extended, iterated and unscented Kalman filters.

A tracker is fed samples and frames in time order and keeps everything it
needs between them, so one kernel serves batch tables (``run``) and streams
(``sample`` and ``frame`` called as rows arrive; ``state`` and ``restore``
carry it over).

Process noise.  The inertial noise enters through a rotation of isotropic
noise, which leaves its covariance as it was, so the whole of Q is a
polynomial in dt with fixed matrices: one set with vision, one without.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from tidemark.functions import numeric as nm
from tidemark.plans.config import FilterConfig


@dataclass
class Frame:
    """One camera frame; a missing LED is NaN.  fixes: (anchor, 2x2 covariance) of position events in it."""

    t: float
    leds: np.ndarray  # (2, 2), or (L, 3) in three dimensions
    mask: Any = True
    confidence: np.ndarray | None = None
    fixes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


@dataclass
class Estimate:
    mean: np.ndarray
    cov: np.ndarray
    predicted_mean: np.ndarray
    predicted_cov: np.ndarray
    loglik: float
    vision: bool
    #: Squared Mahalanobis distance of the LEDs' innovation and its dimensions, gated or not; None and 0 without LEDs.
    nis: float | None = None
    nis_dim: int = 0


class ProcessNoise:
    """Q(dt) = q1 dt + q2 dt^2 + q3 dt^3, with and without vision."""

    def __init__(self, cfg: FilterConfig):
        lay, n = cfg.layout, cfg.layout.n
        rate = np.zeros(n)
        for group, value in ((lay.position, cfg.process_noise_pos), (lay.velocity, cfg.process_noise_vel), (lay.heading, cfg.process_noise_heading), (lay.gyro_bias, cfg.process_noise_gyro_bias), (lay.accel_bias, cfg.process_noise_accel_bias)):
            rate[list(group)] = value
        gyro, accel = cfg.imu_gyro_noise_density**2, cfg.imu_accel_noise_density**2
        imu = np.zeros((3, n, n))
        if lay.has_biases:
            turned = lay.heading if lay.has_heading_2d else lay.heading[1:]
            imu[0][turned, turned] = gyro if lay.has_heading_2d else gyro / 4
            if lay.has_heading_2d or cfg.enable_experimental_accel_translation:
                # a 2-D accelerometer drives two velocities, a 3-D one all
                driven = lay.velocity[: len(lay.accel_bias)]
                imu[0][driven, driven] = accel
                for p, v in zip(lay.position, driven, strict=False):
                    imu[1][p, v] = imu[1][v, p] = accel / 2
                    imu[2][p, p] = accel / 4
        self.seen = imu + np.stack([np.diag(rate), np.zeros((n, n)), np.zeros((n, n))])
        if cfg.adaptive_q_during_dropout:
            for group, k in ((lay.position, cfg.dropout_q_pos_multiplier), (lay.velocity, cfg.dropout_q_vel_multiplier), (lay.gyro_bias + lay.accel_bias, cfg.dropout_q_bias_multiplier)):
                rate[list(group)] *= k
        scale = cfg.blackout_imu_noise_scale if cfg.reduce_imu_noise_during_blackout else 1.0
        self.blind = imu * scale
        self.blind[0] += np.diag(rate)
        if cfg.freeze_bias_during_blackout:
            bias = list(lay.gyro_bias + lay.accel_bias)
            self.blind[:, bias, :] = 0
            self.blind[:, :, bias] = 0

    def __call__(self, dt: float, vision: bool) -> np.ndarray:
        a, b, c = self.seen if vision else self.blind
        return a * dt + b * (dt * dt) + c * (dt * dt * dt)


class Motion:
    """The state one inertial sample later, and the derivative of that."""

    def __init__(self, cfg: FilterConfig):
        self.cfg, self.lay = cfg, cfg.layout
        self.gravity = np.array(cfg.imu_gravity_body, float)

    def step(self, x: np.ndarray, u: np.ndarray, dt: float, want_jacobian: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        if self.lay.is_quaternion:
            return self._spatial(x, u, dt, want_jacobian)
        return self._planar(x, u, dt, want_jacobian)

    def _planar(self, x, u, dt, want_jacobian):
        lay = self.lay
        out = x.copy()
        jac = np.eye(lay.n) if want_jacobian else None
        (px, py), vel = lay.position, lay.velocity
        if not lay.has_biases:
            for p, v in zip((px, py), vel, strict=True):
                out[p] += x[v] * dt
                if want_jacobian:
                    jac[p, v] = dt
            return out, jac
        h, bias = lay.heading[0], lay.accel_bias
        damping = self.cfg.damping_coeff
        fx, fy = u[1] - x[bias[0]], u[2] - x[bias[1]]
        c, s = math.cos(x[h]), math.sin(x[h])
        ax, ay = c * fx - s * fy - self.gravity[0], s * fx + c * fy - self.gravity[1]
        half = 0.5 * dt * dt
        out[px] += x[vel[0]] * dt + half * (ax - damping * x[vel[0]])
        out[py] += x[vel[1]] * dt + half * (ay - damping * x[vel[1]])
        out[vel[0]] += dt * (ax - damping * x[vel[0]])
        out[vel[1]] += dt * (ay - damping * x[vel[1]])
        out[h] += (u[0] - x[lay.gyro_bias[0]]) * dt
        vertical = len(u) >= 4 and len(vel) == 3
        if vertical:
            out[vel[2]] += dt * (u[3] - x[bias[2]] - self.gravity[2] - damping * x[vel[2]])
        if want_jacobian:
            # columns: how each velocity, the heading and the biases move positions and velocities
            turn = (-s * fx - c * fy, c * fx - s * fy)
            rot = ((c, -s), (s, c))
            for i, (p, v) in enumerate(((px, vel[0]), (py, vel[1]))):
                jac[p, v], jac[v, v] = dt - damping * half, 1 - damping * dt
                jac[p, h], jac[v, h] = half * turn[i], dt * turn[i]
                for j in range(2):
                    jac[p, bias[j]], jac[v, bias[j]] = -half * rot[i][j], -dt * rot[i][j]
            jac[h, lay.gyro_bias[0]] = -dt
            if vertical:
                jac[vel[2], vel[2]], jac[vel[2], bias[2]] = 1 - damping * dt, -dt
        return out, jac

    def _spatial(self, x, u, dt, want_jacobian):
        lay = self.lay
        pos, vel, quat, bg, ba = (list(g) for g in (lay.position, lay.velocity, lay.heading, lay.gyro_bias, lay.accel_bias))
        omega = u[:3] - x[bg]
        q0 = x[quat]
        q1 = nm.integrate_gyro(q0, omega, dt)
        out = x.copy()
        out[quat] = q1
        driven = self.cfg.enable_experimental_accel_translation
        damping = self.cfg.damping_coeff if driven else 0.0
        accel = np.zeros(len(vel))
        rot = nm.rotation_matrix(q1)
        if driven:
            accel = (rot @ (u[3:6] - x[ba] - rot.T @ self.gravity))[: len(vel)]
        half = 0.5 * dt * dt
        out[pos] += x[vel] * dt + half * (accel - damping * x[vel])
        out[vel] += dt * (accel - damping * x[vel])
        if not want_jacobian:
            return out, None
        jac = np.eye(lay.n)
        jac[pos, vel], jac[vel, vel] = dt - damping * half, 1 - damping * dt
        w, a, b, c = q0
        keep = nm.unit_projector(q1)
        by_rate = 0.5 * dt * np.array([[-a, -b, -c], [w, -c, b], [c, w, -a], [-b, a, w]])
        ox, oy, oz = omega
        by_quat = keep @ (np.eye(4) + 0.5 * dt * np.array([[0, -ox, -oy, -oz], [ox, 0, oz, -oy], [oy, -oz, 0, ox], [oz, oy, -ox, 0]]))
        jac[np.ix_(quat, bg)] = -keep @ by_rate
        jac[np.ix_(quat, quat)] = by_quat
        if driven:
            turned = np.einsum("kij,j->ik", nm.rotation_derivative(q1), u[3:6] - x[ba])[: len(vel)] @ keep @ by_quat
            for rows, gain in ((vel, dt), (pos, half)):
                jac[np.ix_(rows, ba)] = -gain * rot[: len(vel)]
                jac[np.ix_(rows, quat)] = gain * turned
        return out, jac

    def normalise(self, x: np.ndarray) -> np.ndarray:
        """Heading in (-pi, pi], or a unit quaternion."""
        lay = self.lay
        if lay.is_quaternion:
            x[list(lay.heading)] = nm.normalize_quaternion(x[list(lay.heading)])
        else:
            x[lay.heading[0]] = math.atan2(math.sin(x[lay.heading[0]]), math.cos(x[lay.heading[0]]))
        return x

    def yaw(self, x: np.ndarray) -> float:
        return float(nm.quaternion_yaw(x[list(self.lay.heading)])) if self.lay.is_quaternion else float(x[self.lay.heading[0]])

    def yaw_row(self, x: np.ndarray) -> np.ndarray:
        row = np.zeros(self.lay.n)
        row[list(self.lay.heading)] = nm.yaw_derivative(x[list(self.lay.heading)]) if self.lay.is_quaternion else 1.0
        return row


def led_measurement(motion: Motion, x: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """x1 y1 x2 y2 of the LED pair, and its derivative."""
    px, py = motion.lay.position[:2]
    yaw = motion.yaw(x)
    dx, dy = 0.5 * distance * math.cos(yaw), 0.5 * distance * math.sin(yaw)
    h = np.outer([dy, -dx, -dy, dx], motion.yaw_row(x))
    h[[0, 2], px] += 1
    h[[1, 3], py] += 1
    return np.array([x[px] - dx, x[py] - dy, x[px] + dx, x[py] + dy]), h


def usable(frame: Frame) -> np.ndarray:
    """Which LEDs are finite."""
    return np.isfinite(frame.leds).all(axis=1)


class ExtendedTracker:
    """The extended Kalman filter, iterated if ``num_iter`` is above 1."""

    def __init__(self, cfg: FilterConfig, first: tuple[np.ndarray, np.ndarray], dt_first: float, vision_known: bool = False):
        if cfg.led_distance is None:
            raise ValueError("led_distance must be set; see led_spacing")
        self.cfg, self.motion, self.noise = cfg, Motion(cfg), ProcessNoise(cfg)
        self.lay = cfg.layout
        self.mean, self.cov = np.array(first[0], float), np.array(first[1], float)
        check_state(self.mean, self.cov, self.lay.n)
        self.dt_first = dt_first
        self.t_sample: float | None = None
        self.frames = 0
        self.seen_vision = vision_known
        self.stationary, self.context_age = False, cfg.zupt_visual_context_hold_frames + 1
        self.points: deque = deque(maxlen=cfg.zupt_camera_stationary_window_frames + 1)
        self.pending: list[tuple[float, np.ndarray]] = []

    # what a stream keeps between batches
    def state(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k not in ("cfg", "motion", "noise", "lay")}

    def restore(self, kept: dict[str, Any]) -> ExtendedTracker:
        self.__dict__.update(kept)
        return self

    def sample(self, t: float, u: np.ndarray) -> None:
        """An inertial sample; it is used when its frame comes."""
        dt = self.dt_first if self.t_sample is None else t - self.t_sample
        self.t_sample = t
        if self.frames:
            self.pending.append((dt, np.asarray(u, float)))

    def frame(self, frame: Frame) -> Estimate:
        """A frame whose samples have all been given."""
        leds = usable(frame) & np.asarray(frame.mask, bool)
        vision = bool(leds.any())
        for dt, u in self.pending:
            self.propagate(u, dt, vision)
        predicted = self.mean.copy(), self.cov.copy()
        loglik = 0.0
        self.surprise: tuple[float | None, int] = (None, 0)
        if vision:
            loglik += self.camera(frame, leds)
            loglik += self.heading(frame, leds)
        self.seen_vision |= vision
        self._remember(frame, leds)
        if self.cfg.enable_zupt and self.seen_vision and self.stationary and self._quiet():
            loglik += self.rest()
        if frame.fixes:
            loglik += self.events(frame.fixes)
        self.pending = []
        self.frames += 1
        return Estimate(self.mean.copy(), self.cov.copy(), *predicted, loglik, vision, *self.surprise)

    # steps
    def propagate(self, u: np.ndarray, dt: float, vision: bool) -> None:
        mean, jac = self.motion.step(self.mean, u, dt)
        self.mean = self.motion.normalise(mean)
        self.cov = nm.symmetric(jac @ self.cov @ jac.T + self.noise(dt, vision))
        if self.lay.is_quaternion:
            self._gravity(u)

    def _gravity(self, u: np.ndarray) -> None:
        cfg, quat = self.cfg, list(self.lay.heading)
        if not cfg.use_gravity_orientation_update:
            return
        gyro, accel = u[:3] - self.mean[list(self.lay.gyro_bias)], u[3:6] - self.mean[list(self.lay.accel_bias)]
        size, world = float(np.linalg.norm(accel)), self.motion.gravity
        magnitude = float(np.linalg.norm(world))
        if not (size > 1e-6 and abs(size - magnitude) <= cfg.gravity_accel_magnitude_tolerance_m_s2 and np.linalg.norm(gyro) <= cfg.gravity_gyro_norm_threshold_rad_s):
            return
        q = self.mean[quat]
        h = np.zeros((3, self.lay.n))
        h[:, quat] = np.einsum("kij,i->jk", nm.rotation_derivative(q), world) @ nm.unit_projector(q) / magnitude
        self._linear(accel / size - nm.world_to_body(q, world) / magnitude, h, np.eye(3) * cfg.gravity_orientation_measurement_noise)

    def _linear(self, innovation: np.ndarray, h: np.ndarray, r: np.ndarray) -> np.ndarray:
        """One Kalman update; the innovation's covariance."""
        hp = h @ self.cov
        s = hp @ h.T + r
        gain = nm.psd_solve(s, hp).T
        self.mean = self.motion.normalise(self.mean + gain @ innovation)
        self.cov = nm.joseph(self.cov, gain, h, r)
        return s

    def _camera_noise(self, frame: Frame) -> np.ndarray:
        base = self.cfg.measurement_noise_pos
        return np.full(4, base) if frame.confidence is None else base / np.clip(frame.confidence, 0.01, 1.0)

    def camera(self, frame: Frame, leds: np.ndarray) -> float:
        rows = np.repeat(leds, 2)
        z, r = frame.leds.ravel()[rows], np.diag(self._camera_noise(frame)[rows])
        prior_mean, prior_cov = self.mean, self.cov
        at = prior_mean
        for _ in range(self.cfg.num_iter):
            expected, h = led_measurement(self.motion, at, self.cfg.led_distance)
            h = h[rows]
            # linearised about the iterate, always from the prior
            innovation = z - expected[rows] + h @ (at - prior_mean)
            hp = h @ prior_cov
            s = hp @ h.T + r
            gain = nm.psd_solve(s, hp).T
            at = self.motion.normalise(prior_mean + gain @ innovation)
        nis, loglik = nm.mahalanobis_log_likelihood(innovation, s)
        self.surprise = float(nis), len(innovation)
        if self._gated(nis, rows):
            return 0.0
        self.mean, self.cov = at, nm.joseph(prior_cov, gain, h, r)
        return loglik

    def _gated(self, nis: float, rows: np.ndarray) -> bool:
        return self.cfg.use_mahalanobis_gating and not nis < nm.gate_threshold(int(rows.sum()), self.cfg.mahalanobis_threshold_prob)

    def heading_measurement(self, frame: Frame, leds: np.ndarray) -> tuple[float, float] | None:
        """Yaw of the LED pair and its variance, if the pair's spacing is credible."""
        cfg = self.cfg
        if not (cfg.use_heading_measurement and leds.all()):
            return None
        dx, dy = frame.leds[1] - frame.leds[0]
        spacing = math.hypot(dx, dy)
        ratio = spacing / cfg.led_distance
        if not (spacing > 1e-6 and 1 - cfg.led_distance_tolerance < ratio < 1 + cfg.led_distance_tolerance):
            return None
        return math.atan2(dy, dx), cfg.measurement_noise_heading / (ratio**2 if cfg.adaptive_heading_noise else 1.0)

    def heading(self, frame: Frame, leds: np.ndarray) -> float:
        if (found := self.heading_measurement(frame, leds)) is None:
            return 0.0
        yaw, variance = found
        residual = float(nm.wrap_angle(yaw - self.motion.yaw(self.mean)))
        s = float(self._linear(np.array([residual]), self.motion.yaw_row(self.mean)[None, :], np.array([[variance]]))[0, 0])
        return -0.5 * (math.log(nm.TWO_PI * s) + residual**2 / s)

    def rest(self) -> float:
        vel = list(self.lay.velocity)
        k = len(vel)
        v = -self.mean[vel]
        s = self._linear(v, np.eye(self.lay.n)[vel], np.eye(k) * self.cfg.zupt_measurement_noise)
        return float(-0.5 * (k * math.log(nm.TWO_PI) + np.linalg.slogdet(s)[1] + v @ nm.psd_solve(s, v)))

    def events(self, fixes: list[tuple[np.ndarray, np.ndarray]]) -> float:
        """All position fixes of a frame in one stacked update."""
        k = len(fixes)
        pos = list(self.lay.position[:2])
        h = np.tile(np.eye(self.lay.n)[pos], (k, 1))
        r = np.zeros((2 * k, 2 * k))
        for i, (_, cov) in enumerate(fixes):
            r[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = cov
        v = np.concatenate([np.asarray(a, float) for a, _ in fixes]) - np.tile(self.mean[pos], k)
        s = nm.symmetric(self._linear(v, h, r))
        sign, logdet = np.linalg.slogdet(s)
        return float(-0.5 * (2 * k * math.log(nm.TWO_PI) + (logdet if sign > 0 else 0.0) + v @ nm.psd_solve(s, v)))

    # standing still
    def _remember(self, frame: Frame, leds: np.ndarray) -> None:
        """Visual speed over the window, and how long its verdict has been held."""
        self.points.append((frame.t, frame.leds[leds].mean(axis=0) if leds.any() else None))
        window = self.points.maxlen - 1
        now, then = self.points[-1], self.points[0]
        if len(self.points) > window and now[1] is not None and then[1] is not None:
            speed = np.linalg.norm(now[1] - then[1]) / max(now[0] - then[0], 1e-6)
            self.stationary, self.context_age = bool(speed <= self.cfg.zupt_velocity_threshold), 0
        else:
            self.context_age += 1
            self.stationary = self.stationary and self.context_age <= self.cfg.zupt_visual_context_hold_frames

    def _quiet(self) -> bool:
        """Whether the mean inertial sample of the interval shows no motion."""
        if not self.pending:
            return False
        mean = np.mean([u for _, u in self.pending], axis=0)
        gravity = float(np.linalg.norm(self.motion.gravity))
        if self.lay.is_quaternion:
            gyro, accel, expected = mean[:3], mean[3:6], gravity
        elif len(mean) >= 4 and len(self.lay.velocity) == 3:
            gyro, accel, expected = mean[:1], mean[1:4], gravity
        else:
            gyro, accel, expected = mean[:1], mean[1:3], 0.0
        return bool(np.linalg.norm(gyro) <= self.cfg.zupt_gyro_threshold_rad_s and abs(np.linalg.norm(accel) - expected) <= self.cfg.zupt_accel_threshold_m_s2)


class UnscentedTracker(ExtendedTracker):
    """The unscented Kalman filter, for layouts with one heading angle."""

    def __init__(self, cfg: FilterConfig, *args: Any, **kwargs: Any):
        if cfg.layout.is_quaternion:
            raise ValueError("the unscented filter needs a layout with one heading angle")
        super().__init__(cfg, *args, **kwargs)

    def propagate(self, u: np.ndarray, dt: float, vision: bool) -> None:
        points, wm, wc = sigma_points(self.mean, self.cov, self.cfg)
        moved = np.array([self.motion.step(p, u, dt, False)[0] for p in points])
        h = self.lay.heading[0]
        mean = wm @ moved
        mean[h] = circular_mean(moved[:, h], wm)
        off = moved - mean
        off[:, h] = nm.wrap_angle(off[:, h])
        self.mean, self.cov = mean, nm.symmetric((off.T * wc) @ off + self.noise(dt, vision))

    def camera(self, frame: Frame, leds: np.ndarray) -> float:
        rows = np.repeat(leds, 2)
        points, wm, wc = sigma_points(self.mean, self.cov, self.cfg)
        seen = np.array([led_measurement(self.motion, p, self.cfg.led_distance)[0] for p in points])
        expected = wm @ seen
        off_z, off_x = (seen - expected)[:, rows], points - self.mean
        s = (off_z.T * wc) @ off_z + np.diag(self._camera_noise(frame)[rows])
        innovation = (frame.leds.ravel() - expected)[rows]
        nis, loglik = nm.mahalanobis_log_likelihood(innovation, s)
        self.surprise = float(nis), len(innovation)
        if not math.isfinite(nis) or self._gated(nis, rows):
            return 0.0
        gain = nm.psd_solve(s, ((off_x.T * wc) @ off_z).T).T
        self.mean = self.mean + gain @ innovation
        taken = gain @ nm.symmetric(s) @ gain.T
        cov = nm.symmetric(self.cov - taken)
        if np.isfinite(cov).all() and np.linalg.eigvalsh(cov)[0] < 0:
            # the points' jitter is part of what is taken; where it is more than what is left, it is part of the prior too
            cov = nm.symmetric((off_x.T * wc) @ off_x - taken)
        self.cov = cov
        return loglik

    def heading(self, frame: Frame, leds: np.ndarray) -> float:
        if (found := self.heading_measurement(frame, leds)) is None:
            return 0.0
        yaw, variance = found
        h = self.lay.heading[0]
        points, wm, wc = sigma_points(self.mean, self.cov, self.cfg)
        expected = circular_mean(points[:, h], wm)
        off = nm.wrap_angle(points[:, h] - expected)
        s = float(wc @ off**2) + variance
        gain = (wc * off) @ (points - self.mean) / s
        residual = float(nm.wrap_angle(yaw - expected))
        self.mean = self.motion.normalise(self.mean + gain * residual)
        self.cov = nm.joseph(self.cov, gain[:, None], np.eye(self.lay.n)[[h]], np.array([[variance]]))
        return -0.5 * (math.log(nm.TWO_PI * s) + residual**2 / s)


class SpatialTracker(ExtendedTracker):
    """The extended filter in three dimensions: any number of LEDs at known places on the body."""

    def __init__(self, cfg: FilterConfig, first: tuple[np.ndarray, np.ndarray], dt_first: float, offsets: np.ndarray, vision_known: bool = False):
        if cfg.state_mode != "3d_cam_6dof_imu":
            raise ValueError("the 3-D filter runs in mode 3d_cam_6dof_imu")
        super().__init__(cfg, first, dt_first, vision_known)
        self.offsets = np.asarray(offsets, float)

    def camera(self, frame: Frame, leds: np.ndarray) -> float:
        lay, quat, pos = self.lay, list(self.lay.heading), list(self.lay.position)
        body = self.offsets[leds]
        z = frame.leds[leds].ravel()
        base = self.cfg.measurement_noise_pos
        noise = np.full(len(z), base)
        if frame.confidence is not None:
            noise = base / np.clip(np.broadcast_to(np.atleast_2d(np.asarray(frame.confidence, float).T).T, self.offsets.shape)[leds].ravel(), 0.01, 1.0)
        r = np.diag(noise)
        prior_mean, prior_cov = self.mean, self.cov
        at = prior_mean
        for _ in range(self.cfg.num_iter):
            q = nm.normalize_quaternion(at[quat])
            h = np.zeros((len(z), lay.n))
            h[:, pos] = np.tile(np.eye(3), (len(body), 1))
            h[:, quat] = np.einsum("kij,lj->lik", nm.rotation_derivative(q), body).reshape(-1, 4) @ nm.unit_projector(q)
            innovation = z - (at[pos] + body @ nm.rotation_matrix(q).T).ravel() + h @ (at - prior_mean)
            hp = h @ prior_cov
            s = hp @ h.T + r
            gain = nm.psd_solve(s, hp).T
            at = self.motion.normalise(prior_mean + gain @ innovation)
        nis, loglik = nm.mahalanobis_log_likelihood(innovation, s)
        self.surprise = float(nis), len(innovation)
        if self.cfg.use_mahalanobis_gating and not nis < nm.chi2_ppf(self.cfg.mahalanobis_threshold_prob, len(z)):
            return 0.0
        self.mean, self.cov = at, nm.joseph(prior_cov, gain, h, r)
        return loglik

    def heading(self, frame: Frame, leds: np.ndarray) -> float:
        return 0.0


def sigma_points(mean: np.ndarray, cov: np.ndarray, cfg: FilterConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2n+1 points and their weights for means and covariances."""
    n, lam = len(mean), cfg.sigma_scaling
    spread = math.sqrt(n + lam) * nm.spread_factor(cov).T
    wm = np.full(2 * n + 1, 0.5 / (n + lam))
    wm[0] = lam / (n + lam)
    wc = wm.copy()
    wc[0] += 1 - cfg.alpha**2 + cfg.beta
    return np.concatenate([mean[None], mean + spread, mean - spread]), wm, wc


def circular_mean(angles: np.ndarray, weights: np.ndarray) -> float:
    return math.atan2(float(weights @ np.sin(angles)), float(weights @ np.cos(angles)))


def check_state(mean: np.ndarray, cov: np.ndarray, n: int) -> None:
    if mean.shape != (n,) or cov.shape != (n, n) or not (np.isfinite(mean).all() and np.isfinite(cov).all()):
        raise ValueError(f"the initial state needs a finite mean of {n} and covariance of {n} x {n}")
    if not np.allclose(cov, cov.T, atol=1e-10):
        raise ValueError("the initial covariance must be symmetric")
    try:
        np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        raise ValueError("the initial covariance must be positive definite") from None


def led_spacing(frames: list[Frame]) -> float:
    """Median distance of the LED pair over masked dual frames; 4 cm without any."""
    found = [np.linalg.norm(f.leds[1] - f.leds[0]) for f in frames if f.mask and usable(f).all()]
    return float(np.median(found)) if found else 0.04


def initial_state(cfg: FilterConfig, frames: list[Frame]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the first usable frames; wide if there are none."""
    lay = cfg.layout
    seen = [(k, f) for k, f in enumerate(frames) if f.mask and usable(f).any()]
    middle = lambda f: f.leds[usable(f)].mean(axis=0)
    mean, cov = np.zeros(lay.n), np.eye(lay.n)
    yaw, both = 0.0, False
    pos, vel = list(lay.position[:2]), list(lay.velocity[:2])
    if seen:
        k0, f0 = seen[0]
        mean[pos] = middle(f0)
        both = bool(usable(f0).all())
        if both:
            yaw = math.atan2(*(f0.leds[1] - f0.leds[0])[::-1])
        if len(seen) > 1:
            # by frame numbers at the mean frame time
            mean_dt = (frames[-1].t - frames[0].t) / (len(frames) - 1)
            k1, f1 = seen[1]
            mean[vel] = (middle(f1) - mean[pos]) / ((k1 - k0) * mean_dt)
    heading = list(lay.heading)
    mean[heading] = nm.quaternion_from_rotation_vector([0, 0, yaw]) if lay.is_quaternion else yaw
    cov[pos, pos] = 0.01**2 if seen else 10.0**2
    cov[vel, vel] = 0.1**2 if seen else 1.0
    cov[heading, heading] = (math.pi / 4 if both else math.pi / 2) ** 2
    cov[list(lay.gyro_bias), list(lay.gyro_bias)] = 0.05**2
    cov[list(lay.accel_bias), list(lay.accel_bias)] = 0.1**2
    return mean, cov


def initial_state_3d(cfg: FilterConfig, frames: list[Frame], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position from the first frame with an LED, level and without turn."""
    lay = cfg.layout
    mean, cov = np.zeros(lay.n), np.eye(lay.n)
    mean[lay.heading[0]] = 1.0
    found = next(((f, leds) for f in frames if (leds := usable(f) & np.asarray(f.mask, bool)).any()), None)
    if found:
        f, leds = found
        mean[list(lay.position)] = f.leds[leds].mean(axis=0) - np.asarray(offsets, float)[leds].mean(axis=0)
    for group, value in ((lay.position, 0.05**2 if found else 10.0**2), (lay.velocity, 0.2**2 if found else 1.0), (lay.heading, 0.25), (lay.gyro_bias, 0.05**2), (lay.accel_bias, 0.1**2)):
        cov[list(group), list(group)] = value
    return mean, cov


def intervals(t_samples: np.ndarray, t_frames: np.ndarray) -> np.ndarray:
    """Frame of each sample: t_frames[k-1] < t <= t_frames[k]; 0 and len(t_frames) are outside."""
    return np.searchsorted(t_frames, t_samples, side="left")


def run(tracker: ExtendedTracker, t: np.ndarray, u: np.ndarray, frames: list[Frame]) -> list[Estimate]:
    """All frames of a session in order."""
    bounds = np.searchsorted(intervals(t, np.array([f.t for f in frames])), np.arange(len(frames) + 1))
    out = []
    for k, frame in enumerate(frames):
        # samples up to the first frame only set the clock
        for i in range(0 if k == 0 else bounds[k], bounds[k + 1]):
            tracker.sample(t[i], u[i])
        out.append(tracker.frame(frame))
    return out
