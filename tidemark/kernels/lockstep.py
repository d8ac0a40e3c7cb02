"""The filters of ``tracker`` and the backward passes of ``smoother`` over many sessions at once.

All arrays have a leading axis of sessions.  The filters take the next sample
of all sessions that wait for one, or the next frame; the smoothers the k-th
frames, and the j-th samples of their intervals.  The arithmetic is that of the
kernels of one session, whose names the steps here bear, and a session's results
depend on the others by rounding at most.  Confidences,
position fixes and iterated smoothing are left to those.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemark.functions import numeric as nm
from tidemark.kernels import tracker
from tidemark.plans.config import FilterConfig


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _boosted(m: np.ndarray) -> np.ndarray:
    out = nm.symmetric(m)
    i = np.arange(out.shape[-1])
    mean = np.abs(np.trace(out, axis1=-2, axis2=-1) / len(i))
    out[:, i, i] += np.maximum(nm.JITTER_FLOOR, nm.JITTER_SCALE * np.maximum(mean, 1.0))[:, None]
    return out


def _psd_solve(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    return np.linalg.solve(_boosted(m), rhs)


def _joseph(cov: np.ndarray, gain: np.ndarray, h: np.ndarray, r: np.ndarray) -> np.ndarray:
    rest = np.eye(cov.shape[-1]) - gain @ h
    return nm.symmetric(rest @ cov @ _t(rest) + gain @ r @ _t(gain))


def _mahalanobis_log_likelihood(v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _boosted(s)
    nis = np.sum(v * np.linalg.solve(s, v[..., None])[..., 0], axis=-1)
    return nis, -0.5 * (np.linalg.slogdet(s)[1] + nis + v.shape[-1] * np.log(nm.TWO_PI))


def _rotation_derivative(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    o = np.zeros_like(w)
    d = 2 * np.array([
        [[o, -z, y], [z, o, -x], [-y, x, o]],
        [[o, y, z], [y, -2 * x, -w], [z, w, -2 * x]],
        [[-2 * y, x, w], [x, o, z], [-w, z, -2 * y]],
        [[-2 * z, -w, x], [w, -2 * z, y], [x, y, o]],
    ])
    return np.moveaxis(d, -1, 0)


def _unit_projector(q: np.ndarray) -> np.ndarray:
    return np.eye(4) - q[:, :, None] * q[:, None, :]


def _yaw_derivative(q: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(q, axis=-1, keepdims=True)
    u = q / norm
    w, x, y, z = u.T
    top, bottom = 2 * (w * z + x * y), 1 - 2 * (y * y + z * z)
    o = np.zeros_like(w)
    d_top, d_bottom = np.stack([2 * z, 2 * y, 2 * x, 2 * w], -1), np.stack([o, o, -4 * y, -4 * z], -1)
    d = (bottom[:, None] * d_top - top[:, None] * d_bottom) / np.maximum(top * top + bottom * bottom, 1e-300)[:, None]
    return (d[:, None] @ _unit_projector(u))[:, 0] / norm


@dataclass
class Sessions:
    """Samples and frames of whole sessions, one session after the other, each in time order; LEDs are NaN where unseen.

    s_at and f_at are where sessions begin, and the end.
    """

    t: np.ndarray
    u: np.ndarray
    s_at: np.ndarray
    t_frames: np.ndarray
    leds: np.ndarray  # (frames, 2, 2), or (frames, L, 3)
    mask: np.ndarray
    f_at: np.ndarray
    #: Time from the sample before; the mean one for a session's first.
    dt: np.ndarray = field(init=False)
    #: Samples of each frame's interval: from, to; none of a session's first frame.
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.dt = np.diff(self.t, prepend=np.nan)
        first, last = self.s_at[:-1], self.s_at[1:] - 1
        self.dt[first] = (self.t[last] - self.t[first]) / (last - first)
        self.low, self.high = np.empty(len(self.t_frames), int), np.empty(len(self.t_frames), int)
        for a, b, c, d in zip(self.s_at[:-1], self.s_at[1:], self.f_at[:-1], self.f_at[1:], strict=True):
            self.high[c:d] = a + np.searchsorted(self.t[a:b], self.t_frames[c:d], side="right")
            self.low[c] = self.high[c]
            self.low[c + 1 : d] = self.high[c : d - 1]
        self.seen = np.isfinite(self.leds).all(axis=2) & self.mask[:, None]

    @property
    def frames(self) -> np.ndarray:
        return np.diff(self.f_at)

    def steps(self, at: np.ndarray):
        """For frames, the j-th samples of their intervals for each j: places in ``at``, samples."""
        low, high = self.low[at], self.high[at]
        for j in range(int((high - low).max(initial=0))):
            of = np.flatnonzero(low + j < high)
            yield of, low[of] + j


@dataclass
class Estimates:
    """Of all frames; nis is NaN where there is none."""

    mean: np.ndarray
    cov: np.ndarray
    predicted_mean: np.ndarray
    predicted_cov: np.ndarray
    loglik: np.ndarray
    vision: np.ndarray
    nis: np.ndarray
    nis_dim: np.ndarray


class Motion:
    def __init__(self, cfg: FilterConfig):
        self.cfg, self.lay = cfg, cfg.layout
        self.gravity = np.array(cfg.imu_gravity_body, float)
        self.quat = list(self.lay.heading)

    def step(self, x, u, dt, want_jacobian=True):
        return (self._spatial if self.lay.is_quaternion else self._planar)(x, u, dt, want_jacobian)

    def _planar(self, x, u, dt, want_jacobian):
        lay = self.lay
        out = x.copy()
        jac = np.tile(np.eye(lay.n), (len(x), 1, 1)) if want_jacobian else None
        (px, py), vel = lay.position, lay.velocity
        if not lay.has_biases:
            for p, v in zip((px, py), vel, strict=True):
                out[:, p] += x[:, v] * dt
                if want_jacobian:
                    jac[:, p, v] = dt
            return out, jac
        h, bias, damping = lay.heading[0], lay.accel_bias, self.cfg.damping_coeff
        fx, fy = u[:, 1] - x[:, bias[0]], u[:, 2] - x[:, bias[1]]
        c, s = np.cos(x[:, h]), np.sin(x[:, h])
        ax, ay = c * fx - s * fy - self.gravity[0], s * fx + c * fy - self.gravity[1]
        half = 0.5 * dt * dt
        out[:, px] += x[:, vel[0]] * dt + half * (ax - damping * x[:, vel[0]])
        out[:, py] += x[:, vel[1]] * dt + half * (ay - damping * x[:, vel[1]])
        out[:, vel[0]] += dt * (ax - damping * x[:, vel[0]])
        out[:, vel[1]] += dt * (ay - damping * x[:, vel[1]])
        out[:, h] += (u[:, 0] - x[:, lay.gyro_bias[0]]) * dt
        vertical = u.shape[1] >= 4 and len(vel) == 3
        if vertical:
            out[:, vel[2]] += dt * (u[:, 3] - x[:, bias[2]] - self.gravity[2] - damping * x[:, vel[2]])
        if want_jacobian:
            turn = (-s * fx - c * fy, c * fx - s * fy)
            rot = ((c, -s), (s, c))
            for i, (p, v) in enumerate(((px, vel[0]), (py, vel[1]))):
                jac[:, p, v], jac[:, v, v] = dt - damping * half, 1 - damping * dt
                jac[:, p, h], jac[:, v, h] = half * turn[i], dt * turn[i]
                for j in range(2):
                    jac[:, p, bias[j]], jac[:, v, bias[j]] = -half * rot[i][j], -dt * rot[i][j]
            jac[:, h, lay.gyro_bias[0]] = -dt
            if vertical:
                jac[:, vel[2], vel[2]], jac[:, vel[2], bias[2]] = 1 - damping * dt, -dt
        return out, jac

    def _spatial(self, x, u, dt, want_jacobian):
        lay, quat = self.lay, self.quat
        pos, vel, bg, ba = (list(g) for g in (lay.position, lay.velocity, lay.gyro_bias, lay.accel_bias))
        omega = u[:, :3] - x[:, bg]
        q0, d = x[:, quat], dt[:, None]
        q1 = nm.integrate_gyro(q0, omega, d)
        out = x.copy()
        out[:, quat] = q1
        driven = self.cfg.enable_experimental_accel_translation
        damping = self.cfg.damping_coeff if driven else 0.0
        accel = np.zeros((len(x), len(vel)))
        if driven:
            rot = nm.rotation_matrix(q1)
            accel = _times(rot, u[:, 3:6] - x[:, ba] - _times(_t(rot), np.broadcast_to(self.gravity, (len(x), 3))))[:, : len(vel)]
        half = 0.5 * d * d
        out[:, pos] += x[:, vel] * d + half * (accel - damping * x[:, vel])
        out[:, vel] += d * (accel - damping * x[:, vel])
        if not want_jacobian:
            return out, None
        jac = np.tile(np.eye(lay.n), (len(x), 1, 1))
        jac[:, pos, vel], jac[:, vel, vel] = d - damping * half, 1 - damping * d
        w, a, b, c = q0.T
        ox, oy, oz = omega.T
        o = np.zeros_like(w)
        keep = _unit_projector(q1)
        by_rate = 0.5 * d[:, None] * np.moveaxis(np.array([[-a, -b, -c], [w, -c, b], [c, w, -a], [-b, a, w]]), -1, 0)
        by_quat = keep @ (np.eye(4) + 0.5 * d[:, None] * np.moveaxis(np.array([[o, -ox, -oy, -oz], [ox, o, oz, -oy], [oy, -oz, o, ox], [oz, oy, -ox, o]]), -1, 0))
        at = lambda rows, columns: (slice(None), *np.ix_(rows, columns))
        jac[at(quat, bg)] = -keep @ by_rate
        jac[at(quat, quat)] = by_quat
        if driven:
            turned = np.einsum("nkij,nj->nik", _rotation_derivative(q1), u[:, 3:6] - x[:, ba])[:, : len(vel)] @ keep @ by_quat
            for rows, gain in ((vel, d), (pos, half)):
                jac[at(rows, ba)] = -gain[:, None] * rot[:, : len(vel)]
                jac[at(rows, quat)] = gain[:, None] * turned
        return out, jac

    def normalise(self, x: np.ndarray) -> np.ndarray:
        if self.lay.is_quaternion:
            x[:, self.quat] = nm.normalize_quaternion(x[:, self.quat])
        else:
            x[:, self.quat[0]] = nm.wrap_angle(x[:, self.quat[0]])
        return x

    def yaw(self, x: np.ndarray) -> np.ndarray:
        return nm.quaternion_yaw(x[:, self.quat]) if self.lay.is_quaternion else x[:, self.quat[0]]

    def yaw_row(self, x: np.ndarray) -> np.ndarray:
        row = np.zeros((len(x), self.lay.n))
        row[:, self.quat] = _yaw_derivative(x[:, self.quat]) if self.lay.is_quaternion else 1.0
        return row

    def leds(self, x: np.ndarray, distance: np.ndarray, want_jacobian: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        px, py = self.lay.position[:2]
        yaw = self.yaw(x)
        dx, dy = 0.5 * distance * np.cos(yaw), 0.5 * distance * np.sin(yaw)
        z = np.stack([x[:, px] - dx, x[:, py] - dy, x[:, px] + dx, x[:, py] + dy], -1)
        if not want_jacobian:
            return z, None
        h = np.stack([dy, -dx, -dy, dx], -1)[:, :, None] * self.yaw_row(x)[:, None, :]
        h[:, [0, 2], px] += 1
        h[:, [1, 3], py] += 1
        return z, h


class Noise(tracker.ProcessNoise):
    def __call__(self, dt: np.ndarray, vision: np.ndarray) -> np.ndarray:
        a, b, c = np.where(vision[:, None, None, None], self.seen, self.blind).swapaxes(0, 1)
        d = dt[:, None, None]
        return a * d + b * (d * d) + c * (d * d * d)


def sigma_points(mean: np.ndarray, cov: np.ndarray, cfg: FilterConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sessions, 2n+1, n) points, and the weights."""
    n, lam = mean.shape[1], cfg.sigma_scaling
    spread = np.sqrt(n + lam) * _t(nm.spread_factor(cov))
    wm = np.full(2 * n + 1, 0.5 / (n + lam))
    wm[0] = lam / (n + lam)
    wc = wm.copy()
    wc[0] += 1 - cfg.alpha**2 + cfg.beta
    middle = mean[:, None]
    return np.concatenate([middle, middle + spread, middle - spread], axis=1), wm, wc


def _circular_mean(angles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.arctan2(np.sum(np.sin(angles) * weights, axis=-1), np.sum(np.cos(angles) * weights, axis=-1))


def _each(motion: Motion, points: np.ndarray, u: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """All points of all sessions one sample later."""
    k = points.shape[1]
    return motion.step(points.reshape(-1, points.shape[2]), np.repeat(u, k, axis=0), np.repeat(dt, k), False)[0].reshape(points.shape)


class Filter:
    """Extended, or unscented, or with ``offsets`` three-dimensional; first: means and covariances to begin with."""

    def __init__(self, cfg: FilterConfig, data: Sessions, first: tuple[np.ndarray, np.ndarray], distance: np.ndarray, unscented: bool = False, offsets: np.ndarray | None = None):
        self.cfg, self.data, self.motion, self.noise, self.lay = cfg, data, Motion(cfg), Noise(cfg), cfg.layout
        self.mean, self.cov = (np.array(a, float) for a in first)
        self.distance, self.unscented, self.offsets = distance, unscented, offsets
        if not (np.isfinite(self.mean).all() and np.isfinite(self.cov).all()):
            raise ValueError("the initial state needs finite means and covariances")

    def run(self) -> Estimates:
        d, cfg = self.data, self.cfg
        n, sessions, total = self.lay.n, len(d.frames), len(d.t_frames)
        out = Estimates(np.empty((total, n)), np.empty((total, n, n)), np.empty((total, n)), np.empty((total, n, n)), np.zeros(total), d.seen.any(axis=1), np.full(total, np.nan), np.zeros(total, int))
        known, stationary = np.zeros(sessions, bool), np.zeros(sessions, bool)
        age = np.full(sessions, cfg.zupt_visual_context_hold_frames + 1)
        points = np.full((total, d.leds.shape[2]), np.nan)
        points[out.vision] = np.where(d.seen[out.vision, :, None], d.leds[out.vision], 0.0).sum(axis=1) / d.seen[out.vision].sum(axis=1)[:, None]
        window = cfg.zupt_camera_stationary_window_frames
        # where each session is: its frame, the next sample of the frame's interval, what the interval's samples add up to
        frame, sample = d.f_at[:-1].copy(), d.low[d.f_at[:-1]].copy()
        all_moved, all_moves = np.zeros((sessions, d.u.shape[1])), np.zeros(sessions)
        while len(live := np.flatnonzero(frame < d.f_at[1:])):
            ahead = sample[live] < d.high[frame[live]]
            if 2 * ahead.sum() >= len(live):
                # a sample of those that have one, unless more wait at their frames
                who = live[ahead]
                i = sample[who]
                self.propagate(who, d.u[i], d.dt[i], out.vision[frame[who]])
                all_moved[who] += d.u[i]
                all_moves[who] += 1
                sample[who] += 1
                continue
            who = live[~ahead]
            at, k = frame[who], frame[who] - d.f_at[who]
            vision, moved, moves = out.vision[at], all_moved[who], all_moves[who]
            out.predicted_mean[at], out.predicted_cov[at] = self.mean[who], self.cov[who]
            for leds in np.unique(d.seen[at[vision]], axis=0) if vision.any() else ():
                same = vision & (d.seen[at] == leds).all(axis=1)
                some, f = who[same], at[same]
                out.nis[f], out.loglik[f] = self.camera_3d(some, f, leds) if self.offsets is not None else self.camera(some, f, leds)
                out.nis_dim[f] = leds.sum() * d.leds.shape[2]
                if self.offsets is None and cfg.use_heading_measurement and leds.all():
                    self.heading(some, f, out.loglik)
            known[who] |= vision
            then = np.maximum(at - window, d.f_at[who])
            both = (k >= window) & vision & out.vision[then]
            speed = np.linalg.norm(points[at] - points[then], axis=1) / np.maximum(d.t_frames[at] - d.t_frames[then], 1e-6)
            age[who] = np.where(both, 0, age[who] + 1)
            stationary[who] = np.where(both, speed <= cfg.zupt_velocity_threshold, stationary[who] & (age[who] <= cfg.zupt_visual_context_hold_frames))
            if cfg.enable_zupt:
                still = known[who] & stationary[who] & (moves > 0)
                still[still] = self._quiet(moved[still] / moves[still, None])
                if still.any():
                    out.loglik[at[still]] += self.rest(who[still])
            out.mean[at], out.cov[at] = self.mean[who], self.cov[who]
            all_moved[who], all_moves[who] = 0.0, 0.0
            frame[who] += 1
            sample[who] = d.low[np.minimum(at + 1, total - 1)]
        return out

    def propagate(self, who, u, dt, vision) -> None:
        if self.unscented:
            h = self.lay.heading[0]
            points, wm, wc = sigma_points(self.mean[who], self.cov[who], self.cfg)
            moved = _each(self.motion, points, u, dt)
            mean = wm @ moved
            mean[:, h] = _circular_mean(moved[:, :, h], wm)
            off = moved - mean[:, None]
            off[:, :, h] = nm.wrap_angle(off[:, :, h])
            self.mean[who], self.cov[who] = mean, nm.symmetric((_t(off) * wc) @ off + self.noise(dt, vision))
            return
        mean, jac = self.motion.step(self.mean[who], u, dt)
        self.mean[who] = self.motion.normalise(mean)
        self.cov[who] = nm.symmetric(jac @ self.cov[who] @ _t(jac) + self.noise(dt, vision))
        if self.lay.is_quaternion and self.cfg.use_gravity_orientation_update:
            self._gravity(who, u)

    def _gravity(self, who, u) -> None:
        cfg, quat, world = self.cfg, list(self.lay.heading), self.motion.gravity
        gyro, accel = u[:, :3] - self.mean[who][:, list(self.lay.gyro_bias)], u[:, 3:6] - self.mean[who][:, list(self.lay.accel_bias)]
        size, magnitude = np.linalg.norm(accel, axis=1), float(np.linalg.norm(world))
        fit = (size > 1e-6) & (np.abs(size - magnitude) <= cfg.gravity_accel_magnitude_tolerance_m_s2) & (np.linalg.norm(gyro, axis=1) <= cfg.gravity_gyro_norm_threshold_rad_s)
        if not fit.any():
            return
        who, accel, size = who[fit], accel[fit], size[fit]
        q = self.mean[who][:, quat]
        h = np.zeros((len(who), 3, self.lay.n))
        h[:, :, quat] = np.einsum("nkij,i->njk", _rotation_derivative(q), world) @ _unit_projector(q) / magnitude
        self._linear(who, accel / size[:, None] - nm.world_to_body(q, np.broadcast_to(world, (len(q), 3))) / magnitude, h, np.eye(3) * cfg.gravity_orientation_measurement_noise)

    def _linear(self, who, innovation, h, r) -> np.ndarray:
        cov = self.cov[who]
        hp = h @ cov
        s = hp @ _t(h) + r
        gain = _t(_psd_solve(s, hp))
        self.mean[who] = self.motion.normalise(self.mean[who] + _times(gain, innovation))
        self.cov[who] = _joseph(cov, gain, h, r)
        return s

    def _take(self, who, passed, at, cov, loglik) -> np.ndarray:
        """Keep the updates that passed; their log-likelihoods."""
        self.mean[who[passed]], self.cov[who[passed]] = at[passed], cov[passed]
        return np.where(passed, loglik, 0.0)

    def camera(self, who, f, leds) -> tuple[np.ndarray, np.ndarray]:
        cfg, motion, rows = self.cfg, self.motion, np.flatnonzero(np.repeat(leds, 2))
        z, r = self.data.leds[f].reshape(len(f), 4)[:, rows], np.eye(len(rows)) * cfg.measurement_noise_pos
        mean, cov, distance = self.mean[who], self.cov[who], self.distance[who]
        if self.unscented:
            return self._camera_unscented(who, z, r, rows)
        at = mean
        for _ in range(cfg.num_iter):
            expected, h = motion.leds(at, distance)
            h = h[:, rows]
            innovation = z - expected[:, rows] + _times(h, at - mean)
            hp = h @ cov
            s = hp @ _t(h) + r
            gain = _t(_psd_solve(s, hp))
            at = motion.normalise(mean + _times(gain, innovation))
        nis, loglik = _mahalanobis_log_likelihood(innovation, s)
        return nis, self._take(who, self._passed(nis, nm.gate_threshold(len(rows), cfg.mahalanobis_threshold_prob)), at, _joseph(cov, gain, h, r), loglik)

    def _passed(self, nis, gate) -> np.ndarray:
        return nis < gate if self.cfg.use_mahalanobis_gating else np.ones(len(nis), bool)

    def _camera_unscented(self, who, z, r, rows) -> tuple[np.ndarray, np.ndarray]:
        mean, cov = self.mean[who], self.cov[who]
        points, wm, wc = sigma_points(mean, cov, self.cfg)
        k = points.shape[1]
        seen = self.motion.leds(points.reshape(-1, points.shape[2]), np.repeat(self.distance[who], k), False)[0].reshape(len(who), k, 4)[:, :, rows]
        expected = wm @ seen
        off_z, off_x = seen - expected[:, None], points - mean[:, None]
        s = (_t(off_z) * wc) @ off_z + r
        innovation = z - expected
        nis, loglik = _mahalanobis_log_likelihood(innovation, s)
        gain = _t(_psd_solve(s, _t((_t(off_x) * wc) @ off_z)))
        taken = gain @ nm.symmetric(s) @ _t(gain)
        after = nm.symmetric(cov - taken)
        # the points' jitter is part of what is taken; where it is more than what is left, it is part of the prior too
        below = np.isfinite(after).all(axis=(1, 2))
        below[below] = np.linalg.eigvalsh(after[below])[:, 0] < 0
        after[below] = nm.symmetric((_t(off_x[below]) * wc) @ off_x[below] - taken[below])
        passed = np.isfinite(nis) & self._passed(nis, nm.gate_threshold(len(rows), self.cfg.mahalanobis_threshold_prob))
        return nis, self._take(who, passed, mean + _times(gain, innovation), after, loglik)

    def camera_3d(self, who, f, leds) -> tuple[np.ndarray, np.ndarray]:
        lay, quat, pos = self.lay, list(self.lay.heading), list(self.lay.position)
        body = self.offsets[leds]
        z = self.data.leds[f][:, leds].reshape(len(f), -1)
        size = z.shape[1]
        r = np.eye(size) * self.cfg.measurement_noise_pos
        mean, cov = self.mean[who], self.cov[who]
        at = mean
        for _ in range(self.cfg.num_iter):
            q = nm.normalize_quaternion(at[:, quat])
            h = np.zeros((len(f), size, lay.n))
            h[:, :, pos] = np.tile(np.eye(3), (len(body), 1))
            h[:, :, quat] = np.einsum("nkij,lj->nlik", _rotation_derivative(q), body).reshape(len(f), size, 4) @ _unit_projector(q)
            innovation = z - (at[:, None, pos] + body @ _t(nm.rotation_matrix(q))).reshape(len(f), size) + _times(h, at - mean)
            hp = h @ cov
            s = hp @ _t(h) + r
            gain = _t(_psd_solve(s, hp))
            at = self.motion.normalise(mean + _times(gain, innovation))
        nis, loglik = _mahalanobis_log_likelihood(innovation, s)
        return nis, self._take(who, self._passed(nis, nm.chi2_ppf(self.cfg.mahalanobis_threshold_prob, size)), at, _joseph(cov, gain, h, r), loglik)

    def heading(self, who, f, loglik) -> None:
        cfg = self.cfg
        dx, dy = (self.data.leds[f, 1] - self.data.leds[f, 0]).T
        spacing = np.hypot(dx, dy)
        ratio = spacing / self.distance[who]
        fit = (spacing > 1e-6) & (1 - cfg.led_distance_tolerance < ratio) & (ratio < 1 + cfg.led_distance_tolerance)
        if not fit.any():
            return
        who, f, ratio, yaw = who[fit], f[fit], ratio[fit], np.arctan2(dy[fit], dx[fit])
        variance = cfg.measurement_noise_heading / (ratio**2 if cfg.adaptive_heading_noise else np.ones_like(ratio))
        r = variance[:, None, None]
        if self.unscented:
            h, mean, cov = self.lay.heading[0], self.mean[who], self.cov[who]
            points, wm, wc = sigma_points(mean, cov, cfg)
            expected = _circular_mean(points[:, :, h], wm)
            off = nm.wrap_angle(points[:, :, h] - expected[:, None])
            s = np.sum(off**2 * wc, axis=-1) + variance
            gain = ((wc * off)[:, None] @ (points - mean[:, None]))[:, 0] / s[:, None]
            residual = nm.wrap_angle(yaw - expected)
            self.mean[who] = self.motion.normalise(mean + gain * residual[:, None])
            self.cov[who] = _joseph(cov, gain[:, :, None], np.eye(self.lay.n)[[h]], r)
        else:
            residual = nm.wrap_angle(yaw - self.motion.yaw(self.mean[who]))
            s = self._linear(who, residual[:, None], self.motion.yaw_row(self.mean[who])[:, None], r)[:, 0, 0]
        loglik[f] += -0.5 * (np.log(nm.TWO_PI * s) + residual**2 / s)

    def rest(self, who) -> np.ndarray:
        vel = list(self.lay.velocity)
        v = -self.mean[who][:, vel]
        s = self._linear(who, v, np.broadcast_to(np.eye(self.lay.n)[vel], (len(who), len(vel), self.lay.n)), np.eye(len(vel)) * self.cfg.zupt_measurement_noise)
        return -0.5 * (len(vel) * np.log(nm.TWO_PI) + np.linalg.slogdet(s)[1] + np.sum(v * _psd_solve(s, v[..., None])[..., 0], axis=-1))

    def _quiet(self, mean) -> np.ndarray:
        """Whether mean inertial samples show no motion."""
        gravity = float(np.linalg.norm(self.motion.gravity))
        if self.lay.is_quaternion:
            gyro, accel, expected = mean[:, :3], mean[:, 3:6], gravity
        elif mean.shape[1] >= 4 and len(self.lay.velocity) == 3:
            gyro, accel, expected = mean[:, :1], mean[:, 1:4], gravity
        else:
            gyro, accel, expected = mean[:, :1], mean[:, 1:3], 0.0
        return (np.linalg.norm(gyro, axis=1) <= self.cfg.zupt_gyro_threshold_rad_s) & (np.abs(np.linalg.norm(accel, axis=1) - expected) <= self.cfg.zupt_accel_threshold_m_s2)


def _backwards(data: Sessions):
    """Frames from the last but one: their places, and of the frames after them the samples, as ``steps`` gives them."""
    count = data.frames
    for k in range(int(count.max(initial=0)) - 2, -1, -1):
        at = data.f_at[:-1][count > k + 1] + k
        yield at, data.steps(at + 1)


def rts(cfg: FilterConfig, data: Sessions, means: np.ndarray, covs: np.ndarray, vision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of ``smoother.rts``."""
    lay, motion, noise = cfg.layout, Motion(cfg), Noise(cfg)
    quat = list(lay.heading)
    out_mean, out_cov = means.copy(), covs.copy()
    for at, steps in _backwards(data):
        x, p, total = means[at], covs[at], np.tile(np.eye(lay.n), (len(at), 1, 1))
        for of, i in steps:
            x_next, f = motion.step(x[of], data.u[i], data.dt[i])
            x[of] = motion.normalise(x_next) if lay.is_quaternion else x_next
            p[of] = nm.symmetric(f @ p[of] @ _t(f) + noise(data.dt[i], vision[at[of] + 1]))
            total[of] = f @ total[of]
        gain = _t(_psd_solve(p, total @ covs[at]))
        ahead = out_mean[at + 1]
        if lay.is_quaternion:
            ahead[:, quat] *= np.where(np.sum(ahead[:, quat] * x[:, quat], axis=1, keepdims=True) < 0, -1.0, 1.0)
        residual = ahead - x
        if lay.has_heading_2d:
            residual[:, quat] = nm.wrap_angle(residual[:, quat])
        mean = means[at] + _times(gain, residual)
        out_mean[at] = motion.normalise(mean) if lay.is_quaternion else mean
        out_cov[at] = nm.symmetric(covs[at] + gain @ (out_cov[at + 1] - p) @ _t(gain))
    return out_mean, out_cov


def sigma_point(cfg: FilterConfig, data: Sessions, means: np.ndarray, covs: np.ndarray, vision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``smoother.sigma_point``."""
    motion, noise, h = Motion(cfg), Noise(cfg), cfg.layout.heading_index
    out_mean, out_cov = means.copy(), covs.copy()
    for at, steps in _backwards(data):
        x, p = means[at], covs[at]
        start, wm, wc = sigma_points(x, p, cfg)
        paths = start.copy()
        for of, i in steps:
            u, dt = data.u[i], data.dt[i]
            moved = _each(motion, sigma_points(x[of], p[of], cfg)[0], u, dt)
            x[of] = wm @ moved
            off = moved - x[of][:, None]
            p[of] = (_t(off) * wc) @ off + noise(dt, vision[at[of] + 1])
            paths[of] = _each(motion, paths[of], u, dt)
        cross = (_t(start - means[at][:, None]) * wc) @ (paths - x[:, None])
        gain = _t(_psd_solve(p, _t(cross)))
        residual = out_mean[at + 1] - x
        residual[:, h] = nm.wrap_angle(residual[:, h])
        out_mean[at] = means[at] + _times(gain, residual)
        out_cov[at] = nm.symmetric(covs[at] + gain @ (out_cov[at + 1] - p) @ _t(gain))
    return out_mean, out_cov
