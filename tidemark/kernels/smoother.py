"""Backward passes over a filtered session: Rauch-Tung-Striebel (iterated) and sigma-point smoothing."""

from __future__ import annotations

import numpy as np

from tidemark.functions import numeric as nm
from tidemark.kernels.tracker import Motion, ProcessNoise, intervals, sigma_points
from tidemark.plans.config import FilterConfig


def _steps(t: np.ndarray, u: np.ndarray, t_frames: np.ndarray) -> list[list[tuple[float, np.ndarray]]]:
    """(dt, sample) of each frame's interval; none of frame 0."""
    dt = np.diff(t, prepend=np.nan)
    dt[0] = np.mean(dt[1:])
    frame = intervals(t, t_frames)
    return [[(dt[i], u[i]) for i in np.flatnonzero(frame == k)] if k else [] for k in range(len(t_frames))]


def _check(means: np.ndarray, covs: np.ndarray, t_frames: np.ndarray, n: int) -> None:
    if means.shape != (len(t_frames), n) or covs.shape != (len(t_frames), n, n):
        raise ValueError("means and covariances don't fit the frames and the layout")
    if not (np.isfinite(means).all() and np.isfinite(covs).all()):
        raise ValueError("means and covariances must be finite")


def rts(cfg: FilterConfig, means: np.ndarray, covs: np.ndarray, vision: np.ndarray | None, t: np.ndarray, u: np.ndarray, t_frames: np.ndarray, num_iter: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed means and covariances.

    Passes after the first linearise about the means of the pass before.  The
    heading's residual is wrapped, a quaternion's sign aligned; the smoothed
    heading isn't wrapped.
    """
    lay = cfg.layout
    _check(means, covs, t_frames, lay.n)
    if not isinstance(num_iter, int) or num_iter < 1:
        raise ValueError("num_iter must be a positive integer")
    motion, noise = Motion(cfg), ProcessNoise(cfg)
    steps = _steps(t, u, t_frames)
    seen = np.ones(len(t_frames), bool) if vision is None else np.asarray(vision, bool)
    quat = list(lay.heading)
    about = means
    for _ in range(num_iter):
        out_mean, out_cov = means.copy(), covs.copy()
        for k in range(len(t_frames) - 2, -1, -1):
            x, p, at = means[k], covs[k], about[k]
            total = np.eye(lay.n)
            for dt, sample in steps[k + 1]:
                at_next, f = motion.step(at, sample, dt)
                x = motion.step(x, sample, dt, False)[0] if at is not x else at_next
                if lay.is_quaternion:
                    x, at_next = motion.normalise(x), motion.normalise(at_next)
                at = at_next
                p = nm.symmetric(f @ p @ f.T + noise(dt, seen[k + 1]))
                total = f @ total
            gain = nm.psd_solve(p, total @ covs[k]).T
            ahead = out_mean[k + 1].copy()
            if lay.is_quaternion and ahead[quat] @ x[quat] < 0:
                ahead[quat] *= -1
            residual = ahead - x
            if lay.has_heading_2d:
                residual[quat] = nm.wrap_angle(residual[quat])
            mean = means[k] + gain @ residual
            out_mean[k] = motion.normalise(mean) if lay.is_quaternion else mean
            out_cov[k] = nm.symmetric(covs[k] + gain @ (out_cov[k + 1] - p) @ gain.T)
        about = out_mean
    return out_mean, out_cov


def sigma_point(cfg: FilterConfig, means: np.ndarray, covs: np.ndarray, vision: np.ndarray | None, t: np.ndarray, u: np.ndarray, t_frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed means and covariances with cross-covariances from sigma points.

    The mean of propagated points is the plain weighted one, also of headings,
    and acceleration never drives the translation of quaternion layouts.
    """
    lay = cfg.layout
    _check(means, covs, t_frames, lay.n)
    motion, noise = Motion(cfg), ProcessNoise(cfg)
    steps = _steps(t, u, t_frames)
    seen = np.ones(len(t_frames), bool) if vision is None else np.asarray(vision, bool)
    h = lay.heading_index
    out_mean, out_cov = means.copy(), covs.copy()
    for k in range(len(t_frames) - 2, -1, -1):
        x, p = means[k], covs[k]
        start, _, wc = sigma_points(x, p, cfg)
        paths = start
        for dt, sample in steps[k + 1]:
            points, wm, _ = sigma_points(x, p, cfg)
            moved = np.array([motion.step(s, sample, dt, False)[0] for s in points])
            x = wm @ moved
            off = moved - x
            p = (off.T * wc) @ off + noise(dt, seen[k + 1])
            paths = np.array([motion.step(s, sample, dt, False)[0] for s in paths])
        cross = ((start - means[k]).T * wc) @ (paths - x)
        gain = nm.psd_solve(p, cross.T).T
        residual = out_mean[k + 1] - x
        residual[h] = nm.wrap_angle(residual[h])
        out_mean[k] = means[k] + gain @ residual
        out_cov[k] = nm.symmetric(covs[k] + gain @ (out_cov[k + 1] - p) @ gain.T)
    return out_mean, out_cov
