"""Which LED is which: a two-state path of least cost over the frames that show both, and labels for the rest."""

from __future__ import annotations

import numpy as np

from tidemark.functions.numeric import wrap_angle
from tidemark.plans.config import LedIdentityConfig


def swap_labels(cfg: LedIdentityConfig, t: np.ndarray, leds: np.ndarray, mask: np.ndarray, led_distance: float | None = None, t_imu: np.ndarray | None = None, gyro_z: np.ndarray | None = None) -> np.ndarray:
    """True where LED 1 and 2 are swapped; leds (M, 2, 2), NaN where missing.

    Both states see the same spacing, so only transitions tell them apart;
    ties keep the state as recorded.  With initial_state auto the first dual
    frame is free and a whole session's label is as recorded.
    """
    n = len(t)
    dual = np.flatnonzero(np.asarray(mask, bool) & np.isfinite(leds).all(axis=(1, 2)))
    if cfg.mode == "none" or not len(dual):
        return np.zeros(n, bool)
    seen = leds[dual]
    both = np.stack([seen, seen[:, ::-1]], axis=1)  # (K, state, led, xy)
    spacing = np.linalg.norm(seen[:, 1] - seen[:, 0], axis=1)
    distance = float(np.median(spacing)) if led_distance is None else led_distance
    fit = ((spacing - distance) / max(0.02, 0.25 * distance)) ** 2
    moves = _moves(cfg, t[dual], both, t_imu, gyro_z)
    cost = np.array({"original": [0.0, np.inf], "swapped": [np.inf, 0.0]}.get(cfg.initial_state, [0.0, 0.0])) + fit[0]
    back = np.zeros((len(dual), 2), np.int8)
    for k in range(1, len(dual)):
        through = cost[:, None] + moves[k - 1]
        back[k] = np.argmin(through, axis=0)
        cost = through.min(axis=0) + fit[k]
    path = np.zeros(len(dual), np.int8)
    path[-1] = int(np.argmin(cost))
    for k in range(len(dual) - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return _spread(t, leds, dual, path).astype(bool)


def _moves(cfg: LedIdentityConfig, t: np.ndarray, both: np.ndarray, t_imu: np.ndarray | None, gyro_z: np.ndarray | None) -> np.ndarray:
    """(K-1, from, to): what each transition between consecutive dual frames costs."""
    dt = np.maximum(np.diff(t), 1e-6)[:, None, None]
    before, after = both[:-1, :, None], both[1:, None, :]
    steps = np.linalg.norm(after - before, axis=-1)
    speed_limit = cfg.max_speed_mps
    cost = np.sum((steps / np.maximum(speed_limit * dt[..., None], 0.02)) ** 2, axis=-1)
    speed = np.linalg.norm(after.mean(axis=-2) - before.mean(axis=-2), axis=-1) / dt
    cost = cost + np.where(speed > speed_limit, (speed / speed_limit - 1) ** 2, 0.0)
    pair = both[:, :, 1] - both[:, :, 0]
    heading = np.arctan2(pair[..., 1], pair[..., 0])
    turn = wrap_angle(heading[1:, None, :] - heading[:-1, :, None])
    expected = np.zeros_like(dt)
    if cfg.gyro_weight > 0 and t_imu is not None and gyro_z is not None and len(t_imu) > 1:
        expected = np.interp((t[1:] + t[:-1]) / 2, t_imu, gyro_z)[:, None, None] * dt
    cost = cost + (turn / 0.75) ** 2 + cfg.gyro_weight * (wrap_angle(turn - expected) / 0.5) ** 2
    return cost + cfg.transition_penalty * (1 - np.eye(2))


def _spread(t: np.ndarray, leds: np.ndarray, dual: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The last label carried on; where it flips over a gap, single LEDs take the nearer of the interpolated pair."""
    labels = path[np.maximum(np.searchsorted(dual, np.arange(len(t)), side="right") - 1, 0)].copy()
    for k in np.flatnonzero((np.diff(path) != 0) & (np.diff(dual) > 1)):
        a, b = dual[k], dual[k + 1]
        first, last = (leds[i] if s == 0 else leds[i, ::-1] for i, s in ((a, path[k]), (b, path[k + 1])))
        for i in range(a + 1, b):
            finite = np.isfinite(leds[i]).all(axis=1)
            if not finite.any():
                continue
            which = 0 if finite[0] else 1
            share = (t[i] - t[a]) / (t[b] - t[a]) if t[b] > t[a] else 0.5
            off = np.linalg.norm(leds[i, which] - (first + share * (last - first)), axis=1)
            # state 0 says that this is LED ``which``
            labels[i] = 0 if off[which] <= off[1 - which] else 1
    return labels
