"""How one session's inertial data agree with its camera: biases, gravity, clock lag, axes and signs."""

from __future__ import annotations

import itertools

import numpy as np

from tidemark.operators.calculus import gaussian_weights

AXES = ("x", "y", "z")
#: Lags of the inertial clock that are tried, in seconds.
LAGS = np.linspace(-0.5, 0.5, 101)


def _smoothed(values: np.ndarray, sigma_rows: float) -> np.ndarray:
    """Rows of values under a Gaussian, mirrored at the ends."""
    weights = gaussian_weights(sigma_rows)
    radius = len(weights) // 2
    padded = np.pad(values, ((radius, radius), (0, 0)), mode="reflect")
    return np.stack([np.convolve(c, weights, mode="valid") for c in padded.T], axis=1)


def _slope(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.gradient(values, t, axis=0, edge_order=2)


def camera_motion(t: np.ndarray, leds: np.ndarray, sigma_s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From LED pairs (n, 2, 2), NaN where unseen: dual frames, midpoint speed, heading rate, and acceleration in the body's frame (n, 2).

    Gaps are filled along time between dual frames before anything is
    smoothed; the speed is of the unsmoothed midpoint, NaN beside gaps.
    """
    dual = np.isfinite(leds).all(axis=(1, 2))
    if dual.sum() < 3:
        raise ValueError("fewer than three frames show both LEDs")
    middle, across = leds.mean(axis=1), leds[:, 1] - leds[:, 0]
    track = np.column_stack([middle[dual], np.unwrap(np.arctan2(across[dual, 1], across[dual, 0]))])
    track = np.stack([np.interp(t, t[dual], c) for c in track.T], axis=1)
    sigma_rows = sigma_s / float(np.median(np.diff(t)))
    track = _smoothed(track, sigma_rows) if sigma_rows > 0 else track
    rates = _slope(t, track)
    world = _slope(t, rates[:, :2])
    turn = np.exp(-1j * track[:, 2]) * (world[:, 0] + 1j * world[:, 1])
    speed = np.linalg.norm(_slope(t, middle), axis=1)
    return dual, speed, rates[:, 2], np.stack([turn.real, turn.imag], axis=1)


def lag_scan(t: np.ndarray, source: np.ndarray, t_goal: np.ndarray, goal: np.ndarray, lags: np.ndarray) -> dict[str, float] | None:
    """The line of goal on source at t_goal + lag with the largest absolute correlation; None if no lag has three pairs that vary."""
    best = None
    for lag in lags:
        x = np.interp(t_goal + lag, t, source, left=np.nan, right=np.nan)
        use = np.isfinite(x) & np.isfinite(goal)
        if use.sum() < 3:
            continue
        (vx, cxy), (_, vy) = np.cov(x[use], goal[use])
        if not (vx > 0 and vy > 0):
            continue
        corr = float(cxy / np.sqrt(vx * vy))
        if best is None or abs(corr) > abs(best["corr"]):
            slope = float(cxy / vx)
            best = {"lag": float(lag), "corr": corr, "slope": slope, "intercept": float(goal[use].mean() - slope * x[use].mean()), "r2": corr * corr, "n": int(use.sum())}
    return best


def calibrate(t: np.ndarray, gyro_z: np.ndarray, accel: np.ndarray, t_cam: np.ndarray, leds: np.ndarray, gyro_limit: float = 0.2, speed_limit: float = 0.05, sigma_s: float = 0.1, lags: np.ndarray = LAGS) -> dict:
    """One session's report; raises ValueError if the data can't show it."""
    dual, speed, rate, body = camera_motion(t_cam, leds, sigma_s)
    seen = np.interp(t, t_cam, speed, left=np.nan, right=np.nan)
    still = (np.abs(gyro_z) < gyro_limit) & (seen < speed_limit)  # NaN is not still
    if not still.any():
        raise ValueError("no stationary samples: do the clocks overlap, and does the session have calm stretches?")
    bias, gravity = float(np.nanmedian(gyro_z[still])), np.nanmedian(accel[still], axis=0)
    yaw = lag_scan(t, gyro_z - bias, t_cam, np.where(dual, rate, np.nan), lags)
    if yaw is None:
        raise ValueError("no lag lets the gyroscope and the camera's turn be compared: do their times overlap, and do both vary?")
    out = {"gyro_bias": bias, **{f"gravity_{a}": float(g) for a, g in zip(AXES, gravity, strict=True)}, "stationary_samples": int(still.sum()), "stationary_fraction": float(still.mean()), **{f"yaw_{k}": v for k, v in yaw.items()}}
    fits = [[lag_scan(t, accel[:, k] - gravity[k], t_cam, np.where(dual, body[:, j], np.nan), lags) for k in range(3)] for j in range(2)]
    # an axis serves one direction only; its sign makes the correlation positive
    pairs = [(i, j) for i, j in itertools.permutations(range(3), 2) if fits[0][i] and fits[1][j]]
    if not pairs:
        raise ValueError("no two accelerometer axes can be compared with the camera's acceleration")
    chosen = max(pairs, key=lambda p: abs(fits[0][p[0]]["corr"]) + abs(fits[1][p[1]]["corr"]))
    for name, row, k in zip("xy", fits, chosen, strict=True):
        out |= {f"body_{name}_axis": AXES[k], f"body_{name}_sign": 1 if row[k]["corr"] > 0 else -1, f"body_{name}_lag": row[k]["lag"], f"body_{name}_corr": abs(row[k]["corr"]), f"body_{name}_n": row[k]["n"]}
    return out
