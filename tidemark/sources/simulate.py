"""Simulated sessions: two tables, inertial samples and camera frames, from seeded generators.

Every session is generated whole by one task from its own seed, so results
don't depend on partitions or cluster size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAVITY = 9.80665
LED_DISTANCE = 0.04
OFFSETS_3D = [[-0.03, 0.0, 0.0], [0.03, 0.0, 0.0]]
_BOTH = "session_id bigint, kind string, t double, gx double, gy double, gz double, ax double, ay double, az double, x1 double, y1 double, x2 double, y2 double, mask boolean, leds array<array<double>>, x_true double, y_true double, vx_true double, vy_true double, heading_true double"


@dataclass(frozen=True)
class SimConfig:
    """Clocks and noise."""

    duration_s: float = 10.0
    fs_imu: float = 200.0
    fs_cam: float = 30.0
    gyro_noise_density: float = 1e-4
    accel_noise_density: float = 0.03
    gyro_bias_std: float = 1e-3
    accel_bias_std: float = 0.01
    cam_noise_std: float = 0.002
    cam_dropout_prob: float = 0.0

    def __post_init__(self) -> None:
        if not all(math.isfinite(v) and v >= 0 for v in self.__dict__.values()):
            raise ValueError("settings must be finite and not negative")
        if self.duration_s * min(self.fs_imu, self.fs_cam) < 2:
            raise ValueError("a session needs two samples and two frames")
        if self.cam_dropout_prob > 1:
            raise ValueError("cam_dropout_prob is a probability")


Path = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def session(cfg: SimConfig, path: Path, seed: int, gravity: float = GRAVITY) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Samples and frames of one session; path(t) gives position, velocity, acceleration (n, 2), heading and turn rate."""
    rng = np.random.default_rng(seed)
    t, tc = np.arange(int(cfg.duration_s * cfg.fs_imu)) / cfg.fs_imu, np.arange(int(cfg.duration_s * cfg.fs_cam)) / cfg.fs_cam
    per_sample = math.sqrt(cfg.fs_imu)
    pos, vel, acc, yaw, rate = path(t)
    c, s = np.cos(yaw), np.sin(yaw)
    noise = lambda density, n: rng.normal(0, density * per_sample, n)
    bias_g, bias_a = rng.normal(0, cfg.gyro_bias_std), rng.normal(0, cfg.accel_bias_std, 3)
    n = len(t)
    body = np.stack([c * acc[:, 0] + s * acc[:, 1], c * acc[:, 1] - s * acc[:, 0], np.full(n, gravity)], 1)
    body += bias_a + np.stack([noise(cfg.accel_noise_density, n) for _ in range(3)], 1)
    samples = pd.DataFrame({"t": t, "gx": noise(cfg.gyro_noise_density, n), "gy": noise(cfg.gyro_noise_density, n), "gz": rate + bias_g + noise(cfg.gyro_noise_density, n), "ax": body[:, 0], "ay": body[:, 1], "az": body[:, 2]})
    pos, vel, _, yaw, _ = path(tc)
    half = LED_DISTANCE / 2 * np.stack([np.cos(yaw), np.sin(yaw)], 1)
    seen = rng.random(len(tc)) >= cfg.cam_dropout_prob
    leds = np.stack([pos - half, pos + half], 1) + rng.normal(0, cfg.cam_noise_std, (len(tc), 2, 2))
    leds[~seen] = np.nan
    frames = pd.DataFrame({"t": tc, "x1": leds[:, 0, 0], "y1": leds[:, 0, 1], "x2": leds[:, 1, 0], "y2": leds[:, 1, 1], "mask": seen, "x_true": pos[:, 0], "y_true": pos[:, 1], "vx_true": vel[:, 0], "vy_true": vel[:, 1], "heading_true": yaw})
    return samples, frames


def stationary_path(x: float = 0.5, y: float = 0.5, heading: float = 0.0) -> Path:
    return lambda t: (np.tile([x, y], (len(t), 1)), np.zeros((len(t), 2)), np.zeros((len(t), 2)), np.full(len(t), heading), np.zeros(len(t)))


def line_path(start: tuple[float, float] = (0.1, 0.1), velocity: tuple[float, float] = (0.2, 0.1)) -> Path:
    v = np.array(velocity)
    return lambda t: (np.array(start) + t[:, None] * v, np.tile(v, (len(t), 1)), np.zeros((len(t), 2)), np.full(len(t), math.atan2(v[1], v[0])), np.zeros(len(t)))


def circle_path(radius: float = 0.3, omega: float = 0.5, center: tuple[float, float] = (0.5, 0.5)) -> Path:
    def path(t: np.ndarray):
        out = radius * np.stack([np.cos(omega * t), np.sin(omega * t)], 1)
        along = radius * omega * np.stack([-np.sin(omega * t), np.cos(omega * t)], 1)
        return np.array(center) + out, along, -(omega**2) * out, omega * t + math.copysign(math.pi / 2, omega), np.full(len(t), omega)

    return path


def ou_step(x: np.ndarray, mean: np.ndarray, tau: float, sigma: float, dt: float, rng: np.random.Generator) -> np.ndarray:
    """One step of a mean-reverting process with stationary spread sigma."""
    keep = math.exp(-dt / tau)
    return mean + (x - mean) * keep + sigma * math.sqrt(1 - keep * keep) * rng.normal(size=np.shape(x))


def wander_path(duration: float, seed: int, size: float = 1.0, speed: float = 0.15, tau: float = 1.0, turn_tau: float = 0.5, step: float = 0.01) -> Path:
    """A smooth random walk in a box: speed and turn rate revert to their means, walls reflect."""
    rng = np.random.default_rng(seed + 7919)
    n = int(duration / step) + 3
    pos, heading, v, w = np.empty((n, 2)), np.empty(n), speed, 0.0
    pos[0], heading[0] = size / 2, rng.uniform(-math.pi, math.pi)
    for i in range(1, n):
        v = abs(float(ou_step(np.array(v), np.array(speed), tau, speed / 2, step, rng)))
        w = float(ou_step(np.array(w), np.array(0.0), turn_tau, 1.0, step, rng))
        h = heading[i - 1] + w * step
        move = v * step * np.array([math.cos(h), math.sin(h)])
        for axis in range(2):
            if not 0 <= pos[i - 1, axis] + move[axis] <= size:
                move[axis] *= -1
                h = math.atan2(move[1], move[0])
        pos[i], heading[i] = pos[i - 1] + move, h
    grid = np.arange(n) * step
    turned = np.unwrap(heading)
    kernel = np.hanning(21) / np.hanning(21).sum()
    blur = lambda a: np.convolve(np.pad(a, 10, mode="edge"), kernel, mode="valid")
    place = np.stack([blur(pos[:, k]) for k in range(2)], 1)
    turned = blur(turned)
    vel, rate = np.gradient(place, grid, axis=0), np.gradient(turned, grid)
    acc = np.gradient(vel, grid, axis=0)
    at = lambda t, a: np.interp(t, grid, a)
    two = lambda t, a: np.stack([at(t, a[:, k]) for k in range(2)], 1)
    return lambda t: (two(t, place), two(t, vel), two(t, acc), at(t, turned), at(t, rate))


def blackout(frames: pd.DataFrame, start: float, end: float) -> pd.DataFrame:
    """frames without LEDs in [start, end)."""
    gone = (frames["t"] >= start) & (frames["t"] < end)
    return frames.assign(mask=frames["mask"] & ~gone, **{c: frames[c].mask(gone) for c in ("x1", "y1", "x2", "y2")})


def swap(frames: pd.DataFrame, share: float, seed: int) -> pd.DataFrame:
    """frames whose labels are exchanged in random runs that cover about ``share``."""
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    rng = np.random.default_rng(seed)
    # runs of about ten frames; so many of them are exchanged that their frames make the share
    run = np.cumsum(rng.random(len(frames)) < 0.1)
    order = rng.permutation(run.max() + 1) if len(frames) else run
    sizes = np.bincount(run)[order] if len(frames) else run
    chosen = order[np.cumsum(sizes) - sizes / 2 < share * len(frames)]
    state = np.isin(run, chosen)
    out = frames.copy()
    out.loc[state, ["x1", "y1", "x2", "y2"]] = frames.loc[state, ["x2", "y2", "x1", "y1"]].to_numpy()
    return out.assign(swap_applied=state)


def sessions(spark: SparkSession, n: int, make: Callable[[int], tuple[pd.DataFrame, pd.DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Samples and frames of sessions 0 to n - 1, make(session) on the executors."""
    names = [c.split()[0] for c in _BOTH.split(", ")]

    def run(batches):
        for ids in batches:
            for i in ids["id"]:
                for kind, table in zip(("sample", "frame"), make(int(i)), strict=True):
                    whole = table.assign(session_id=i, kind=kind, **({} if "leds" in table else {"leds": None}))
                    yield whole.reindex(columns=names).astype({"mask": "boolean"})

    both = spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(run, _BOTH)
    samples = both.where("kind = 'sample'").select("session_id", "t", "gx", "gy", "gz", "ax", "ay", "az")
    led = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    frames = both.where("kind = 'frame'").select("session_id", "t", *map(led, ("x1", "y1", "x2", "y2")), "mask", "leds", "x_true", "y_true", "vx_true", "vy_true", "heading_true")
    return samples, frames


def circular(spark: SparkSession, n: int, seconds: float, **noise: float) -> tuple[DataFrame, DataFrame]:
    cfg = SimConfig(duration_s=seconds, **noise)
    samples, frames = sessions(spark, n, lambda i: session(cfg, circle_path(omega=0.3 + 0.05 * i), i))
    return samples, frames.drop("leds")


def rat(spark: SparkSession, n: int, seconds: float, **noise: float) -> tuple[DataFrame, DataFrame]:
    cfg = SimConfig(duration_s=seconds, **noise)
    samples, frames = sessions(spark, n, lambda i: session(cfg, wander_path(seconds, i), i))
    return samples, frames.drop("leds")


def spatial(spark: SparkSession, n: int, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Sessions in three dimensions: a turn about the vertical at rest, LEDs as arrays."""
    cfg = SimConfig(duration_s=seconds, fs_imu=100.0)

    def make(i: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        omega = 0.1 * i
        samples, frames = session(cfg, lambda t: (np.zeros((len(t), 2)), np.zeros((len(t), 2)), np.zeros((len(t), 2)), omega * t, np.full(len(t), omega)), i, 9.81)
        rng = np.random.default_rng(1000 + i)
        yaw = frames["heading_true"].to_numpy()
        rot = np.stack([np.stack([np.cos(yaw), -np.sin(yaw), 0 * yaw], 1), np.stack([np.sin(yaw), np.cos(yaw), 0 * yaw], 1), np.tile([0.0, 0.0, 1.0], (len(yaw), 1))], 1)
        leds = np.einsum("nij,lj->nli", rot, np.array(OFFSETS_3D)) + rng.normal(0, 0.002, (len(yaw), len(OFFSETS_3D), 3))
        return samples, frames.assign(leds=[[list(map(float, p)) for p in row] for row in leds])

    samples, frames = sessions(spark, n, make)
    return samples, frames.select("session_id", "t", "leds")
