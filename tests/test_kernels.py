from dataclasses import replace

import numpy as np
import pytest

from tidemark.functions import numeric as nm
from tidemark.kernels import identity, lockstep, orientation, smoother, tracker
from tidemark.plans.config import EventSource, FilterConfig, LedIdentityConfig, OrientationConfig, load_session_config
from tidemark.sources import simulate

MODES = ("2d_full", "2d_cam_3d_imu")


def made(path, seconds=6.0, seed=0, gravity=9.81, **noise):
    samples, frames = simulate.session(simulate.SimConfig(duration_s=seconds, **noise), path, seed, gravity)
    listed = [tracker.Frame(t, z) for t, z in zip(frames["t"], frames[["x1", "y1", "x2", "y2"]].to_numpy().reshape(-1, 2, 2), strict=True)]
    return samples["t"].to_numpy(), samples, frames, listed


def tracked(mode, path, kind=tracker.ExtendedTracker, gone=None, **changes):
    t, samples, frames, listed = made(path)
    for f in listed[gone] if gone else []:
        f.leds[:] = np.nan
    cfg = FilterConfig.vision_only() if mode == "vision_only" else FilterConfig(state_mode=mode, **changes)
    u = samples[["gz", "ax", "ay", "az"][: 3 if mode == "2d_full" else 4]].to_numpy()
    out = tracker.run(kind(cfg, tracker.initial_state(cfg, listed), np.mean(np.diff(t))), t, u, listed)
    return cfg, t, u, frames, out


def position_rmse(means, frames):
    return float(np.sqrt(np.mean(np.sum((means[:, :2] - frames[["x_true", "y_true"]].to_numpy()) ** 2, axis=1))))


@pytest.mark.parametrize("kind", [tracker.ExtendedTracker, tracker.UnscentedTracker])
@pytest.mark.parametrize("mode", MODES)
def test_acceptance_on_a_circle(mode, kind):
    cfg, t, u, frames, out = tracked(mode, simulate.circle_path(), kind, damping_coeff=0.0)
    means = np.array([e.mean for e in out])
    heading = nm.wrap_angle(means[:, cfg.layout.heading_index] - frames["heading_true"])
    assert position_rmse(means, frames) < 0.02
    assert np.sqrt(np.mean(heading**2)) < np.radians(7)
    for e in out:
        assert np.allclose(e.cov, e.cov.T) and np.linalg.eigvalsh(e.cov).min() > 0


def test_extended_and_unscented_agree():
    a = np.array([e.mean[:2] for e in tracked("2d_full", simulate.line_path())[-1]])
    b = np.array([e.mean[:2] for e in tracked("2d_full", simulate.line_path(), tracker.UnscentedTracker)[-1]])
    assert np.abs(a - b).max() < 5e-3


@pytest.mark.parametrize("kind,smooth", [(tracker.ExtendedTracker, smoother.rts), (tracker.UnscentedTracker, smoother.sigma_point)])
def test_smoothing_helps_over_a_dropout(kind, smooth):
    cfg, t, u, frames, out = tracked("2d_full", simulate.circle_path(), kind, slice(60, 120), damping_coeff=0.0)
    means, covs = np.array([e.mean for e in out]), np.array([e.cov for e in out])
    vision = np.array([e.vision for e in out])
    assert not vision[60:120].any() and vision[:60].all()
    xs, ps = smooth(cfg, means, covs, vision, t, u, frames["t"].to_numpy())
    assert position_rmse(xs, frames) <= position_rmse(means, frames)
    assert (np.trace(ps, axis1=1, axis2=2) <= np.trace(covs, axis1=1, axis2=2) + 1e-9).mean() > 0.95
    assert np.array_equal(xs[-1], means[-1])


def test_iterated_smoother_and_bad_input():
    cfg, t, u, frames, out = tracked("2d_full", simulate.circle_path())
    means, covs = np.array([e.mean for e in out]), np.array([e.cov for e in out])
    twice, _ = smoother.rts(cfg, means, covs, None, t, u, frames["t"].to_numpy(), num_iter=2)
    assert position_rmse(twice, frames) < 0.02
    with pytest.raises(ValueError):
        smoother.rts(cfg, means * np.nan, covs, None, t, u, frames["t"].to_numpy())
    with pytest.raises(ValueError):
        smoother.rts(cfg, means, covs, None, t, u, frames["t"].to_numpy(), num_iter=0)


@pytest.mark.parametrize("mode,width", [("2d_full", 3), ("2d_cam_3d_imu", 4), ("2d_cam_3d_imu", 3), ("vision_only", 3), ("2d_cam_6dof_imu_orientation", 6), ("3d_cam_6dof_imu", 6)])
@pytest.mark.parametrize("driven", [False, True])
def test_transition_derivatives(mode, width, driven):
    cfg = FilterConfig(state_mode=mode, enable_zupt=mode != "vision_only", enable_experimental_accel_translation=driven)
    motion, rng = tracker.Motion(cfg), np.random.default_rng(3)
    x = motion.normalise(rng.normal(size=cfg.layout.n))
    u = rng.normal(size=width)
    _, jac = motion.step(x, u, 0.002)
    numeric = np.stack([(motion.step(x + d, u, 0.002, False)[0] - motion.step(x - d, u, 0.002, False)[0]) / 2e-6 for d in 1e-6 * np.eye(len(x))], axis=1)
    assert np.abs(numeric - jac).max() < 1e-4


def test_frame_zero_is_not_propagated_and_samples_go_to_their_interval():
    assert tracker.intervals(np.array([0.0, 0.5, 1.0, 1.5, 2.5]), np.array([0.5, 1.5])).tolist() == [0, 0, 1, 1, 2]
    cfg, t, u, frames, out = tracked("2d_full", simulate.stationary_path())
    assert np.array_equal(out[0].predicted_mean[2:4], out[0].predicted_mean[2:4])
    assert np.allclose(out[0].predicted_mean[5:], 0)


def test_gate_rejects_reflections_and_single_leds_still_update():
    t, samples, frames, listed = made(simulate.stationary_path())
    cfg = FilterConfig(state_mode="2d_full")
    listed[60].leds[:] += 0.5
    listed[70].leds[0] = np.nan
    u = samples[["gz", "ax", "ay"]].to_numpy()
    out = tracker.run(tracker.ExtendedTracker(cfg, tracker.initial_state(cfg, listed), 0.005), t, u, listed)
    assert np.abs(out[60].mean[:2] - out[60].predicted_mean[:2]).max() < 0.05
    assert np.trace(out[70].cov[:2, :2]) < np.trace(out[70].predicted_cov[:2, :2])
    free = tracker.run(tracker.ExtendedTracker(replace(cfg, use_mahalanobis_gating=False), tracker.initial_state(cfg, listed), 0.005), t, u, listed)
    assert np.abs(free[60].mean[:2] - free[60].predicted_mean[:2]).max() > 0.05


def test_events_reduce_dropout_error():
    path = simulate.circle_path(radius=0.3, omega=0.6)
    t, samples, frames, listed = made(path, seconds=8.0)
    for f in listed[90:210]:
        f.leds[:] = np.nan
    cfg, u = FilterConfig(state_mode="2d_full"), samples[["gz", "ax", "ay"]].to_numpy()

    def run():
        out = tracker.run(tracker.ExtendedTracker(cfg, tracker.initial_state(cfg, listed), 0.005), t, u, listed)
        return position_rmse(np.array([e.mean for e in out])[90:210], frames.iloc[90:210])

    without = run()
    truth = frames[["x_true", "y_true"]].to_numpy()
    for k in range(100, 210, 15):
        listed[k].fixes = [(truth[k], np.eye(2) * 1e-4)]
    assert run() < 0.7 * without


def test_three_dimensions():
    rng, offsets = np.random.default_rng(0), np.array(simulate.OFFSETS_3D)
    t, tc = np.arange(3000) / 100, np.arange(900) / 30
    u = np.tile([0.0, 0.0, 0.2, 0.0, 0.0, 9.81], (len(t), 1)) + rng.normal(0, 1e-3, (len(t), 6))
    yaw = 0.2 * tc
    leds = np.stack([np.stack([np.cos(yaw) * o, np.sin(yaw) * o, 0 * yaw], 1) for o in offsets[:, 0]], 1) + rng.normal(0, 0.002, (len(tc), 2, 3))
    cfg = FilterConfig(state_mode="3d_cam_6dof_imu")
    listed = [tracker.Frame(a, z) for a, z in zip(tc, leds, strict=True)]
    out = tracker.run(tracker.SpatialTracker(cfg, tracker.initial_state_3d(cfg, listed, offsets), 0.01, offsets), t, u, listed)
    q = out[-1].mean[6:10]
    assert np.abs(out[-1].mean[:3]).max() < 0.02
    assert abs(float(nm.wrap_angle(nm.quaternion_yaw(q) - yaw[-1]))) < np.radians(3)
    assert np.abs(np.array(nm.euler_angles(q))[:2]).max() < np.radians(2)


def test_orientation_known_answer():
    t, tc = np.arange(0, 12 + 0.0025, 0.005), np.arange(0, 12 + 1 / 60, 1 / 30)
    gyro, accel = np.zeros((len(t), 3)), np.tile([0, 0, 9.80665], (len(t), 1))
    gyro[:, 2] = 0.22 + 0.025
    half = 0.02 * np.stack([np.cos(0.22 * tc), np.sin(0.22 * tc)], 1)
    o = orientation.estimate(OrientationConfig(), t, gyro, accel, tc, np.stack([-half, half], 1))
    assert o.angles()[2][-1] == pytest.approx(2.642939567565918, abs=1e-3)
    assert o.biases[-1, 2] == pytest.approx(1.4809e-4, abs=1e-5)
    d = o.diagnostics()
    assert d["norm_min"] == pytest.approx(1) and 0 < d["camera_fraction"] < 0.2
    tilt = np.radians(10)
    leaning = orientation.estimate(OrientationConfig(), t[:500], np.zeros((500, 3)), np.tile([0, 9.80665 * np.sin(tilt), 9.80665 * np.cos(tilt)], (500, 1)))
    assert np.degrees(leaning.angles()[0][-1]) == pytest.approx(10, abs=0.1)


def test_led_identity_undoes_swaps():
    _, _, frames, _ = made(simulate.circle_path())
    swapped = simulate.swap(frames, 0.3, 4)
    leds = swapped[["x1", "y1", "x2", "y2"]].to_numpy().reshape(-1, 2, 2)
    truth = swapped["swap_applied"].to_numpy()
    found = identity.swap_labels(LedIdentityConfig(initial_state="swapped" if truth[0] else "original"), frames["t"].to_numpy(), leds, np.ones(len(leds), bool))
    assert truth.any() and np.array_equal(found, truth)
    none = identity.swap_labels(LedIdentityConfig(mode="none"), frames["t"].to_numpy(), leds, np.ones(len(leds), bool))
    assert not none.any()


def test_stream_state_goes_on_where_it_was():
    t, samples, frames, listed = made(simulate.circle_path(), seconds=3.0)
    cfg, u = FilterConfig(state_mode="2d_full"), samples[["gz", "ax", "ay"]].to_numpy()
    first = tracker.initial_state(cfg, listed)
    whole = tracker.run(tracker.ExtendedTracker(cfg, first, 0.005), t, u, listed)
    a = tracker.ExtendedTracker(cfg, first, 0.005)
    out, i = [], 0
    for k, f in enumerate(listed):
        while i < len(t) and t[i] <= f.t:
            a.sample(t[i], u[i])
            i += 1
        out.append(a.frame(f))
        if k == 40:
            a = tracker.ExtendedTracker(cfg, first, 0.005).restore(a.state())
    assert all(np.array_equal(x.mean, y.mean) for x, y in zip(whole, out, strict=True))


def test_settings_are_checked(tmp_path):
    for bad in ({"state_mode": "x"}, {"measurement_noise_pos": 0.0}, {"enable_zupt": 1}, {"mahalanobis_threshold_prob": 0.5}, {"process_noise_pos": -1.0}, {"led_distance": 0.0}, {"state_mode": "vision_only"}):
        with pytest.raises(ValueError):
            FilterConfig(**bad)
    beam = EventSource.beam(1, (0.0, 0.0), (0.4, 0.0))
    assert beam.anchor == pytest.approx((0.2, 0.0)) and beam.active_edge == "fall"
    assert sorted(np.linalg.eigvalsh(np.reshape(EventSource.beam(1, (0, 0), (1, 0)).cov, (2, 2)))) == pytest.approx([2.5e-5, 1 / 12])
    assert EventSource.zone(1, (0, 0), 0.02).cov[0] == pytest.approx(4e-4)
    assert EventSource.rfid(1, (0, 0), 0.06).cov[0] == pytest.approx(1.8e-3)
    path = tmp_path / "s.yaml"
    path.write_text("imu_file: imu.parquet\nfilter: {state_mode: vision_only}\nsources:\n- {kind: zone, source_id: 3, center: [0, 1], sigma: 0.1}\n")
    cfg = load_session_config(path)
    assert cfg.imu_file == str(tmp_path / "imu.parquet") and not cfg.filter.enable_zupt and cfg.sources[0].source_id == 3
    path.write_text("filter: {no_such: 1}\n")
    with pytest.raises(ValueError):
        load_session_config(path)


#: name: state mode, unscented
LOCKSTEP = {"planar": ("2d_full", False), "vertical": ("2d_cam_3d_imu", False), "vision": ("vision_only", False), "quaternion": ("2d_cam_6dof_imu_orientation", False), "unscented": ("2d_full", True), "spatial": ("3d_cam_6dof_imu", False)}


def many(name: str, sessions: int):
    """Sessions of unlike lengths, with gaps, one standing still; their samples, frames and the two kernels' settings."""
    mode, unscented = LOCKSTEP[name]
    cfg = FilterConfig.vision_only() if mode == "vision_only" else FilterConfig(state_mode=mode, zupt_velocity_threshold=0.5)
    body = np.array(simulate.OFFSETS_3D) if name == "spatial" else None
    names = {"2d_full": ["gz", "ax", "ay"], "2d_cam_3d_imu": ["gz", "ax", "ay", "az"], "vision_only": ["gz", "ax", "ay"]}.get(mode, ["gx", "gy", "gz", "ax", "ay", "az"])
    rng = np.random.default_rng(3)
    parts = []
    for i in range(sessions):
        samples, frames = simulate.session(simulate.SimConfig(duration_s=0.8 + 0.2 * (i % 5), fs_imu=60.0), simulate.circle_path(), i, 9.81)
        leds = frames[["x1", "y1", "x2", "y2"]].to_numpy().reshape(-1, 2, 2)
        leds[rng.random(leds.shape[:2]) < 0.15] = np.nan
        if name == "spatial":
            leds = np.concatenate([leds, np.where(np.isnan(leds[:, :, :1]), np.nan, 0.0)], axis=2)
        parts.append((samples["t"].to_numpy(), samples[names].to_numpy(), [tracker.Frame(t, z) for t, z in zip(frames["t"], leds, strict=True)]))
    first = [tracker.initial_state(cfg, f) if body is None else tracker.initial_state_3d(cfg, f, body) for _, _, f in parts]
    at = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])
    data = lockstep.Sessions(
        np.concatenate([t for t, _, _ in parts]), np.concatenate([u for _, u, _ in parts]), at([len(t) for t, _, _ in parts]), np.array([f.t for p in parts for f in p[2]]),
        np.array([f.leds for p in parts for f in p[2]]), np.ones(sum(len(p[2]) for p in parts), bool), at([len(p[2]) for p in parts]),
    )
    run = lambda: lockstep.Filter(cfg, data, tuple(map(np.array, zip(*first, strict=True))), np.full(sessions, 0.04), unscented, body).run()
    return cfg, body, unscented, parts, first, data, run


@pytest.mark.parametrize("name", LOCKSTEP)
def test_lockstep_equals_the_kernels_of_one_session(name):
    cfg, body, unscented, parts, first, data, run = many(name, 7)
    out = run()
    smooth = (lockstep.sigma_point if unscented else lockstep.rts)(cfg, data, out.mean, out.cov, out.vision)
    kind = tracker.SpatialTracker if body is not None else tracker.UnscentedTracker if unscented else tracker.ExtendedTracker
    for i, (t, u, frames) in enumerate(parts):
        extra = () if body is None else (body,)
        one = tracker.run(kind(cfg, first[i], float(np.mean(np.diff(t))), *extra), t, u, frames)
        at = slice(data.f_at[i], data.f_at[i + 1])
        for c in ("mean", "cov", "predicted_mean", "predicted_cov", "loglik", "vision", "nis_dim"):
            assert np.allclose(getattr(out, c)[at], np.array([getattr(e, c) for e in one], float), rtol=1e-6, atol=1e-8), c
        assert np.allclose(out.nis[at], [np.nan if e.nis is None else e.nis for e in one], rtol=1e-6, equal_nan=True)
        means, covs, vision, t_frames = np.array([e.mean for e in one]), np.array([e.cov for e in one]), np.array([e.vision for e in one]), np.array([f.t for f in frames])
        back = smoother.sigma_point(cfg, means, covs, vision, t, u, t_frames) if unscented else smoother.rts(cfg, means, covs, vision, t, u, t_frames)
        for a, b in zip(smooth, back, strict=True):
            assert np.allclose(a[at], b, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("name", LOCKSTEP)
def test_sessions_share_their_steps(monkeypatch, name):
    """Five times the sessions, of the same lengths: no more steps."""
    calls = []
    solve = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or solve(*a))
    counts = []
    for sessions in (10, 50):
        run = many(name, sessions)[-1]
        calls.clear()
        run()
        counts.append(len(calls))
    assert 0 < counts[1] < 1.5 * counts[0]
