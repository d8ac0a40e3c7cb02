"""Files, whole sessions, streams and the command line."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.kernels import tracker
from tidemark.operators import calculus, calibration, filters, qa, temporal, validation
from tidemark.plans.config import CalibrationGates, CameraColumns, EventSource, FilterConfig, ImuColumns, SessionConfig
from tidemark.sources import files, simulate
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def recorded(tmp_path_factory):
    """A recording as raw counts and pixels, with trigger events."""
    folder = tmp_path_factory.mktemp("recording")
    samples, frames = simulate.session(simulate.SimConfig(duration_s=4.0), simulate.circle_path(), 1)
    gyro, accel = 0.061 * np.pi / 180, 0.000061 * 9.80665
    raw = pd.DataFrame({"time": 100 + samples["t"]})
    for axis, name in ImuColumns().axes.items():
        raw[name] = (samples[axis] / (gyro if axis[0] == "g" else accel)).round().astype(int)
    raw.to_parquet(folder / "imu.parquet")
    pd.DataFrame({"time": 100 + frames["t"], "xloc": frames["x1"] / 0.01, "yloc": frames["y1"] / 0.01, "xloc2": frames["x2"] / 0.01, "yloc2": frames["y2"] / 0.01}).to_parquet(folder / "pos.parquet")
    pd.DataFrame({"time": [100.5, 101.0, 102.0], "source_id": [1, 1, 2], "edge": ["rise", "fall", "rise"]}).to_parquet(folder / "events.parquet")
    return folder


def settings(folder, **more):
    return SessionConfig(imu_file=str(folder / "imu.parquet"), position_file=str(folder / "pos.parquet"), camera=CameraColumns(meters_per_pixel=0.01), filter=FilterConfig(state_mode="2d_full"), **more)


def test_load_and_track(spark, recorded):
    sources = (EventSource.zone(1, (0.5, 0.5), 1.0), EventSource.zone(2, (0.5, 0.5), 1.0))
    s = files.load_session(spark, settings(recorded, events_file=str(recorded / "events.parquet"), sources=sources))
    acc = s.accounting.first()
    assert (acc["n_total"], acc["n_edge_mismatch"]) == (3, 1)
    out = filters.track(s.samples, s.frames, s.config.filter, smooth=True).toPandas()
    assert len(out) == 120 and out["vision"].all() and len(out["cov"][0]) == 64
    assert (out["nis_dim"] == 4).all()
    # the innovation's distance, from the prediction and the LEDs' linearisation
    listed = s.frames.orderBy("t").toPandas()
    cfg = s.config.filter
    spacing = cfg.led_distance or float(np.median(np.hypot(listed["x2"] - listed["x1"], listed["y2"] - listed["y1"])))
    for k in (10, 60, 119):
        expected, h = tracker.led_measurement(tracker.Motion(cfg), np.array(out["predicted_mean"][k]), spacing)
        v = listed.loc[k, ["x1", "y1", "x2", "y2"]].to_numpy(float) - expected
        cov = h @ np.array(out["predicted_cov"][k]).reshape(8, 8) @ h.T + cfg.measurement_noise_pos * np.eye(4)
        assert out["nis"][k] == pytest.approx(v @ np.linalg.solve(cov, v), rel=0.02)  # the solver boosts the diagonal
    # a steady turn: nothing stands still, so the data can't be judged
    judged = s.calibration.withColumn("text", calibration.report_text()).first()
    assert "stationary" in judged["problem"] and judged["text"].startswith("inertial calibration of session 0 failed")
    assert np.isfinite(np.stack(out["smoothed_mean"])).all()


def test_readers_refuse_bad_tables(spark, tmp_path, recorded):
    pd.DataFrame({"time": [0.0]}).to_parquet(tmp_path / "e.parquet")
    with pytest.raises(ValueError, match="lacks"):
        files.read_events(spark, str(tmp_path / "e.parquet"))
    for bad in ({"source_id": [0.5], "edge": ["rise"]}, {"source_id": [1], "edge": ["up"]}):
        pd.DataFrame({"time": [0.0], **bad}).to_parquet(tmp_path / "e.parquet")
        with pytest.raises(ValueError, match="can't be read"):
            files.read_events(spark, str(tmp_path / "e.parquet"))
    (tmp_path / "m.txt").write_text("1 2\n3 4\n")
    assert [tuple(r)[1:] for r in files.read_matrix(spark, str(tmp_path / "m.txt"), ["a", "b"]).collect()] == [(1.0, 2.0), (3.0, 4.0)]
    with pytest.raises(Exception, match="expected 3"):
        files.read_matrix(spark, str(tmp_path / "m.txt"), ["a", "b", "c"]).collect()


def test_sample_and_hold_repeats_go(spark, tmp_path):
    raw = pd.DataFrame({"time": 100 + 0.005 * np.arange(5), **{n: 0 for n in ImuColumns().axes.values()}})
    raw["Headstage_GyroZ"] = [0, 0, 10, 10, 20]
    raw.to_parquet(tmp_path / "imu.parquet")
    out = files.read_imu(spark, str(tmp_path / "imu.parquet"), SessionConfig()).orderBy("t").toPandas()
    assert len(out) == 3 and out["gz"].tolist() == pytest.approx([0, 10 * 0.061 * np.pi / 180, 20 * 0.061 * np.pi / 180])


def moving(seconds=40.0, lag=0.12, seed=3):
    """A rig that rests, then drives and turns; the accelerometer's y looks forward, x to the right, and its clock is late."""
    rng = np.random.default_rng(seed)
    t = np.arange(0, seconds, 0.005)
    busy = np.clip((t - 8) / 2, 0, 1)
    rate = busy * (0.8 * np.sin(0.9 * t) + 0.8 * np.sin(6 * t))
    speed = busy * (0.3 + 0.2 * np.sin(1.7 * t))
    heading = np.cumsum(rate) * 0.005
    vel = speed[:, None] * np.stack([np.cos(heading), np.sin(heading)], 1)
    pos, acc = np.cumsum(vel, axis=0) * 0.005, np.gradient(vel, 0.005, axis=0)
    body = np.stack([np.cos(heading) * acc[:, 0] + np.sin(heading) * acc[:, 1], -np.sin(heading) * acc[:, 0] + np.cos(heading) * acc[:, 1]], 1)
    noise = lambda s: rng.normal(0, s, len(t))
    samples = pd.DataFrame({"session_id": 1, "t": t + lag, "gz": rate + 0.03 + noise(0.005), "ax": 0.1 - body[:, 1] + noise(0.02), "ay": 0.2 + body[:, 0] + noise(0.02), "az": 9.81 + noise(0.02)})
    seen = slice(None, None, 7)
    across = 0.02 * np.stack([np.cos(heading), np.sin(heading)], 1)[seen]
    a, b = pos[seen] - across, pos[seen] + across
    frames = pd.DataFrame({"session_id": 1, "t": t[seen], "x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1]})
    frames.loc[300:306, ["x1", "y1"]] = np.nan
    return samples, frames


def test_calibration_finds_lag_axes_and_signs(spark):
    samples, frames = moving()
    every = [spark.createDataFrame(pd.concat([df, df.assign(session_id=2).iloc[:2]])) for df in (samples, frames)]
    reports = calibration.calibrate(*every).withColumn("text", calibration.report_text())
    one, two = (reports.where(f"session_id = {i}").first() for i in (1, 2))
    assert one["gyro_bias"] == pytest.approx(0.03, abs=0.005) and one["gravity_z"] == pytest.approx(9.81, abs=0.02)
    assert one["yaw_lag"] == pytest.approx(0.12, abs=0.021) and one["yaw_corr"] > 0.95 and one["yaw_slope"] == pytest.approx(1, abs=0.1)
    assert (one["body_x_axis"], one["body_x_sign"], one["body_y_axis"], one["body_y_sign"]) == ("y", 1, "x", -1)
    assert one["body_x_corr"] > 0.8 and "body x: +y" in one["text"] and "body y: -x" in one["text"]
    assert two["failure"] and two["gyro_bias"] is None
    gates = CalibrationGates(max_horizontal_gravity=0.2)
    verdict = lambda **kw: [r["problem"] for r in calibration.verdicts(reports, CalibrationGates(**kw.pop("gates", {})), **kw).orderBy("session_id").collect()]
    assert verdict(fused=False) == [None, None] and verdict()[0] is None and verdict()[1] == two["failure"]
    assert "gravity" in verdict(translation=True, gates={"max_horizontal_gravity": 0.2})[0] and verdict(gates={"max_horizontal_gravity": 0.2})[0] is None
    assert "yaw" in verdict(gates={"min_yaw_corr": 0.9999})[0] and gates.run
    # the scan alone, against the correlation of every lag
    from tidemark.kernels.calibration import lag_scan

    t, goal = frames["t"].to_numpy(), np.sin(frames["t"].to_numpy())
    lags = np.linspace(-0.3, 0.3, 13)
    found = lag_scan(samples["t"].to_numpy(), samples["gz"].to_numpy(), t, goal, lags)
    tries = []
    for lag in lags:
        x = np.interp(t + lag, samples["t"], samples["gz"], left=np.nan, right=np.nan)
        tries.append(abs(np.corrcoef(x[np.isfinite(x)], goal[np.isfinite(x)])[0, 1]))
    assert abs(found["corr"]) == pytest.approx(max(tries)) and found["lag"] == pytest.approx(lags[int(np.argmax(tries))])
    assert lag_scan(t, np.zeros(len(t)), t, goal, lags) is None


def test_constant_sessions_have_no_correlation(spark):
    source = spark.sql("SELECT id % 3 AS session_id, cast(id as double) t, CASE WHEN id % 3 = 0 THEN 1.0D ELSE sin(id) END AS v FROM range(60)")
    goal = spark.sql("SELECT id % 3 AS session_id, cast(id as double) t, CASE WHEN id % 3 = 1 THEN 2.0D ELSE cos(id) END AS g FROM range(60)")
    fits = {r["session_id"]: r["correlation"] for r in calculus.lag_fits(source, "v", goal, "g", [0.0]).collect()}
    assert fits[0] is None and fits[1] is None and -1 <= fits[2] <= 1
    assert calculus.best_lag(calculus.lag_fits(source, "v", goal, "g", [0.0, 3.0])).count() == 1


def test_swaps_cover_their_share():
    _, frames = simulate.session(simulate.SimConfig(duration_s=60.0), simulate.circle_path(), 1)
    for share in (0.0, 0.02, 0.3, 1.0):
        assert simulate.swap(frames, share, 5)["swap_applied"].mean() == pytest.approx(share, abs=0.02)
    with pytest.raises(ValueError):
        simulate.swap(frames, 1.5, 5)


def test_3d_tracks_are_smoothed(spark):
    samples, frames = simulate.spatial(spark, 2, 3.0)
    out = filters.track_3d(samples, frames, simulate.OFFSETS_3D, FilterConfig(state_mode="3d_cam_6dof_imu"), smooth=True).toPandas()
    trace = lambda c: np.stack(out[c]).reshape(len(out), 16, 16).trace(axis1=1, axis2=2)
    assert (trace("smoothed_cov") <= trace("cov") * (1 + 1e-6)).mean() > 0.95
    # at rest: the smoothed path stays closer to the origin than the filter's
    off = lambda c: np.sqrt((np.stack(out[c])[:, :3] ** 2).sum(1).mean())
    assert off("smoothed_mean") <= off("mean") and (out["nis_dim"] == 3 * len(simulate.OFFSETS_3D)).all()


def test_masks_are_checked(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 0.5), (2, None)], "session_id long, mask double")
    assert {r["session_id"]: r["n_bad"] for r in validation.mask_violations(rows).collect()} == {1: 0, 2: 2}


def test_nis_of_innovations(spark):
    df = spark.createDataFrame([([2.0, 1.0], [4.0, 0.0, 0.0, 1.0]), ([1.0, 1.0], [1.0, 2.0, 2.0, 1.0])], "v array<double>, s array<double>")
    assert [r[0] for r in df.select(filters.nis("v", "s")).collect()] == [pytest.approx(2.0), float("inf")]


def test_bucketing_rules(spark):
    frames = temporal.numbered_frames(spark.sql("SELECT 1L session_id, id event_id, cast(id as double) t FROM range(3)"))
    events = spark.sql("SELECT 1L session_id, * FROM VALUES (0L, 0.0D, 7L, 'rise'), (1L, 0.5D, 7L, 'rise'), (2L, 1.0D, 7L, 'rise'), (3L, 1.5D, 7L, 'fall'), (4L, 9.0D, 7L, 'rise'), (5L, 1.0D, 8L, 'rise') AS e(event_id, t, source_id, edge)")
    sources = spark.sql("SELECT 7L source_id, 'rise' active_edge")
    out = {r["event_id"]: (r["fate"], r["frame"], r["slot"]) for r in temporal.bucket_events(events, sources, frames).collect()}
    assert out == {0: ("before", None, None), 1: ("kept", 1, 0), 2: ("kept", 1, 1), 3: ("edge_mismatch", None, None), 4: ("after", None, None), 5: ("unknown_source", None, None)}
    bucketed = temporal.bucket_events(events, sources, frames)
    with pytest.raises(ValueError):
        temporal.check_bucketed(bucketed)
    known = bucketed.where("fate <> 'unknown_source'")
    temporal.check_bucketed(known, 2)
    with pytest.raises(ValueError):
        temporal.check_bucketed(known, 1)


def test_nees_of_full_states(spark):
    df = spark.createDataFrame([([0.0, 0.0], [4.0, 0.0, 0.0, 1.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 2.0, 2.0, 1.0], [1.0, 1.0])], "m array<double>, c array<double>, x array<double>")
    out = [r[0] for r in df.select(filters.nees("m", "c", "x")).collect()]
    assert out[0] == pytest.approx(2.0) and out[1] == float("inf")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.03, 0.04)] * 3, "session_id int, a double, b double, c double, d double")
    assert qa.rmse(rows, [("a", "c"), ("b", "d")]).first()["rmse"] == pytest.approx(0.05)


def test_stream_equals_batch_over_three_batches(spark, tmp_path):
    samples, frames = simulate.session(simulate.SimConfig(duration_s=2.0), simulate.circle_path(), 2)
    table = pd.concat([samples.assign(kind="sample"), frames.assign(kind="frame")]).sort_values("t", kind="stable").assign(session_id=1)
    table = table[["session_id", "kind", "t", "gz", "ax", "ay", "az", "x1", "y1", "x2", "y2"]]
    schema = None
    for i, part in enumerate(np.array_split(np.arange(len(table)), 3)):
        df = spark.createDataFrame(table.iloc[part])
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    cfg = FilterConfig(state_mode="2d_full")
    listed = [tracker.Frame(t, z) for t, z in zip(frames["t"], frames[["x1", "y1", "x2", "y2"]].to_numpy().reshape(-1, 2, 2), strict=True)]
    mean, cov = tracker.initial_state(cfg, listed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streams.drain(streams.stream_track(stream, cfg, mean.tolist(), cov.ravel().tolist(), 0.005), "track").orderBy("frame").toPandas()
    u = samples[["gz", "ax", "ay"]].to_numpy()
    batch = tracker.run(tracker.ExtendedTracker(cfg, (mean, cov), 0.005), samples["t"].to_numpy(), u, listed)
    assert len(out) >= len(listed) - 1
    assert np.allclose(np.stack(out["mean"]), [e.mean for e in batch][: len(out)], atol=1e-12)


def test_command_line(spark, recorded, tmp_path, capsys):
    (recorded / "s.yaml").write_text("imu_file: imu.parquet\nposition_file: pos.parquet\ncamera: {meters_per_pixel: 0.01}\nfilter: {state_mode: 2d_full}\n")
    assert cli.main(["smooth", "--config", str(recorded / "s.yaml"), "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o" / "estimates")).count() == 120
    assert spark.read.json(str(tmp_path / "o" / "safety")).first()["passed"]
    assert cli.main(["filter", "--config", str(recorded / "s.yaml"), "--out", str(tmp_path / "p"), "--state-mode", "nope"]) == 1
    assert "state_mode" in capsys.readouterr().err
    est = spark.read.parquet(str(tmp_path / "o" / "estimates"))
    table = cli.named(est, FilterConfig(state_mode="2d_full"), "smoothed_mean").select("session_id", "t", "x", "y", "vx", "vy", "heading", F.lit(5.0).alias("nees"))
    table.write.parquet(str(tmp_path / "est"))
    table.select("session_id", "t", *(F.col(c).alias(f"{c}_true") for c in ("x", "y", "vx", "vy", "heading"))).write.parquet(str(tmp_path / "truth"))
    assert cli.main(["report", "--run", str(tmp_path / "est"), "--truth", str(tmp_path / "truth"), "--out", str(tmp_path / "r"), "--state-dim", "8"]) == 0
    assert spark.read.json(str(tmp_path / "r" / "report")).first()["targets_met"]


def test_many_sessions_are_tracked_as_each_alone(spark, monkeypatch):
    """Tasks gather few rows at a time, one session is long, one has no frames, one no samples, one no number."""
    monkeypatch.setattr(filters, "ROWS", 50)
    monkeypatch.setattr(filters, "LONG", 120)
    cfg = FilterConfig(state_mode="2d_cam_6dof_imu_orientation")
    parts = {}
    for i, seconds in enumerate((0.5, 0.8, 2.0, 0.6, 0.5, 0.7)):
        samples, frames = simulate.session(simulate.SimConfig(duration_s=seconds, fs_imu=60.0), simulate.circle_path(), i, 9.81)
        frames.loc[3:5, ["x1", "y1"]] = np.nan
        parts[i] = samples[["t", "gx", "gy", "gz", "ax", "ay", "az"]], frames[["t", "x1", "y1", "x2", "y2"]]
    key = lambda i: None if i == 5 else i
    tables = []
    for side, alone in ((0, 6), (1, 7)):
        listed = [(key(i), *map(float, row)) for i, p in parts.items() for row in p[side].itertuples(index=False)] + [(alone, *map(float, row)) for row in parts[0][side].itertuples(index=False)]
        columns = ", ".join(f"{c} double" for c in parts[0][side].columns)
        tables.append(spark.createDataFrame(listed, f"session_id bigint, {columns}"))
    found = filters.track(*tables, cfg).toPandas()
    assert found["session_id"].isna().sum() == len(parts[5][1]) and set(found["session_id"].dropna()) == set(range(5))
    for i, (samples, frames) in parts.items():
        one = filters.estimate_session(cfg, samples, frames)[0]
        rows = found[found["session_id"].isna() if i == 5 else found["session_id"] == i].sort_values("frame")
        assert rows["frame"].tolist() == list(range(len(one))) and rows["vision"].tolist() == [e.vision for e in one] and rows["nis_dim"].tolist() == [e.nis_dim for e in one]
        assert np.allclose(rows["t"], frames["t"]) and np.allclose(rows["loglik"], [e.loglik for e in one], rtol=1e-6)
        assert np.allclose(np.stack(rows["mean"]), [e.mean for e in one], rtol=1e-6, atol=1e-9) and np.allclose(np.stack(rows["predicted_cov"]), [e.predicted_cov.ravel() for e in one], rtol=1e-6, atol=1e-9)


def test_sessions_of_thousands_of_rows_share_their_steps():
    """They were filtered one by one from 2000 rows on; a task holds no more of them than it may."""
    def batches(sessions, rows):
        key = pa.array(np.repeat(np.arange(sessions), rows))
        return pa.RecordBatch.from_arrays([key], names=["session_id"]).slice, len(key)

    for sessions, rows, most in ((12, 3000, 1), (30, 9600, 3), (2000, 27, 3)):
        part, n = batches(sessions, rows)
        tables = [np.asarray(t.column(0)) for t in filters._gathered(part(i, 10_000) for i in range(0, n, 10_000))]
        assert (np.concatenate(tables) == np.repeat(np.arange(sessions), rows)).all() and len(tables) <= most + 1
        assert sum(len(np.unique(t)) for t in tables) == sessions and max(map(len, tables)) <= filters.MOST + 10_000
    assert filters._alike(np.array([9600] * 10)) == [(0, 10, True)]
    assert filters._alike(np.array([5, 3000, 30_000, 40_000, 7])) == [(0, 2, True), (2, 3, False), (3, 4, False), (4, 5, True)]
