"""Every query against its SQL; queries without SQL give rows and keep their schema."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.compare import duck, rows
from tests.conftest import SMALL
from tidemark.plans.queries import ORACLE, QUERIES
from tidemark.sources import events as ev


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLE:
        assert len(found)
        return
    expected = con.execute(ORACLE[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


FILTERS = ["ekf_2d_full", "ekf_3d_imu", "ekf_vision_only", "ekf_quaternion", "ukf_2d_full", "rts_smoother_2d", "sigma_point_smoother_2d", "ekf_3d"]


@pytest.mark.parametrize("name", [*FILTERS, "orientation_filter"])
def test_filters_run_on_all_sessions_of_events(spark, con, name):
    """A row a frame (orientation: a sample) of every session that has frames and two samples, all finite."""
    kind, frames = ("click", 0) if name == "orientation_filter" else ("view", 1)
    expected = con.execute(f"SELECT user_id, count(*) FILTER (event_type = '{kind}') FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') >= 2 AND count(*) FILTER (event_type = 'view') >= {frames}").fetchall()
    found = QUERIES[name](spark, SMALL).toPandas()
    assert found.groupby("session_id").size().to_dict() == dict(expected)
    assert found.notna().all().all() and np.isfinite(found.select_dtypes("number")).all().all()


#: Microseconds, type, value and k of a session with gaps of days, after which the velocity's variance makes the points' jitter more than one LED leaves.
GAPS = [
    (93822255043, "view", 43.61, 30), (96722639466, "click", 8.7, 74), (131982007215, "click", 47.45, 13), (225339600433, "view", 7.87, 92), (251293167860, "view", 65.68, 89), (389328630763, "click", 12.27, 37),
    (406083395278, "click", 227.3, 53), (616570357543, "view", 51.92, 78), (675739331451, "click", 0.66, 59), (758010506374, "click", 219.93, 86), (777146756559, "view", 8.68, 91), (797325855404, "click", 23.34, 14),
    (1075367598323, "view", 32.4, 44), (1331534893795, "view", 12.76, 69), (1401557822669, "view", 28.52, 5), (1746329877537, "view", 65.5, 84), (1890043027022, "click", 14.02, 11), (2040777588541, "click", 8.33, 74),
    (2040832620638, "view", 8.75, 13), (2049624913650, "view", 101.5, 80), (2162478040782, "view", 2.74, 19), (2269614279963, "view", 6.29, 35), (2295569465076, "view", 158.8, 45), (2364550999442, "view", 6.2, 34),
]


def write_events(folder, listed: list[tuple]) -> str:
    """events of (user, microseconds, type, value, k) as a folder."""
    user, us, kind, value, k = zip(*listed, strict=True)
    table = pd.DataFrame({"event_id": range(len(us)), "ts": pd.to_datetime(np.array(us) + ev.EPOCH_US, unit="us").astype("datetime64[us]"), "user_id": user, "event_type": kind, "value": np.array(value, float), "props": [f'{{"k": {i}}}' for i in k]})
    table.to_parquet(folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["ukf_2d_full", "sigma_point_smoother_2d"])
def test_unscented_filters_survive_gaps(spark, tmp_path, name):
    """One measurement under the points' jitter left a negative variance, and the query ended with 'not positive definite'."""
    found = QUERIES[name](spark, write_events(tmp_path, [(7, *row) for row in GAPS])).toPandas()
    assert len(found) == 15 and found.notna().all().all() and np.isfinite(found.select_dtypes("number")).all().all()


#: The same of a session over years; a heading update over a variance of 1e132 cancels to a negative one.
YEARS = [
    (8896305637343, "view", 53.59, 37), (8963007728380, "click", 81.55, 15), (9398708428638, "view", 105.87, 47), (10574692653582, "view", 41.65, 12), (11885947260029, "click", 7.31, 52), (12460854258852, "click", 24.32, 45),
    (52657700860375, "click", 40.8, 3), (52697263776330, "click", 265.71, 4), (52857980840986, "view", 32.0, 75), (53164198230520, "view", 12.97, 10), (54739128834440, "view", 42.09, 90), (55204387932015, "click", 26.93, 55),
    (55462129792287, "click", 23.12, 33), (55509778521201, "click", 153.77, 91), (56557260320859, "view", 10.04, 94), (57465142613892, "click", 23.75, 19), (57842006544772, "click", 36.86, 49), (57974500492126, "click", 49.21, 23),
    (58826954602982, "view", 59.94, 81), (58851957873504, "view", 59.24, 96), (59367223110251, "click", 24.77, 32), (60659999224552, "view", 7.03, 66), (60785990259131, "view", 15.36, 92), (76847793264912, "click", 21.9, 45),
    (78138667126287, "click", 98.94, 55), (116355465049278, "click", 3.6, 3), (118150779987309, "click", 47.02, 76), (119295774443292, "click", 66.97, 15), (142975827565734, "click", 8.3, 39), (145146139946074, "click", 13.13, 22),
    (145859721548746, "click", 22.6, 9), (145885860534236, "click", 7.05, 93), (145958518387789, "click", 4.3, 80), (148232395056089, "view", 104.14, 76), (149717788572961, "click", 6.82, 83), (150306077562977, "view", 31.11, 4),
    (151609854985510, "view", 31.07, 4), (151642301212144, "view", 34.84, 86), (152153298981503, "view", 7.1, 81), (152219194987046, "view", 200.0, 50), (153557984652500, "click", 27.41, 60),
]


@pytest.mark.parametrize("name", ["ukf_2d_full", "sigma_point_smoother_2d"])
def test_unscented_filters_survive_years(spark, tmp_path, name):
    """One such session ended the query, for all others too, with 'not positive definite'."""
    found = QUERIES[name](spark, write_events(tmp_path, [(7, *row) for row in YEARS] + [(8, *row) for row in GAPS])).toPandas()
    assert found.groupby("session_id").size().to_dict() == {7: 17, 8: 15}
    assert found.notna().all().all() and np.isfinite(found[["x", "y", "heading"]]).all().all() and np.isfinite(found.loc[found["session_id"] == 8, "loglik"]).all()


def test_gravity_axis_ties_are_decided_as_in_the_sql(spark, tmp_path):
    """The first and the third mean are equal but for rounding, which depends on the order of the values; the rows' order in the table mustn't."""
    listed = [(7, i * 10**9, "click", v, k) for i, (v, k) in enumerate([(13.12, 71), (12.34, 30), (30.77, 45), (17.11, 54)])]
    folder = write_events(tmp_path, listed)
    expected = duckdb.sql(ORACLE["gravity_axis_top1"].replace("FROM events", f"FROM '{folder}/events.parquet'")).df()
    pd.read_parquet(f"{folder}/events.parquet")[::-1].to_parquet(f"{folder}/events.parquet")
    assert rows(QUERIES["gravity_axis_top1"](spark, folder).toPandas()) == rows(expected)
