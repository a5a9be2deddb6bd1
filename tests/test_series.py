"""Series: hand values, and no value may move when the future does."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from straitline import report
from straitline.config import ZONES, Zone
from straitline.functions import dist
from straitline.functions import windows as W
from straitline.operators import dynamics, forecast, series, study

D0 = dt.date(2024, 1, 1)


def daily(spark, values, zone="hormuz", start=D0):
    return spark.createDataFrame([(start + dt.timedelta(days=i), zone, None if v is None else float(v)) for i, v in enumerate(values)], "date date, zone_key string, n_transits double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_zscore_by_hand(spark):
    w = Window.partitionBy("zone_key").orderBy("date")
    z = column(daily(spark, [1, 2, 3, 4, 5]).withColumn("z", W.zscore(F.col("n_transits"), w, 3, 1)), "z")
    assert z[0] is None and abs(z[3] - 2 / math.sqrt(2 / 3)) < 1e-12
    assert column(daily(spark, [10] * 10 + [50]).withColumn("z", W.zscore(F.col("n_transits"), w, 5)), "z")[-1] is None


def test_publication_is_a_tuesday_two_to_nine_days_later(spark):
    for r in series.published(daily(spark, range(14))).collect():
        assert r.available_from.weekday() == 1 and 2 <= (r.available_from - r.date).days <= 8


def test_carried_and_aged(spark):
    df = series.carry_forward(daily(spark, [None, 10, None, None, 20, None]).drop("zone_key"), ["n_transits"])
    assert column(df, "n_transits") == [None, 10, 10, 10, 20, 20] and column(df, "n_transits_age_days") == [None, 0, 1, 2, 0, 1]


@pytest.mark.parametrize("build", [lambda d: series.baselines(d, ["n_transits"]), lambda d: series.baselines(d, ["n_transits"], sizes=(28,), yearly=False)])
def test_no_lookahead(spark, build):
    r = random.Random(3)
    values = [r.randrange(20, 50) for _ in range(400)]
    changed = values[:300] + [v + 500 for v in values[300:]]
    a, b = (build(daily(spark, v)).orderBy("date").collect() for v in (values, changed))
    assert a[:300] == b[:300] and a[301] != b[301]


def test_a_centred_window_would_be_caught(spark):
    w = Window.orderBy("date").rowsBetween(-3, 3)
    a, b = (daily(spark, v).withColumn("m", F.avg("n_transits").over(w)).orderBy("date").collect() for v in ([1] * 20, [1] * 10 + [9] * 10))
    assert a[:10] != b[:10]


def test_returns_and_targets(spark):
    p = spark.createDataFrame([(D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate([10, 11, 12, 0, 13])], "date date, p double")
    out = series.returns(p, "p", "x", (1, 2), 2).orderBy("date").collect()
    assert out[0].x_ret_1d is None and abs(out[1].x_ret_1d - math.log(1.1)) < 1e-12 and abs(out[0].x_fwd_ret_2d - math.log(1.2)) < 1e-12
    assert out[3].x_ret_1d is None and out[2].x_fwd_ret_1d is None  # no log of zero


def test_last_value_of_a_release_skips_nulls(spark):
    monday = dt.date(2024, 1, 1)
    wide, cols = series.widen(daily(spark, [5, 7, None], start=monday), "zone_key", ["hormuz", "suez"])
    row = wide.orderBy("date").first()
    assert cols == ["hormuz_n_transits", "suez_n_transits"] and row.suez_n_transits is None and row.hormuz_n_transits in (5.0, 7.0)


def test_ports_by_name_or_id(spark):
    d = spark.createDataFrame([(D0, "p1", "Al Basrah", 2.0), (D0, "p2", "Fujairah", None), (D0, "p3", "Fujairah North", 3.0)], "date date, port_id string, port_name string, n double")
    cfg = spark.createDataFrame([("a", "basrah", "gulf", None), ("b", "FUJAIRAH", "out", None), ("c", "x", "gulf", "p3"), ("d", "nowhere", "red", None)], "port_key string, match_name string, port_group string, portwatch_id string")
    found, missing = series.resolve_ports(d, cfg)
    assert {(r.port_key, r.port_id) for r in found.collect()} == {("a", "p1"), ("b", "p2"), ("b", "p3"), ("c", "p3")}
    assert [r.port_key for r in missing.collect()] == ["d"]
    with pytest.raises(KeyError, match="there are"):
        series.pick_column(["x"], ("a", "b"), "measure")


def test_distributions():
    assert abs(dist.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(dist.f_upper(4.965, 1, 10) - 0.05) < 1e-4
    assert abs(dist.normal_two_sided(1.959964) - 0.05) < 1e-6 and dist.beta_inc(2, 3, 0) == 0 and dist.beta_inc(2, 3, 1) == 1


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(11)
    a = r.normal(size=800)
    x = np.concatenate([[0.0], a[:-1]]) * 0.8 + r.normal(size=800) * 0.3
    rows = [(D0 + dt.timedelta(days=i), float(a[i]), float(0.5 * a[i] + r.normal() * 0.5), float(x[i]), 1.0) for i in range(800)]
    return spark.createDataFrame(rows, "date date, feature_a double, brent_fwd_ret_1d double, x double, flat double").cache()


def test_walk_forward(panel):
    rows = forecast.walk_forward(panel, "brent_fwd_ret_1d", ["feature_a"], forecast.Ridge, 20, 500).orderBy("date").collect()
    one = forecast.walk_forward(panel, "brent_fwd_ret_1d", ["feature_a"], forecast.Ridge, 1, 500).orderBy("date").collect()
    assert len(rows) == 300 and rows[0].n_train == 480 and one[0].n_train - rows[0].n_train == 19
    p = panel.orderBy("date").toPandas()
    y, f = p.brent_fwd_ret_1d.to_numpy(), p.feature_a.to_numpy()
    z = (f[:480] - f[:480].mean()) / f[:480].std()
    b = (z @ (y[:480] - y[:480].mean())) / (z @ z + 1)
    assert abs(rows[0].y_pred - (y[:480].mean() + b * (f[500] - f[:480].mean()) / f[:480].std())) < 1e-9
    with pytest.raises(ValueError, match="features"):
        forecast.walk_forward(panel, "x", ["brent_fwd_ret_1d"], forecast.Zero)
    with pytest.raises(ValueError, match="complete rows"):
        forecast.walk_forward(panel.limit(50), "x", ["feature_a"], forecast.Zero)


def test_scores_and_comparison(panel):
    ridge, zero = (forecast.walk_forward(panel, "brent_fwd_ret_1d", ["feature_a"], m, 1, 500) for m in (forecast.Ridge, forecast.Zero))
    s, z = forecast.scores(ridge).first(), forecast.scores(zero).first()
    assert s.rmse < z.rmse and s.directional_accuracy > 0.7 and z.directional_accuracy == 0 and s.n == 300
    a, b = forecast.diebold_mariano(ridge, zero, 3).first(), forecast.diebold_mariano(zero, ridge, 3).first()
    assert a.dm_stat < -5 and abs(a.dm_stat + b.dm_stat) < 1e-9 and forecast.dm_p_value(a.dm_stat, a.n) < 0.001
    assert forecast.diebold_mariano(zero, zero).first().dm_stat is None
    with pytest.raises(ValueError, match="loss"):
        forecast.diebold_mariano(ridge, zero, loss="cubic")
    board = forecast.compare(panel, "brent_fwd_ret_1d", ["x"], ["feature_a"], 1, 500).collect()
    assert [r.model for r in board][0] == "price_plus_ais"


def test_dynamics(panel):
    g = {(r.cause, r.lag): r.p_value for r in dynamics.granger_both(panel, "feature_a", "x", 2).collect()}
    assert g["feature_a", 1] < 1e-6 and g["x", 1] > 0.001
    lp = {r.horizon: r.beta for r in dynamics.local_projection(panel, "x", "feature_a", 2).collect()}
    assert abs(lp[1] - 0.8) < 0.1 and abs(lp[0]) < 0.15
    st = {r.column: r.verdict for r in dynamics.stationarity(panel.withColumn("walk", F.sum("feature_a").over(Window.orderBy("date"))), ["feature_a", "walk", "flat"]).collect()}
    assert st == {"feature_a": "stationary", "walk": "non_stationary", "flat": "constant"}
    best = dynamics.var_lags(panel, ["feature_a", "x"], 4).orderBy("aic").first()
    assert best.lag >= 1


def test_event_study_skips_the_ends(spark, panel):
    events = spark.createDataFrame([(D0 + dt.timedelta(days=d), f"e{d}", "c") for d in (10, 300, 795)], "date date, event string, category string")
    rows = study.per_event(panel, events, "feature_a")
    assert {r.event for r in rows.collect()} == {"e300"} and rows.count() == 26
    avg = study.with_p(study.average(rows)).collect()
    assert len(avg) == 26 and all(r.n_events == 1 and r.p_value is None for r in avg)
    assert set(study.by_regime(events, "2024-06-01")) == {"before", "after"}


def test_report(spark, panel):
    assert "_Not available" in report.section("x", lambda: 1 / 0)
    assert report.markdown(spark.range(3).toDF("id"), 2).count("\n") == 4
    cov = report.coverage(panel, ["x", "flat"]).collect()
    assert [c.n for c in cov] == [800, 800]


def test_zone_validation():
    with pytest.raises(ValueError, match="lon/lat"):
        Zone("z", "z", "c", ((0.0, 95.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0)), "a", "b", False)
    with pytest.raises(ValueError, match="outside"):
        Zone("z", "z", "c", ((50.0, 50.0), (51.0, 51.0)), ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0)), "a", "b", False)
    assert ZONES["hormuz"].feed_box == [[25.6, 55.6], [27.2, 57.3]]
