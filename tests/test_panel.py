"""Panels without a task that holds them: numbering, block edges, and every model against its plain numpy form."""

import datetime as dt
import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from straitline.operators import dynamics, forecast, panel

D0 = dt.date(2014, 11, 3)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    n = 700
    a, b = np.zeros(n), np.zeros(n)
    for t in range(1, n):
        a[t] = 0.4 * a[t - 1] + r.normal()
        b[t] = 0.3 * b[t - 1] + 0.5 * a[t - 1] + r.normal()
    df = pd.DataFrame({"date": [D0 + dt.timedelta(days=3 * i) for i in range(n)], "a": a + 50, "b": b - 7, "walk": np.cumsum(b), "y": 0.7 * a + r.normal(size=n), "flat": 2.0})
    for c, at in (("a", (3, 90, 91)), ("b", (91, 500)), ("y", (10,))):
        df.loc[list(at), c] = np.nan
    return df


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data.sample(frac=1, random_state=1)).repartition(5).cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(panel, "BLOCK", 37)


def ols(x, y):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, y - x @ b


def test_numbers_and_neighbours_across_years_and_blocks(spark, data):
    rows = [(g, D0 + dt.timedelta(days=11 * i), i, float(i * i % 17)) for g, n in (("p", 300), ("q", 75), ("r", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, date date, want int, v double").repartition(7)
    got = panel.indexed(df, ["g"])
    assert got.where("_i <> want").isEmpty() and got.count() == len(rows)
    out = panel.lagged(got, ["v"], 5, [1, 20], ["g"]).collect()
    assert len(out) == len(rows)
    size = {"p": 300, "q": 75, "r": 1}
    for r in out:
        at = lambda i: float(i * i % 17) if 0 <= i < size[r.g] else None
        assert [r.v_lag1, r.v_lag5, r.v_lead1, r.v_lead20] == [at(r.want + k) for k in (-1, -5, 1, 20)]
    with pytest.raises(ValueError, match="edge"):
        panel.lagged(got, ["v"], 38)


def folds(data, xs, fit, horizon, min_train, refit):
    d = data[["date", "y", *xs]].dropna().reset_index(drop=True)
    x, y, out, last = d[xs].to_numpy(), d["y"].to_numpy(), [], None
    for i in range(min_train, len(d)):
        end = i - horizon
        if end < min_train // 2:
            continue
        if last is None or i - last >= refit:
            predict, last, n = fit(x[:end], y[:end]), i, end
        out.append((d["date"][i], y[i], predict(x[i]), end, n))
    return out


def ridge(x, y):
    at, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = (x - at) / sd
    b = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda v: y.mean() + ((v - at) / sd) @ b


class Median:
    """An estimator that knows arrays only."""

    def fit(self, x, y):
        self.m = float(np.median(y))
        return self

    def predict(self, x):
        return np.full(len(x), self.m)


@pytest.mark.parametrize(("model", "plain", "horizon", "least", "refit"), [(forecast.Ridge, ridge, 5, 200, 21), (forecast.Ridge, ridge, 150, 60, 7), (forecast.Mean, lambda x, y: lambda v: y.mean(), 1, 300, 50), (forecast.Zero, lambda x, y: lambda v: 0.0, 20, 100, 21), (Median, lambda x, y: lambda v: np.median(y), 5, 300, 21)])
def test_walk_forward_equals_the_loop(frame, data, model, plain, horizon, least, refit):
    want = folds(data, ["a", "b", "flat"], plain, horizon, least, refit)
    got = forecast.walk_forward(frame, "y", ["a", "b", "flat"], model, horizon, least, refit).orderBy("date").collect()
    assert [(r.date, r.n_train, r.n_train_fit) for r in got] == [(w[0], w[3], w[4]) for w in want]
    assert np.allclose([r.y_pred for r in got], [w[2] for w in want], atol=1e-9) and np.allclose([r.error for r in got], [w[1] - w[2] for w in want], atol=1e-9)


def test_no_panel_on_the_driver():
    for module in (forecast, dynamics, panel):
        assert "toPandas" not in inspect.getsource(module) and "applyInPandas" not in inspect.getsource(dynamics)


def test_estimators_on_arrays():
    x, y = np.array([[1.0, 5], [2, 4], [4, 9]]), np.array([1.0, 3, 2])
    assert np.allclose(forecast.Ridge().fit(x, y).predict(x), [ridge(x, y)(v) for v in x])


def test_granger_against_least_squares(frame, data):
    d = data[["a", "b"]].dropna()
    got = {(r.cause, r.lag): r for r in dynamics.granger_both(frame, "a", "b", 4).collect()}
    assert len(got) == 8
    for (cause, lag), r in got.items():
        y, x = d[r.effect].to_numpy(), d[cause].to_numpy()
        past = lambda v: np.column_stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)])
        one = np.ones((len(y) - lag, 1))
        r0, r1 = ols(np.hstack([one, past(y)]), y[lag:])[1], ols(np.hstack([one, past(y), past(x)]), y[lag:])[1]
        df = len(y) - lag - 2 * lag - 1
        assert r.n_obs == len(y) - lag and math.isclose(r.f_stat, (r0 @ r0 - r1 @ r1) / lag / (r1 @ r1 / df), rel_tol=1e-6)
    assert got["a", 1].p_value < 1e-9 < got["b", 1].p_value


def test_granger_of_few_rows_skips_lags(frame):
    assert {r.lag for r in dynamics.granger_both(frame.orderBy("date").limit(9), "a", "b", 5).collect()} == {1, 2}


def test_local_projection_against_least_squares(frame, data):
    d = data.reset_index(drop=True)
    got = dynamics.local_projection(frame, "y", "a", 6, 2, ("b",)).collect()
    assert [r.horizon for r in got] == list(range(7))
    for r in got:
        h = r.horizon
        s = pd.DataFrame({"t": d["y"].shift(-h), "s": d["a"], "y1": d["y"].shift(1), "a1": d["a"].shift(1), "y2": d["y"].shift(2), "a2": d["a"].shift(2), "b": d["b"]}).dropna()
        x = np.column_stack([np.ones(len(s)), s.iloc[:, 1:].to_numpy()])
        b, e = ols(x, s["t"].to_numpy())
        u, inv = x * e[:, None], np.linalg.inv(x.T @ x)
        m = u.T @ u
        for k in range(1, h + 2):
            g = u[k:].T @ u[:-k]
            m += (1 - k / (h + 2)) * (g + g.T)
        se = math.sqrt((inv @ m @ inv)[1, 1])
        assert r.n_obs == len(s) and math.isclose(r.beta, b[1], rel_tol=1e-7) and math.isclose(r.std_err, se, rel_tol=1e-7) and math.isclose(r.t_stat, b[1] / se, rel_tol=1e-7)
    assert dynamics.local_projection(frame.limit(20), "y", "a", 3).count() == 0


def test_var_against_least_squares(frame, data):
    v = data[["a", "b"]].dropna().to_numpy()

    def fit(p, start):
        y = v[start:]
        x = np.column_stack([np.ones(len(y)), *[v[start - j : len(v) - j] for j in range(1, p + 1)]])
        b, e = ols(x, y)
        return b, np.linalg.slogdet(e.T @ e / len(y))[1]

    n = len(v) - 6
    for r in dynamics.var_lags(frame, ["a", "b"], 6).collect():
        det = fit(r.lag, 6)[1]
        free = 4 * r.lag + 2
        assert r.n_obs == n and math.isclose(r.aic, det + 2 * free / n, abs_tol=1e-8) and math.isclose(r.bic, det + math.log(n) * free / n, abs_tol=1e-8)
    for lag in (1, 3, None):
        got = dynamics.var_model(frame, ["a", "b"], 6, lag).collect()
        p = (len(got) // 2 - 1) // 2
        b = fit(p, p)[0]
        assert p == (lag or 1) and np.allclose([r.coef for r in got], b.T.ravel(), atol=1e-7) and [r.term for r in got][:3] == ["const", "L1.a", "L1.b"]
    with pytest.raises(ValueError, match="too few"):
        dynamics.var_lags(frame.limit(5), ["a", "b"])


def plain_adf(v):
    n, d = len(v), np.diff(v)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)

    def fit(k, start):
        y = d[start:]
        x = np.column_stack([np.ones(len(y)), v[start:-1], *[d[start - j : len(d) - j] for j in range(1, k + 1)]])
        b, e = ols(x, y)
        return b[1] / math.sqrt(e @ e / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), len(y) * np.log(e @ e / len(y)) + 2 * x.shape[1]

    k = min(range(top + 1), key=lambda j: fit(j, top)[1])
    return fit(k, k)[0]


def plain_kpss(v):
    n, e = len(v), v - v.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cov + 1):
        c = 2 * (e[i:] @ e[:-i]) / n
        s0, s1 = s0 + c, s1 + i * c
    lags = int(min(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3), n - 1))
    lrv = e @ e / n + sum(2 * (1 - i / (lags + 1)) * (e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / lrv


def test_stationarity_against_plain_forms(frame, data):
    got = {r.column: r for r in dynamics.stationarity(frame, ["a", "walk", "flat"]).collect()}
    for c in ("a", "walk"):
        v = data[c].dropna().to_numpy()
        assert got[c].n_obs == len(v) and math.isclose(got[c].adf_stat, plain_adf(v), rel_tol=1e-6) and math.isclose(got[c].kpss_stat, plain_kpss(v), rel_tol=1e-7)
    assert [got[c].verdict for c in ("a", "walk", "flat")] == ["stationary", "non_stationary", "constant"]
    assert dynamics.stationarity(frame.limit(15), ["a"]).count() == 0


def test_dickey_fuller_p_values_at_published_quantiles():
    for stat, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert abs(dynamics.adf_p(stat) - p) < 6e-4
    grid = [dynamics.adf_p(x) for x in np.arange(-19, 3, 0.05)]
    assert grid[0] == 0.0 and grid[-1] == 1.0 and all(b >= a - 1e-3 for a, b in zip(grid, grid[1:])) and dynamics.adf_p(-6.0) < 1e-6


def test_infinite_errors_leave_the_comparison(spark):
    rows = lambda k: spark.createDataFrame([(D0 + dt.timedelta(days=i), float("inf") if i == 3 else float("nan") if i == 4 else k * math.sin(i * i)) for i in range(40)], "date date, error double")
    r = forecast.diebold_mariano(rows(1.0), rows(2.0)).first()
    assert r.n == 38 and r.dm_stat < 0 and math.isfinite(r.mean_loss_differential)


def test_verdicts_name_what_the_extra_features_do(spark):
    r = np.random.default_rng(9)
    n = 420
    price, flow = r.normal(size=n), r.normal(size=n)
    rows = [(D0 + dt.timedelta(days=i), float(price[i]), float(flow[i]), float(0.2 * price[i] + 0.9 * flow[i] + 0.1 * r.normal()), float(r.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, p double, f double, brent_fwd_ret_1d double, brent_fwd_rv_5d double")
    got = {(x.family, x.horizon): x for x in forecast.verdicts(df, ["p"], ["f"], (1, 5), 300).collect()}
    assert set(got) == {("Direction", 1), ("Volatility", 5)} and got["Direction", 1].verdict == "improves" and got["Direction", 1].dm_stat < 0
    assert got["Volatility", 5].verdict in ("no difference", "worsens") and got["Volatility", 5].n == 120
    few = forecast.verdicts(df.limit(50), ["p"], ["f"], (1,), 300).collect()
    assert [(x.family, x.verdict, x.dm_stat) for x in few] == [("Direction", "undecided", None)]
    board = forecast.compare(df, "brent_fwd_ret_1d", ["p"], ["f"], 1, 300).collect()
    assert [b.model for b in board][0] == "price_plus_ais" and {b.n for b in board} == {120}
