"""Walk-forward forecasts with an embargo, their scores, and the Diebold-Mariano test."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from straitline.functions.dist import t_two_sided
from straitline.operators import panel
from straitline.session import written


class Moments(NamedTuple):
    """What linear models need of training rows: their number, means, and sums of products around the means."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray


class Estimator(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray) -> Estimator: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


class Linear:
    """An estimator whose intercept and slopes come from moments; it can be fitted to arrays as well."""

    def solve(self, m: Moments) -> tuple[float, np.ndarray]:
        raise NotImplementedError

    def fit(self, x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        at = x.mean(0)
        self.a, self.b = self.solve(Moments(len(y), at, float(y.mean()), (x - at).T @ (x - at), (x - at).T @ (y - y.mean())))
        return self

    def predict(self, x):
        return self.a + np.asarray(x, float) @ self.b


class Zero(Linear):
    def solve(self, m):
        return 0.0, np.zeros(len(m.x))


class Mean(Linear):
    def solve(self, m):
        return m.y, np.zeros(len(m.x))


class Ridge(Linear):
    """Features standardised on the training rows (population deviation), unpenalised intercept."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def solve(self, m):
        var = np.diag(m.xx) / m.n
        sd = np.sqrt(np.where(var > 1e-24 * np.maximum(m.x**2, 1e-300), var, 1.0))  # a constant feature is left as it is
        b = np.linalg.solve(m.xx / np.outer(sd, sd) + self.alpha * np.eye(len(sd)), m.xy / sd) / sd
        return float(m.y - b @ m.x), b


def walk_forward(frame: DataFrame, target: str, features: list[str], model: Callable[[], Estimator], horizon: int = 1, min_train: int = 500, refit: int = 21) -> DataFrame:
    """Expanding window over complete rows; training ends ``horizon`` rows before the forecast; refit every ``refit`` rows.

    date, y_true, y_pred, error, n_train, n_train_fit. Rows are numbered (``panel.indexed``) and summed by the fold whose
    training they enter first; running totals of these sums, a row a refit, are each fold's training moments. Folds are
    solved where they lie and joined to the rows that they predict. An estimator without ``solve`` gets its folds as groups,
    each with its training rows.
    """
    leaks = [f for f in features if "fwd_" in f]
    if leaks:
        raise ValueError(f"targets can't be features: {leaks}")
    rows = frame.select("date", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)]).dropna()
    xs = [f"_x{j}" for j in range(len(features))]
    rows = written(panel.indexed(rows), "panel")
    n, mean = panel.means(rows, ["_y", *xs])
    if n <= min_train + horizon:
        raise ValueError(f"{n} complete rows; more than {min_train} + {horizon} are needed")
    first = max(min_train, horizon + min_train // 2)
    start = first - horizon
    if start < 1:
        raise ValueError("min_train has to leave a row to train on")
    entered = F.when(F.col("_i") < start, F.lit(0)).otherwise(F.floor((F.col("_i") - start) / refit) + 1).cast("long")
    asked = rows.where(F.col("_i") >= first).withColumn("_f", F.floor((F.col("_i") - first) / refit).cast("long"))
    out = ["date", F.col("_y").alias("y_true"), "y_pred", (F.col("_y") - F.col("y_pred")).alias("error"), (F.col("_i") - horizon).cast("long").alias("n_train"), (start + refit * F.col("_f")).cast("long").alias("n_train_fit")]
    if not hasattr(model(), "solve"):
        return _fitted(rows, asked, xs, model, start, refit, -(-(n - first) // refit)).select(*out)
    terms = [F.lit(1.0), *[F.col(c) - m for c, m in zip(["_y", *xs], mean)]]
    sums = panel.products(terms)
    block = rows.groupBy(entered.alias("_f")).agg(*[s.alias(f"_s{k}") for k, s in enumerate(sums)])
    upto = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, 0)
    folds = block.select("_f", F.array(*[F.sum(f"_s{k}").over(upto) for k in range(len(sums))]).alias("_m"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.array(mean)
        for pdf in batches:
            found = []
            for sums in pdf["_m"]:
                m = panel.square(sums, len(at) + 1)
                c = m[0, 1:] / m[0, 0]
                around = m[1:, 1:] - m[0, 0] * np.outer(c, c)
                a, b = model().solve(Moments(m[0, 0], at[1:] + c[1:], at[0] + c[0], around[1:, 1:], around[1:, 0]))
                found.append((float(a), [float(v) for v in b]))
            yield pd.DataFrame({"_f": pdf["_f"], "_a": [a for a, _ in found], "_c": [b for _, b in found]})

    solved = folds.mapInPandas(solve, "_f long, _a double, _c array<double>")
    predicted = sum((F.col("_c")[j] * F.col(c) for j, c in enumerate(xs)), F.col("_a"))
    return asked.join(solved, "_f").withColumn("y_pred", predicted).select(*out)


def _fitted(rows: DataFrame, asked: DataFrame, xs: list[str], model: Callable[[], Estimator], start: int, refit: int, folds: int) -> DataFrame:
    """Predictions of an estimator that wants arrays: each fold is a group of its training rows and of those it predicts."""
    enters = F.greatest(F.lit(0), F.floor((F.col("_i") - start) / refit) + 1)
    train = rows.where(enters < folds).withColumn("_f", F.explode(F.sequence(enters.cast("long"), F.lit(folds - 1).cast("long")))).withColumn("_ask", F.lit(False))
    kinds = "date date, _y double, _i long, _f long, y_pred double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        past, new = pdf[~pdf["_ask"]], pdf[pdf["_ask"]]
        fitted = model().fit(past[xs].to_numpy(float), past["_y"].to_numpy(float))
        return new[["date", "_y", "_i", "_f"]].assign(y_pred=np.asarray(fitted.predict(new[xs].to_numpy(float)), float))

    return train.unionByName(asked.withColumn("_ask", F.lit(True))).groupBy("_f").applyInPandas(run, kinds)


def scores(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rmse, mae, directional_accuracy (non-zero truths), majority_baseline, n."""
    moved = F.when(F.col("y_true") != 0, F.col("y_true"))
    hit = F.when(moved.isNotNull(), (F.signum("y_pred") == F.signum("y_true")).cast("double"))
    up = F.avg(F.when(moved.isNotNull(), (moved > 0).cast("double")))
    return predictions.groupBy(*(by or [])).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.abs("error")).alias("mae"), F.avg(hit).alias("directional_accuracy"), F.greatest(up, 1 - up).alias("majority_baseline"), F.count(F.lit(1)).alias("n"))


def diebold_mariano(model: DataFrame, benchmark: DataFrame, horizon: int = 1, loss: str = "squared", harvey: bool = True) -> DataFrame:
    """dm_stat, mean_loss_differential, n over common dates; Bartlett long-run variance of horizon - 1 lags; nulls if undefined."""
    if loss not in ("squared", "absolute"):
        raise ValueError(f"unknown loss {loss!r}")
    l = (lambda c: F.col(c) * F.col(c)) if loss == "squared" else (lambda c: F.abs(F.col(c)))  # noqa: E741, E731
    d = model.select("date", F.col("error").alias("_e1")).join(benchmark.select("date", F.col("error").alias("_e0")), "date")
    d = d.withColumn("d", l("_e1") - l("_e0")).where(F.abs("d") < float("inf"))  # neither null, NaN nor infinite
    whole, w = Window.partitionBy(), Window.orderBy("date")
    d = d.withColumn("_c", F.col("d") - F.avg("d").over(whole))
    d = d.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(horizon)})
    n = F.count(F.lit(1))
    s = d.agg(n.alias("n"), F.avg("d").alias("mean_loss_differential"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(horizon)])
    lrv = F.col("_s0") / F.col("n")
    for k in range(1, horizon):
        lrv = lrv + F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) * (2 * (1 - k / horizon)) / F.col("n")
    stat = F.when((F.col("n") >= 10) & (lrv > 0), F.col("mean_loss_differential") / F.sqrt(lrv / F.col("n")))
    if harvey:
        stat = stat * F.sqrt((F.col("n") + 1 - 2 * horizon + horizon * (horizon - 1) / F.col("n")) / F.col("n"))
    return s.select(stat.alias("dm_stat"), F.when(F.col("n") >= 10, F.col("mean_loss_differential")).alias("mean_loss_differential"), "n")


def dm_p_value(stat: float | None, n: int) -> float | None:
    return None if stat is None else t_two_sided(stat, n - 1)


def ladder(frame: DataFrame, target: str, price_features: list[str], ais_features: list[str], horizon: int = 1, min_train: int = 500, model: Callable[[], Estimator] = Ridge) -> DataFrame:
    """Predictions of zero, mean, price and price + AIS models (column ``model``) on their common dates."""
    steps = {"zero": (Zero, price_features), "mean": (Mean, price_features), "price_only": (model, price_features), "price_plus_ais": (model, [*price_features, *ais_features])}
    frame = written(frame.select("date", target, *dict.fromkeys([*price_features, *ais_features])), "panel")
    every = None
    for k, (m, f) in steps.items():
        run = walk_forward(frame, target, f, m, horizon, min_train).withColumn("model", F.lit(k))
        every = run if every is None else every.unionByName(run)
    every = written(every, "forecasts")
    common = every.groupBy("date").count().where(F.col("count") == len(steps)).select("date")
    return every.join(common, "date", "left_semi")


def compare(frame: DataFrame, target: str, price_features: list[str], ais_features: list[str], horizon: int = 1, min_train: int = 500, model: Callable[[], Estimator] = Ridge) -> DataFrame:
    """Scoreboard of the ladder, best first."""
    return scores(ladder(frame, target, price_features, ais_features, horizon, min_train, model), ["model"]).orderBy("rmse")


#: Families of targets, by the name of their column at a horizon.
FAMILIES = {"Direction": "brent_fwd_ret_{h}d", "Volatility": "brent_fwd_rv_{h}d", "Brent-WTI spread": "brent_wti_spread_fwd_chg_{h}d"}


def verdicts(frame: DataFrame, price_features: list[str], ais_features: list[str], horizons: tuple[int, ...] = (1, 5, 20), min_train: int = 500, model: Callable[[], Estimator] = Ridge, level: float = 0.05) -> DataFrame:
    """family, horizon, dm_stat, p_value, n, verdict of price + AIS against price alone, for the targets that are there.

    A significant negative statistic is ``improves``, a positive one ``worsens``; a target with too few rows is ``undecided``.
    """
    out = []
    for family, name in FAMILIES.items():
        for h in horizons:
            target = name.format(h=h)
            if target not in frame.columns:
                continue
            try:
                runs = ladder(frame, target, price_features, ais_features, h, min_train, model)
            except ValueError:  # not enough complete rows
                out.append((family, h, None, None, 0, "undecided"))
                continue
            r = diebold_mariano(runs.where("model = 'price_plus_ais'"), runs.where("model = 'price_only'"), h).first()
            p = dm_p_value(r["dm_stat"], r["n"])
            word = "undecided" if p is None else "no difference" if p >= level else "improves" if r["dm_stat"] < 0 else "worsens"
            out.append((family, h, r["dm_stat"], p, r["n"], word))
    return frame.sparkSession.createDataFrame(out, "family string, horizon int, dm_stat double, p_value double, n long, verdict string")
