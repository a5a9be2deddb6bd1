"""Time-series estimators from moments: VAR, Granger, local projections, ADF and KPSS.

A panel gives its sums of products of current and lagged values in one distributed aggregation (``operators.panel``). All
models of a family, whatever their lag, are solved from that matrix; only corrections for autocorrelation read the rows
again, as products of a scalar with its lags. No task and not the driver holds a column of the panel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from straitline.functions.dist import f_upper, normal_two_sided
from straitline.operators import panel
from straitline.session import written


def _complete(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.select("date", *[F.col(c).cast("double").alias(c) for c in columns]).dropna()


class LagMoments:
    """Sums of products of 1 and the values 0 to ``lags`` rows back of some columns, around their means.

    Rows that lack the oldest lags have keys of their own, so ``since(k)`` is the matrix over all rows that have k lags.
    """

    def __init__(self, frame: DataFrame, columns: Sequence[str], lags: int):
        self.columns, self.lags = list(columns), lags
        rows = written(panel.indexed(_complete(frame, columns)), "panel")
        self.n, self.means = panel.means(rows, columns)
        around = panel.lagged(rows.select("_i", *[(F.col(c) - m).alias(c) for c, m in zip(columns, self.means)]), columns, lags)
        terms = [F.col(c if k == 0 else f"{c}_lag{k}") for k in range(lags + 1) for c in columns]
        self.parts = panel.moments(around, terms, F.least("_i", F.lit(lags)).cast("int"))

    def at(self, column: str, lag: int) -> int:
        return 1 + lag * len(self.columns) + self.columns.index(column)

    def since(self, start: int) -> np.ndarray:
        return sum((m for k, m in self.parts.items() if k >= start), np.zeros((1 + (self.lags + 1) * len(self.columns),) * 2))


# ---- Granger


def granger_both(frame: DataFrame, a: str, b: str, max_lag: int = 5) -> DataFrame:
    """cause, effect, lag, f_stat, p_value, n_obs for both directions and each lag that the rows allow."""
    m, out = LagMoments(frame, [a, b], max_lag), []
    for cause, effect in ((a, b), (b, a)):
        for lag in range(1, max_lag + 1):
            if m.n <= 3 * lag + 1:
                continue
            s = m.since(lag)
            own, other = [m.at(effect, k) for k in range(1, lag + 1)], [m.at(cause, k) for k in range(1, lag + 1)]
            r0, r1 = panel.solve(s, [0, *own], m.at(effect, 0))[1], panel.solve(s, [0, *own, *other], m.at(effect, 0))[1]
            n = int(s[0, 0])
            df = n - 2 * lag - 1
            f = ((r0 - r1) / lag) / (r1 / df) if r1 > 0 else math.nan
            out.append((cause, effect, lag, float(f), f_upper(float(f), lag, df) if f == f else math.nan, n))
    return frame.sparkSession.createDataFrame(out, "cause string, effect string, lag int, f_stat double, p_value double, n_obs long")


def feedback(granger_rows: DataFrame, level: float = 0.05) -> DataFrame:
    """Lags at which both directions are significant."""
    return granger_rows.where(F.col("p_value") < level).groupBy("lag").agg(F.countDistinct("cause").alias("n")).where("n > 1").select("lag")


# ---- local projections


def local_projection(frame: DataFrame, outcome: str, shock: str, horizons: int = 20, lags: int = 2, controls: tuple[str, ...] = ()) -> DataFrame:
    """horizon, beta, std_err, t_stat, p_value, ci_low, ci_high, n_obs; Newey-West of horizon + 1 lags; under 30 rows skip.

    One row is dealt to each horizon that it is complete for; a horizon's moments, and then the products of its score with
    the scores before, are sums by horizon. The score of a row is its residual times its weight in the shock's coefficient.
    """
    spark, columns = frame.sparkSession, list(dict.fromkeys([outcome, shock, *controls]))
    rows = frame.select("date", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    rows = written(panel.indexed(rows), "panel")
    _, mean = panel.means(rows, columns)
    rows = rows.select("date", "_i", *[(F.col(c) - m).alias(c) for c, m in zip(columns, mean)])
    wide = panel.lagged(rows, [outcome, shock], lags, range(1, horizons + 1))
    x = [shock, *[f"{c}_lag{k}" for k in range(1, lags + 1) for c in (outcome, shock)], *controls]
    y = F.array(F.col(outcome), *[F.col(f"{outcome}_lead{h}") for h in range(1, horizons + 1)])
    long = written(wide.where(F.forall(F.array(*x), lambda v: v.isNotNull())).select("date", F.posexplode(y).alias("_h", "_y"), *[F.col(c).alias(f"_x{j}") for j, c in enumerate(x)]).where("_y is not null"), "panel-horizons")
    terms = [F.col(f"_x{j}") for j in range(len(x))]
    fits = {}
    for h, m in panel.moments(long, [*terms, F.col("_y")], F.col("_h")).items():
        if m[0, 0] >= 30:
            b, _, inv = panel.solve(m, range(len(x) + 1), len(x) + 1)
            fits[h] = (int(m[0, 0]), float(b[1]), b, inv[1])
    schema = "horizon int, beta double, std_err double, t_stat double, p_value double, ci_low double, ci_high double, n_obs long"
    if not fits:
        return spark.createDataFrame([], schema)
    solved = F.broadcast(spark.createDataFrame([(h, b.tolist(), w.tolist()) for h, (_, _, b, w) in fits.items()], "_h int, _c array<double>, _w array<double>"))  # a row a horizon
    ones = [F.lit(1.0), *terms]
    dot = lambda v: sum((F.col(v)[j] * t for j, t in enumerate(ones[1:], 1)), F.col(v)[0])
    scored = panel.indexed(long.join(solved, "_h").select("_h", "date", ((F.col("_y") - dot("_c")) * dot("_w")).alias("_v")), ["_h"])
    parts, w, own = panel.blocked(scored, horizons + 1, 0, ["_h"])
    lead = parts.withColumns({f"_v{k}": F.col("_v") * F.lag("_v", k).over(w) for k in range(1, horizons + 2)}).where(own)
    sums = {r[0]: r[1:] for r in lead.groupBy("_h").agg(F.sum(F.col("_v") * F.col("_v")), *[F.sum(f"_v{k}") for k in range(1, horizons + 2)]).collect()}
    out = []
    for h, (n, beta, _, _) in sorted(fits.items()):
        s = sums[h]
        se = math.sqrt(max(s[0] + sum(2 * (1 - k / (h + 2)) * (s[k] or 0.0) for k in range(1, h + 2)), 0.0))
        t = beta / se if se > 0 else math.nan
        out.append((h, beta, se, t, normal_two_sided(t), beta - 1.96 * se, beta + 1.96 * se, n))
    return spark.createDataFrame(out, schema)


# ---- VAR


def _orders(m: LagMoments) -> list[tuple[int, float, float, int]]:
    k, n_all = len(m.columns), m.n
    if n_all < 3 * (k + 1):
        raise ValueError(f"{n_all} complete rows of {m.columns} are too few for a VAR")
    top = min(m.lags, max(1, n_all // (k + 1) - 1))
    s, out = m.since(top), []
    for p in range(1, top + 1):
        _, e = _var(m, s, p)
        n, det, free = int(s[0, 0]), float(np.linalg.slogdet(e / s[0, 0])[1]), p * k * k + k
        out.append((p, det + 2 * free / n, det + math.log(n) * free / n, n))
    return out


def _var(m: LagMoments, s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (terms by equations) and sums of products of the residuals of the VAR of order ``p``."""
    x, y = [0, *[m.at(c, j) for j in range(1, p + 1) for c in m.columns]], [m.at(c, 0) for c in m.columns]
    b = np.linalg.pinv(s[np.ix_(x, x)], hermitian=True) @ s[np.ix_(x, y)]
    return b, s[np.ix_(y, y)] - b.T @ s[np.ix_(x, y)]


def var_lags(frame: DataFrame, columns: list[str], max_lags: int = 10) -> DataFrame:
    """lag, aic, bic, n_obs of each feasible order on a common sample; the chosen order has the least ``aic``."""
    return frame.sparkSession.createDataFrame(_orders(LagMoments(frame, columns, max_lags)), "lag int, aic double, bic double, n_obs long")


def var_model(frame: DataFrame, columns: list[str], max_lags: int = 10, lag: int | None = None) -> DataFrame:
    """equation, term (``const`` or ``L<lag>.<column>``), coef of the VAR on all its rows, of the order with the least AIC or of ``lag``."""
    m = LagMoments(frame, columns, lag or max_lags)
    p = lag or min(_orders(m), key=lambda r: (r[1], r[0]))[0]
    b, _ = _var(m, m.since(p), p)
    mean = np.array(m.means)
    b[0] += mean - np.tile(mean, p) @ b[1:]  # from around the means to the values themselves
    terms = ["const", *[f"L{j}.{c}" for j in range(1, p + 1) for c in columns]]
    rows = [(c, t, float(b[i, k])) for k, c in enumerate(columns) for i, t in enumerate(terms)]
    return frame.sparkSession.createDataFrame(rows, "equation string, term string, coef double")


# ---- stationarity

#: Fixed values (MacKinnon 1994, one variable, constant): range, change of polynomial, and both polynomials, lowest power first.
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
TAU_SMALL_P, TAU_LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
#: Critical values of the level KPSS statistic and their levels.
KPSS_STAT, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf_p(stat: float) -> float:
    """The response surface's p-value of the Dickey-Fuller t statistic with a constant."""
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    z = sum(c * stat**k for k, c in enumerate(TAU_SMALL_P if stat <= TAU_STAR else TAU_LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_lags(n: int) -> int:
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3)


def adf(parts: dict[int, np.ndarray], top: int) -> tuple[float, float, int]:
    """Statistic, p and lag (by AIC on a common sample) from moments of 1, level before, change, changes before."""

    def fit(k: int, start: int) -> tuple[float, float]:
        s = sum(m for i, m in parts.items() if i >= start)
        x = [0, 1, *range(3, 3 + k)]
        b, ssr, inv = panel.solve(s, x, 2)
        n = s[0, 0]
        return b[1] / math.sqrt(ssr / max(n - len(x), 1) * inv[1, 1]), n * math.log(ssr / n) + 2 * len(x)

    k = min(range(top + 1), key=lambda j: fit(j, top)[1])
    stat = float(fit(k, k)[0])
    return stat, adf_p(stat), k


def verdict(adf_p: float, kpss_p: float) -> str:
    a, k = adf_p < 0.05, kpss_p > 0.05
    return "stationary" if a and k else "inconclusive" if a or k else "non_stationary"


def _autocovariances(rows: DataFrame, lags: dict[str, int]) -> dict[str, list[float]]:
    """Sums of products of ``_v`` with itself 0, 1, ... rows back by ``_c``, to each one's number of lags."""
    most = max(lags.values())
    parts, w, own = panel.blocked(rows, most, 0, ["_c"])
    cross = parts.withColumns({f"_v{k}": F.col("_v") * F.lag("_v", k).over(w) for k in range(1, most + 1)}).where(own)
    found = cross.groupBy("_c").agg(F.sum(F.col("_v") * F.col("_v")), *[F.sum(f"_v{k}") for k in range(1, most + 1)]).collect()
    return {r[0]: [v or 0.0 for v in r[1:]][: lags[r[0]] + 1] for r in found if r[0] in lags}


def kpss_lags(n: int, g: list[float]) -> int:
    """The data-dependent number of lags, from autocovariance sums to lag int(n^(2/9))."""
    s0 = (g[0] + 2 * sum(g[1:])) / n
    s1 = sum(2 * i * v for i, v in enumerate(g)) / n
    return int(min(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3), n - 1))


def stationarity(frame: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_obs, adf_stat, adf_p, kpss_stat, kpss_p, verdict; fewer than 20 rows skip, a constant is said to be one."""
    spark = frame.sparkSession
    schema = "column string, n_obs long, adf_stat double, adf_p double, kpss_stat double, kpss_p double, verdict string"
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_raw")) for c in columns])).alias("_s")
    rows = written(frame.select("date", *columns), "panel").select("date", named).select("date", "_s.*").where(F.col("_raw").isNotNull() & ~F.isnan("_raw"))
    seen = {r["_c"]: r for r in rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.avg("_raw").alias("m"), F.min("_raw").alias("a"), F.max("_raw").alias("b")).collect()}
    out = {c: (c, r["n"], None, None, None, None, "constant") for c, r in seen.items() if r["n"] >= 20 and r["a"] == r["b"]}
    live = {c: r for c, r in seen.items() if r["n"] >= 20 and r["a"] < r["b"]}
    if live:
        mean = F.broadcast(spark.createDataFrame([(c, r["m"]) for c, r in live.items()], "_c string, _m double"))  # a row a column
        v = written(panel.indexed(rows.join(mean, "_c").select("_c", "date", (F.col("_raw") - F.col("_m")).alias("_v")), ["_c"]), "panel")
        top = {c: adf_lags(r["n"]) for c, r in live.items()}
        most = max(top.values())
        d = panel.lagged(v, ["_v"], most + 1, by=["_c"]).where("_i > 0")  # the first change is of row 1
        change = [F.col("_v") - F.col("_v_lag1"), *[F.col(f"_v_lag{k}") - F.col(f"_v_lag{k + 1}") for k in range(1, most + 1)]]
        by_column: dict[str, dict[int, np.ndarray]] = {}
        for (c, i), m in panel.moments(d, [F.col("_v_lag1"), *change], F.col("_c"), F.least(F.col("_i") - 1, F.lit(most)).cast("int")).items():
            by_column.setdefault(c, {})[i] = m
        lags = {c: kpss_lags(live[c]["n"], g) for c, g in _autocovariances(v, {c: int(r["n"] ** (2 / 9)) for c, r in live.items()}).items()}
        covs = _autocovariances(v, lags)
        # partial sums: inside a block by a window, before a block from the blocks' totals
        inside = v.withColumn("_b", F.floor(F.col("_i") / panel.BLOCK))
        inside = inside.withColumn("_s", F.sum("_v").over(Window.partitionBy("_c", "_b").orderBy("_i")))
        blocks = inside.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("t"), F.sum("_s").alias("s"), F.sum(F.col("_s") * F.col("_s")).alias("q"))
        before = F.coalesce(F.sum("t").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        paths = dict(blocks.withColumn("o", before).groupBy("_c").agg(F.sum(F.col("n") * F.col("o") * F.col("o") + 2 * F.col("o") * F.col("s") + F.col("q"))).collect())
        for c, r in live.items():
            n = r["n"]
            a, ap, _ = adf(by_column[c], top[c])
            lrv = (covs[c][0] + sum(2 * (1 - i / (lags[c] + 1)) * covs[c][i] for i in range(1, lags[c] + 1))) / n
            k = paths[c] / n**2 / lrv
            kp = float(np.interp(k, KPSS_STAT, KPSS_P))
            out[c] = (c, n, a, ap, float(k), kp, verdict(ap, kp))
    return spark.createDataFrame([out[c] for c in columns if c in out], schema)
