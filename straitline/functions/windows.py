"""Rolling expressions whose minimum counts are of non-null values inside the frame."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def guarded(agg: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(value).over(frame) >= least, agg.over(frame))


def zscore(value: Column, order: WindowSpec, window: int, least: int | None = None) -> Column:
    """Against the mean and population deviation of the ``window`` rows before; a flat baseline gives null."""
    frame = order.rowsBetween(-window, -1)
    least = max(5, window // 4) if least is None else least
    mean, sd = (guarded(f(value), value, frame, least) for f in (F.avg, F.stddev_pop))
    return (value - mean) / F.nullif(sd, F.lit(0.0))


def prior_year(value: Column, date: Column, group: list[str], lag: int = 364, half: int = 14) -> Column:
    """Mean of the dates within ``half`` days of the date ``lag`` days back."""
    return F.avg(value).over(Window.partitionBy(*group).orderBy(F.unix_date(date)).rangeBetween(-(lag + half), -(lag - half)))


def carried(value: Column, order: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def carried_age(value: Column, date: Column, order: WindowSpec) -> Column:
    """Days since the date of the value that ``carried`` returns."""
    return F.datediff(date, carried(F.when(value.isNotNull(), date), order))


def rolling_corr(x: Column, y: Column, order: WindowSpec, window: int, least: int | None = None) -> Column:
    """Of pairwise-complete rows, by moments: ``corr`` raises on a constant window under ANSI."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    frame = order.rowsBetween(-(window - 1), 0)
    r = F.covar_samp(x, y).over(frame) / F.nullif(F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame), F.lit(0.0))
    return F.when(F.count(x).over(frame) >= (window // 2 if least is None else least), r)


def rolling_beta(y: Column, x: Column, order: WindowSpec, window: int, least: int | None = None) -> Column:
    """Covariance of complete pairs over the variance of all x of the window."""
    frame, least = order.rowsBetween(-(window - 1), 0), window // 2 if least is None else least
    both = x.isNotNull() & y.isNotNull()
    cov = F.when(F.count(F.when(both, x)).over(frame) >= least, F.covar_samp(F.when(both, y), F.when(both, x)).over(frame))
    var = F.when(F.count(x).over(frame) >= least, F.var_samp(x).over(frame))
    return cov / F.nullif(var, F.lit(0.0))
