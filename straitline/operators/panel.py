"""Ordered panels without one task that holds them: row numbers, neighbours across block edges, moments by one aggregation.

Rows are numbered inside a year and years are offset by the rows before them; lags and leads come from blocks of rows that
carry a margin of their neighbours' rows; sums of products are map-side combined. What a model needs of a panel is then a
matrix of the size of its terms, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block; lags and leads reach over one edge at most, so no more than this many.
BLOCK = 2048


def indexed(df: DataFrame, by: Sequence[str] = (), date: str = "date", name: str = "_i") -> DataFrame:
    """Row numbers from 0 by ``date`` within ``by``. The offsets have a row a year."""
    year, at, size, before = (f"_panel_{x}" for x in ("year", "at", "size", "before"))
    rows = df.where(F.col(date).isNotNull()).withColumn(year, F.year(date))
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(*by, year).orderBy(date)))
    years = rows.groupBy(*by, year).agg(F.max(at).alias(size))
    sofar = F.sum(size).over(Window.partitionBy(*by).orderBy(year).rowsBetween(Window.unboundedPreceding, -1))
    offsets = years.select(*by, year, F.coalesce(sofar, F.lit(0)).alias(before))
    return rows.join(offsets, [*by, year]).withColumn(name, F.col(before) + F.col(at) - 1).drop(year, at, before)


def blocked(rows: DataFrame, back: int, ahead: int = 0, by: Sequence[str] = (), name: str = "_i") -> tuple[DataFrame, WindowSpec, Column]:
    """Rows in blocks with ``back`` rows before and ``ahead`` after each, the window over a block, and what a block's own rows are."""
    if max(back, ahead) > BLOCK:
        raise ValueError(f"{max(back, ahead)} rows reach over more than one edge of blocks of {BLOCK}")
    own, i = F.floor(F.col(name) / BLOCK), F.col(name)
    sent = F.array_distinct(F.array(own, F.floor((i + back) / BLOCK), F.floor((i - ahead) / BLOCK)))
    return rows.withColumn("_own", own).withColumn("_b", F.explode(sent)), Window.partitionBy(*by, "_b").orderBy(name), F.col("_b") == F.col("_own")


def lagged(rows: DataFrame, columns: Sequence[str], lags: int, leads: Sequence[int] = (), by: Sequence[str] = ()) -> DataFrame:
    """``<column>_lag<k>`` for k up to ``lags`` and ``<column>_lead<k>`` for ``leads`` of the first column."""
    parts, w, own = blocked(rows, lags, max(leads, default=0), by)
    new = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, lags + 1)} | {f"{columns[0]}_lead{k}": F.lead(columns[0], k).over(w) for k in leads}
    return parts.withColumns(new).where(own).drop("_own", "_b") if new else rows


def products(terms: Sequence[Column]) -> list[Column]:
    """Sums of all products of two terms, the upper triangle row by row."""
    return [F.sum(terms[a] * terms[b]) for a in range(len(terms)) for b in range(a, len(terms))]


def square(sums: Sequence[float], size: int) -> np.ndarray:
    """The symmetric matrix of ``products``."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = sums
    return out + np.triu(out, 1).T


def moments(rows: DataFrame, terms: Sequence[Column], *keys: Column) -> dict:
    """key -> matrix of sums of products of 1 and ``terms``; with several ``keys`` a tuple of them.

    A task multiplies its rows out a batch at a time and sends one matrix a key; Spark adds these up. A null term counts as
    0, so a key is to tell apart rows that lack some.
    """
    size, names = len(terms) + 1, [f"_k{i}" for i in range(len(keys))]
    parts = rows.select(*[k.alias(n) for k, n in zip(keys, names)], F.array(*[F.coalesce(t.cast("double"), F.lit(0.0)) for t in terms]).alias("_z"))
    kinds = {n: parts.schema[n].dataType.simpleString() for n in names}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.column_stack([np.ones(batch.num_rows), batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)])
            codes, of = {}, np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
                of[i] = codes.setdefault(key, len(codes))
            for key, code in codes.items():
                own = z[of == code]
                found[key] = found.get(key, 0.0) + own.T @ own
        if found:
            columns = [pa.array([k[i] for k in found], batch.schema.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel().tolist() for m in found.values()], pa.list_(pa.float64()))], names=[*names, "_m"])

    sent = parts.mapInArrow(multiply, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", _m array<double>")
    out: dict = {}
    for r in sent.select(*names, F.posexplode("_m").alias("_at", "_v")).groupBy(*names, "_at").agg(F.sum("_v").alias("_v")).collect():  # keys by terms squared
        key = r[0] if len(names) == 1 else tuple(r[: len(names)])
        out.setdefault(key, np.zeros(size * size))[r["_at"]] = r["_v"]
    return {k: m.reshape(size, size) for k, m in out.items()}


def means(rows: DataFrame, columns: Sequence[str]) -> tuple[int, list[float]]:
    """Rows and the mean of each column, in one pass; models are solved around these, so large levels don't eat the digits."""
    r = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    return r[0], [v or 0.0 for v in r[1:]]


def solve(m: np.ndarray, x: Sequence[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, sum of squared residuals and inverse of X'X of the regression of term ``y`` on terms ``x``."""
    x = list(x)
    inv = np.linalg.pinv(m[np.ix_(x, x)], hermitian=True)
    b = inv @ m[x, y]
    return b, float(max(m[y, y] - 2 * b @ m[x, y] + b @ m[np.ix_(x, x)] @ b, 0.0)), inv
