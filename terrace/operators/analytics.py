"""Trend lines, reference lines, intervals, alerts, clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread
from .spread import beside

_FORMS = {
    "linear": (lambda x: x, lambda y: y),
    "logarithmic": (lambda x: F.when(x > 0, F.ln(x)), lambda y: y),
    "exponential": (lambda x: x, lambda y: F.when(y > 0, F.ln(y))),
    "power": (lambda x: F.when(x > 0, F.ln(x)), lambda y: F.when(y > 0, F.ln(y))),
}


def trend(df: DataFrame, x: str, y: str, form: str = "linear", keys: Sequence[str] = ()) -> DataFrame:
    """slope, intercept (of the straight line in the form's logarithms) and r2, for each key: one pass of sums."""
    fx, fy = _FORMS[form]
    a, b = fx(F.col(x).cast("double")), fy(F.col(y).cast("double"))
    return df.groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def polynomial_trend(df: DataFrame, x: str, y: str, order: int) -> list[float]:
    """Coefficients from the constant up: moments are summed on the executors, the normal equations have order + 1 unknowns."""
    import numpy as np

    v = F.col(x).cast("double")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = rows.agg(*[F.sum(v**i).alias(f"s{i}") for i in range(2 * order + 1)], *[F.sum(F.col(y) * v**i).alias(f"t{i}") for i in range(order + 1)]).first()
    a = np.array([[sums[f"s{i + j}"] for j in range(order + 1)] for i in range(order + 1)])
    return np.linalg.lstsq(a, np.array([sums[f"t{i}"] for i in range(order + 1)]), rcond=None)[0].tolist()


def reference_lines(df: DataFrame, c: str, keys: Sequence[str] = (), percentiles: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """mean, median, low, high and percentiles of a scope: a pane's keys, or none for the table."""
    lines = df.groupBy(*keys).agg(F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))
    names = {"median": 0.5} | {f"p{int(100 * p)}": p for p in percentiles}
    found = beside(lines, spread.percentiles(df, keys, c, names), keys)
    return found.select(*keys, "mean", "median", "low", "high", *[n for n in names if n != "median"])


def confidence(df: DataFrame, c: str, z: float = 1.96, keys: Sequence[str] = ()) -> DataFrame:
    """Mean with its normal interval."""
    half = F.lit(z) * F.stddev_samp(c) / F.sqrt(F.count(c))
    return df.groupBy(*keys).agg(F.avg(c).alias("mean"), (F.avg(c) - half).alias("low"), (F.avg(c) + half).alias("high"))


def alerts(df: DataFrame, keys: Sequence[str], measure: Column, operator: str, threshold: float) -> DataFrame:
    """Groups whose measure crosses the threshold."""
    value = F.col("value")
    holds = {">": value > threshold, "<": value < threshold, ">=": value >= threshold, "<=": value <= threshold, "=": value == threshold, "!=": value != threshold}
    return df.groupBy(*keys).agg(measure.alias("value")).where(holds[operator])


def clusters(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """k-means on standardised columns; `cluster` from 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_x", "_z")


def forecast(df: DataFrame, keys: Sequence[str], order: str, measure: str, periods: int, level: float = 0.5, slope: float = 0.3) -> DataFrame:
    """keys, step, forecast: `periods` values after each series, by exponential smoothing of level and slope.

    A series is a view's marks in order, one for each period: as short as its calendar, so it fits a task. NULL marks are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "step int, forecast double"

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(order, kind="stable")[measure].astype(float).tolist()
        at, trend = values[0], 0.0
        for v in values[1:]:
            before = at
            at = level * v + (1 - level) * (at + trend)
            trend = slope * (at - before) + (1 - slope) * trend
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * periods for k in keys}, "step": range(1, periods + 1), "forecast": [at + i * trend for i in range(1, periods + 1)]})

    return df.where(F.col(measure).isNotNull()).select(*keys, order, measure).groupBy(*keys).applyInPandas(smooth, schema)


#: What the fit of a seasonal forecast tries for level, slope and season.
GRID = ((0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.05, 0.1, 0.3), (0.05, 0.2, 0.5, 0.8))


def _seasonal(values, season: int, level, slope, turn):
    """Additive smoothing from the second season on, for arrays of parameters side by side: the last level, slope and season (its next
    place first), and the squared one-step errors' sum."""
    import numpy as np

    first, second = values[:season], values[season : 2 * season]
    shape = np.shape(level)
    at, step = np.full(shape, first.mean()), np.full(shape, (second.mean() - first.mean()) / season)
    places, errors = [np.full(shape, v - first.mean()) for v in first], np.zeros(shape)
    for i, v in enumerate(values[season:]):
        s = places[i % season]
        errors = errors + (v - at - step - s) ** 2
        before, at = at, level * (v - s) + (1 - level) * (at + step)
        step = slope * (at - before) + (1 - slope) * step
        places[i % season] = turn * (v - at) + (1 - turn) * s
    n = len(values) - season
    return at, step, [places[(n + k) % season] for k in range(season)], errors


def fitted_parameters(values, season: int, grid=GRID) -> tuple[float, float, float]:
    """Of all combinations, the one of least squared one-step errors; the first of equals."""
    import numpy as np

    a, b, c = (x.ravel() for x in np.meshgrid(*grid, indexing="ij"))
    k = int(np.argmin(_seasonal(np.asarray(values, float), season, a, b, c)[3]))
    return float(a[k]), float(b[k]), float(c[k])


def seasonal_forecast(df: DataFrame, keys: Sequence[str], order: str, measure: str, periods: int, season: int, parameters: tuple[float, float, float] | None = None, z: float = 1.96) -> DataFrame:
    """keys, step, forecast, low, high: `periods` values after each series, by additive smoothing of level, slope and season, with
    the interval of z standard deviations.

    Parameters that are not given are fitted to each series. A series is a view's marks in order, one for each period, so it
    fits a task; NULL marks are left out. One of fewer than two seasons has no season, and the mean of its steps for a slope.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "step int, forecast double, low double, high double"

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        values, steps = rows.sort_values(order, kind="stable")[measure].astype(float).to_numpy(), np.arange(1, periods + 1)
        if len(values) < 2 * season:
            slope = (values[-1] - values[0]) / max(1, len(values) - 1)
            line, errors, lag = values[-1] + steps * slope, np.diff(values) - slope, np.sqrt(steps)
        else:
            level, slope, turn = parameters or fitted_parameters(values, season)
            at, step, places, squares = _seasonal(values, season, np.float64(level), np.float64(slope), np.float64(turn))
            line = at + steps * step + np.array([places[(h - 1) % season] for h in steps])
            errors = np.array([np.sqrt(squares / (len(values) - season))])
            j = np.arange(1, periods)
            weights = level * (1 + j * slope) + turn * (1 - level) * (j % season == 0)
            lag = np.sqrt(1 + np.concatenate([[0.0], np.cumsum(weights**2)]))
        half = z * np.sqrt((errors**2).mean() if len(errors) else 0.0) * lag
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * periods for k in keys}, "step": steps.astype("int32"), "forecast": line, "low": line - half, "high": line + half})

    return df.where(F.col(measure).isNotNull()).select(*keys, order, measure).groupBy(*keys).applyInPandas(smooth, schema)


def reference_set(df: DataFrame, c: str, wanted: Mapping[str, str | tuple], keys: Sequence[str] = ()) -> DataFrame:
    """keys and a line for each new name, over a pane's keys or, without any, the table: mean, sum, count, min, max, median, mode (the
    least of equals), ("constant", value), ("percentile", share), ("quantile", k, of n), ("deviations", k: mean and k deviations)."""
    plain = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    out, shares, mode = [], {}, None
    for name, what in wanted.items():
        kind, *how = (what,) if isinstance(what, str) else what
        if kind in plain:
            out.append(plain[kind](c).alias(name))
        elif kind == "constant":
            out.append(F.max(F.lit(how[0])).alias(name))
        elif kind == "deviations":
            out.append((F.avg(c) + F.lit(how[0]) * F.stddev_samp(c)).alias(name))
        elif kind in ("median", "percentile", "quantile"):
            shares[name] = (c, 0.5 if kind == "median" else how[0] if kind == "percentile" else how[0] / how[1])
        elif kind == "mode":
            mode = name
        else:
            raise ValueError(f"no such line: {kind}")
    found = df.groupBy(*keys).agg(*(out or [F.count(F.lit(1)).alias("__n")]))
    if shares:
        found = beside(found, spread.order_statistics(df, keys, shares), keys) if keys else found.join(spread.order_statistics(df, keys, shares), how="left")
    if mode:
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__times"))
        best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__times")).alias("less"), F.col(c).alias("value"))).alias("__best")).select(*keys, F.col("__best.value").alias(mode))
        found = beside(found, best, keys) if keys else found.join(best, how="left")
    return found.select(*keys, *wanted)


def banded(df: DataFrame, c: str, edges: Sequence[str | tuple], keys: Sequence[str] = ()) -> DataFrame:
    """df with `band`, the number of edges (lines as for reference_set()) of its pane that a value reaches; NULL for NULL."""
    names = {f"__edge{i}": e for i, e in enumerate(edges)}
    lines = reference_set(df, c, names, keys)
    rows = beside(df, lines, keys) if keys else df.crossJoin(F.broadcast(lines))  # one row
    reached = sum(((F.col(c) >= F.col(e)).cast("int") for e in names), F.lit(0))
    return rows.withColumn("band", F.when(F.col(c).isNotNull(), reached)).drop(*names)
