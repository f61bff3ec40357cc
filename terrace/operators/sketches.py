"""Aggregates with mergeable sketches: kept at a fine grain, rolled up to any coarser one without the rows.

Distinct counts are HyperLogLog sketches, quantiles are KLL sketches; both merge to the sketch of all their rows. Sums, counts,
least and greatest values roll up beside them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct sketch (relative error about 1.04 / 2^(LOG_K / 2)), and the size of a quantile sketch (rank error about 1.65 %).
LOG_K, KLL_K = 12, 200
_ROLL = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def pre_aggregated(df: DataFrame, keys: Sequence[str | Column], wanted: Mapping[str, tuple[str, str]], log_k: int = LOG_K, kll_k: int = KLL_K) -> DataFrame:
    """A row for each group. wanted: {new name: (kind, column)}, kind one of sum, count, min, max, distinct and quantiles. NULLs are
    ignored; distinct takes whole numbers and texts, quantiles numbers."""
    made = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    out = []
    for name, (kind, c) in wanted.items():
        if kind == "distinct":
            out.append(F.hll_sketch_agg(c, log_k).alias(name))
        elif kind == "quantiles":
            out.append(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(kll_k)).alias(name))
        else:
            out.append(made[kind](c).alias(name))
    return df.groupBy(*keys).agg(*out)


def rolled_up(df: DataFrame, keys: Sequence[str | Column], wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The pre-aggregate of coarser groups, from that of finer ones; wanted as for pre_aggregated()."""
    out = []
    for name, (kind, _) in wanted.items():
        if kind == "distinct":
            out.append(F.hll_union_agg(name).alias(name))
        elif kind == "quantiles":
            out.append(F.kll_merge_agg_double(name).alias(name))
        else:
            out.append(_ROLL[kind](name).alias(name))
    return df.groupBy(*keys).agg(*out)


def distinct_estimate(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(sketch: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))
