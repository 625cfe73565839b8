"""Sketches that are kept by unit and day and merged later: distinct values (HLL) and quantiles (KLL), without reading rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an HLL's buckets: estimates of many values are off by about 1.04 / sqrt(2^bits), here 1.6 %.
HLL_BITS = 12
#: A KLL sketch's size: ranks are off by about 1 % at 200.
KLL_SIZE = 200


def sketch_states(rows: DataFrame, units: list[str], distinct: str | None = None, quantiles: str | None = None) -> DataFrame:
    """A row for each combination of ``units`` with the number of rows and the states of both sketches: ``n``, ``distinct_state`` (any column)
    and ``quantile_state`` (numbers as doubles). Nulls count in ``n`` alone. Partial states are merged before the shuffle."""
    sums = [F.count("*").alias("n")]
    if distinct is not None:
        sums.append(F.hll_sketch_agg(F.col(distinct).cast("string"), HLL_BITS).alias("distinct_state"))
    if quantiles is not None:
        sums.append(F.kll_sketch_agg_double(F.col(quantiles).cast("double"), KLL_SIZE).alias("quantile_state"))
    return rows.groupBy(*units).agg(*sums)


def add_states(states: DataFrame, path: str) -> None:
    """Append states to those stored at a path. A unit may come in any number of parts; ``merged`` puts them together."""
    states.write.mode("append").parquet(path)


def merged(states: DataFrame, units: list[str]) -> DataFrame:
    """States of coarser units (or of everything, for none): sketches of a union are the unions of sketches."""
    sums = [F.sum("n").alias("n")]
    if "distinct_state" in states.columns:
        sums.append(F.hll_union_agg("distinct_state").alias("distinct_state"))
    if "quantile_state" in states.columns:
        sums.append(F.kll_merge_agg_double("quantile_state").alias("quantile_state"))
    return states.groupBy(*units).agg(*sums)


def estimates(states: DataFrame, at: list[float] = (0.5, 0.95)) -> DataFrame:
    """The states' numbers in their place: ``n_distinct`` and an array ``quantiles``, one for each share in ``at``."""
    out = states
    if "distinct_state" in states.columns:
        out = out.withColumn("n_distinct", F.hll_sketch_estimate("distinct_state")).drop("distinct_state")
    if "quantile_state" in states.columns:
        out = out.withColumn("quantiles", F.array(*[F.kll_sketch_get_quantile_double("quantile_state", F.lit(float(q))) for q in at])).drop("quantile_state")
    return out
