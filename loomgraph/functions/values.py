"""Values that graphs hold as text or as attributes: ranges, conditions, moments, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([+-]?[0-9]+(?:\.[0-9]+)?)"


def text_range(text: Column) -> Column:
    """``low, high`` of a number, a range (250-300, with any dash) or a bound (>400, <= 5) in text; null sides are open, and
    text of another form gives nulls on both."""
    clean = F.trim(text)
    pair = rf"^{_NUMBER}\s*[-–—~]\s*{_NUMBER}$"
    over, under = rf"^(?:>=?|≥)\s*{_NUMBER}$", rf"^(?:<=?|≤)\s*{_NUMBER}$"
    part = lambda pattern, k: F.regexp_extract(clean, pattern, k).try_cast("decimal(38,10)")
    one = rf"^{_NUMBER}$"
    low = F.when(clean.rlike(pair), part(pair, 1)).when(clean.rlike(over), part(over, 1)).when(clean.rlike(one), part(one, 1))
    high = F.when(clean.rlike(pair), part(pair, 2)).when(clean.rlike(under), part(under, 1)).when(clean.rlike(one), part(one, 1))
    return F.struct(low.alias("low"), high.alias("high"))


def condition_holds(value: Column, operator: Column, bound: Column) -> Column:
    """Whether a value meets a condition that is stored as operator and bound; numbers compare as numbers, other text by equality."""
    v, b = value.try_cast("decimal(38,10)"), bound.try_cast("decimal(38,10)")
    span = text_range(bound)
    return (
        F.when(operator.isin(">", "greater than"), v > b)
        .when(operator.isin(">=", "≥", "at least"), v >= b)
        .when(operator.isin("<", "less than"), v < b)
        .when(operator.isin("<=", "≤", "at most"), v <= b)
        .when(operator.isin("between", "range"), (v >= span["low"]) & (v <= span["high"]))
        .when(operator.isin("!=", "≠", "not equal"), F.when(v.isNotNull() & b.isNotNull(), v != b).otherwise(value != bound))
        .when(operator.isin("=", "==", "equal", "is"), F.when(v.isNotNull() & b.isNotNull(), v == b).otherwise(value == bound))
    )


def moments(value: Column) -> list[Column]:
    """Aggregates that describe a distribution; each is a partial aggregate of a few numbers a group."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis")]


def errors(predicted: Column, observed: Column) -> list[Column]:
    """Aggregates of prediction errors: mean absolute and squared, bias, and the coefficient of determination."""
    gap = predicted - observed
    spread = F.var_pop(observed) * F.count(observed)
    return [F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"), (1 - F.try_divide(F.sum(gap * gap), spread)).alias("r2")]


def exceedance(value: Column, limit: float) -> Column:
    """The share of values above a limit."""
    return F.avg((value > limit).cast("double")).alias("exceedance")
