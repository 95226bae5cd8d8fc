"""Aggregate expressions of the rating: rates, weighted means, shrinkage and dispersion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column | str) -> Column:
    """Sum as a double; exact underneath when c is a decimal."""
    return F.sum(c).cast("double")


def mean(c: Column | str) -> Column:
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def per90(amount: Column | str, mins: Column | str) -> Column:
    """Amount for each 90 minutes; null without minutes."""
    return F.try_divide(total(amount) * 90, total(mins))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight over the rows that have both; the plain mean if all weights are zero, null without rows."""
    w = F.when(value.isNotNull(), weight)
    return F.coalesce(F.try_divide(F.sum(value * w), F.sum(w)), F.avg(value))


def consistency(value: Column | str, least: int = 6) -> Column:
    """mean / (mean + sample deviation) of at least `least` values."""
    v = value if isinstance(value, Column) else F.col(value)
    return F.when(F.count(v) >= least, F.try_divide(F.avg(v), F.avg(v) + F.stddev_samp(v)))


def boost(with_: Column, without: Column, n_without: Column, least: int = 6, prior: float = 8.0) -> Column:
    """Ratio of with to without, drawn towards 1 when few rows are without."""
    ratio = F.when((with_ > 0) & (without > 0), F.ln(with_ / without))
    return F.when(n_without >= least, F.exp(ratio * n_without / (n_without + prior)))


def shrink(value: Column, mass: Column, prior: Column, strength: Column | float) -> Column:
    """(mass x value + strength x prior) / (mass + strength)."""
    k = strength if isinstance(strength, Column) else F.lit(strength)
    return (mass * value + k * prior) / (mass + k)


def clip(value: Column, low: float, high: float) -> Column:
    """Bounds a value; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def argmax(value: Column, by: Column, tie: Column) -> Column:
    """The value at the largest `by`, of equals the smallest tie."""
    return F.min_by(value, F.struct((-by).alias("by"), tie.alias("tie")))


def round_exact(value: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, ties to even, where F.round goes by its shortest decimal form.

    The distance from the midpoint is summed from two halves of the number, so no product is inexact.
    """
    scale = 10**digits
    k, high = F.floor(value * scale), value.cast("float").cast("double")
    beyond = (high * (2 * scale) - (2 * k + 1)) + (value - high) * (2 * scale)
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(k, F.lit(2)) == 1))
    return F.when(F.abs(value) < 1e9, (k + up.cast("int")).cast("double") / scale).otherwise(F.round(value, digits))
