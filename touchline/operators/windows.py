"""Ranks, recursive averages and robust scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .ordered import quantiles, ranks, recursive_mean, running, with_groups


def spread_by_value(df: DataFrame, value: str, size: int = 100_000) -> DataFrame:
    """df with `_bucket`, larger values in lower buckets and nulls in the last; equal values share a bucket.

    Approximate quantiles part the values into as many buckets as give each about
    `size` rows, from 16 to 4096. df is read three times, so it is written once.
    """
    df = cut(df)
    buckets = min(4096, max(16, -(-df.count() // size)))
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 10_000).alias("_edges"))
    place = F.when(F.col(value).isNull(), buckets + 1).otherwise(F.size(F.filter("_edges", lambda e: e > F.col(value))))
    return df.join(edges).withColumn("_bucket", F.coalesce(place, F.lit(0))).drop("_edges")


def rank_average(df: DataFrame, value: str, by: list[str], out: str, floor: bool = True) -> DataFrame:
    """Descending rank in the group where ties have the mean of their ranks, truncated unless floor is False; nulls come last as one tie.

    Without `by` the rank is that in the whole table.
    """
    rank = F.col("_first") + (F.col("_peers") - 1) / 2
    return ranks(df, value, by).withColumn(out, F.floor(rank) if floor else rank).drop("_first", "_peers")


def rank_min(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Descending competition rank in the whole table, or in the group, nulls last as one tie."""
    return ranks(df, value, by or []).withColumn(out, F.col("_first").cast("long")).drop("_first", "_peers")


def place(df: DataFrame, value: str, keys: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Ordinal place in the whole table, or in the group, by descending value, of equals by the keys, nulls last."""
    return running(df, by or [], [F.col(value).desc_nulls_last(), *[F.col(k) if isinstance(k, str) else k for k in keys]], F.lit(1), out).withColumn(out, F.col(out).cast("long"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., rho, n): correlation of average ranks over rows that have both values."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rank_average(rank_average(rows, x, by, "_x", floor=False), y, by, "_y", floor=False)
    return rows.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def ewma(values: Column, alpha: float = 0.3) -> Column:
    """Exponentially weighted mean of an array in order, seeded with its first value; null for an empty one."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)), lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s))


def ewma_series(rows: DataFrame, by: list[str], keys: list[str], value: str, out: str, alpha: float = 0.3) -> DataFrame:
    """rows with the mean after each of them, and their place `pos` in the group from 0."""
    return recursive_mean(rows, by, [F.col(k) for k in keys], value, out, alpha)


def in_order(value: Column, *keys: str) -> Column:
    """Array of a group's values in the order of the keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("_value")))), lambda s: s["_value"])


def reference(df: DataFrame, value: str, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(by..., _n, _mean, _sd) of a group's values winsorised at its own quantiles, by two aggregations."""
    rows = cut(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value")))
    edges = quantiles(rows, by, "_value", [low, high], "_e")
    kept = F.least(F.greatest(F.col("_value"), F.col("_e")[0]), F.col("_e")[1])
    return with_groups(rows, edges, by).groupBy(*by).agg(F.count(kept).alias("_n"), F.avg(kept).alias("_mean"), F.stddev_samp(kept).alias("_sd"))


def robust_z(df: DataFrame, value: str, by: list[str], out: str, limit: float = 3.0, least: int = 3, fallback: tuple[str, str] | None = None, own_least: int = 6) -> DataFrame:
    """Scores by mean and deviation of the values winsorised inside their group.

    Bounded to +-limit; 0 where the group does not vary, null where it has fewer
    than `least` values. With fallback (column, name) a group of fewer than
    `own_least` values is scored by that of the same keys with the name in the
    column.
    """
    stats = reference(df, value, by)
    stats = cut(stats)
    rows = with_groups(df, stats, by)
    n, mean, sd = F.coalesce("_n", F.lit(0)), F.col("_mean"), F.col("_sd")
    if fallback:
        column, name = fallback
        rest = [k for k in by if k != column]
        other = stats.filter(F.col(column) == name).select(*rest, *[F.col(c).alias(f"{c}f") for c in ("_n", "_mean", "_sd")])
        rows = with_groups(rows, other, rest)
        use = (n < own_least) & (F.col(column) != name)
        n, mean, sd = (F.when(use, y).otherwise(x) for x, y in ((n, F.coalesce("_nf", F.lit(0))), (mean, F.col("_meanf")), (sd, F.col("_sdf"))))
    z = F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.col(value) - mean) / sd))
    score = F.when((n < least) | F.col(value).isNull(), None).when(sd == 0, 0.0).otherwise(z)
    return rows.withColumn(out, score).drop("_n", "_mean", "_sd", "_nf", "_meanf", "_sdf")


def robust_scores(df: DataFrame, values: list[str], by: list[str], fallback: tuple[str, str] | None = None, limit: float = 3.0, least: int = 3, own_least: int = 6) -> DataFrame:
    """df with each of `values` replaced by its robust score among the rows of its group, as robust_z gives for one.

    Only values and their groups are stood below each other, to be counted; what
    groups come to, a row a group, is joined back to df as it is. With fallback
    (column, name) the column is one more key of the groups.
    """
    df = cut(df)
    keys = [*by, fallback[0]] if fallback else by
    stats = reference(df.select(*keys, *values).unpivot(keys, values, "_metric", "_score"), "_score", [*keys, "_metric"])
    figures = F.struct(*[F.col(c) for c in ("_n", "_mean", "_sd")])
    stats = cut(stats.groupBy(*keys).agg(*[F.max(F.when(F.col("_metric") == v, figures)).alias(f"_of_{v}") for v in values]))
    rows = with_groups(df, stats, keys)
    if fallback:
        column, name = fallback
        rows = with_groups(rows, stats.filter(F.col(column) == name).select(*by, *[F.col(f"_of_{v}").alias(f"_else_{v}") for v in values]), by)
    for v in values:
        n, mean, sd = F.coalesce(F.col(f"_of_{v}._n"), F.lit(0)), F.col(f"_of_{v}._mean"), F.col(f"_of_{v}._sd")
        if fallback:
            use = (n < own_least) & (F.col(column) != name)
            n, mean, sd = (F.when(use, y).otherwise(x) for x, y in ((n, F.coalesce(F.col(f"_else_{v}._n"), F.lit(0))), (mean, F.col(f"_else_{v}._mean")), (sd, F.col(f"_else_{v}._sd"))))
        z = F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.col(v) - mean) / sd))
        rows = rows.withColumn(f"_z_{v}", F.when((n < least) | F.col(v).isNull(), None).when(sd == 0, 0.0).otherwise(z))
    return rows.select(*[F.col(f"_z_{c}").alias(c) if c in values else F.col(c) for c in df.columns])


def last_n(df: DataFrame, by: list[str], keys: list[str], n: int) -> DataFrame:
    """The last n rows of each group by the keys."""
    order = Window.partitionBy(*by).orderBy(*[F.col(k).desc() for k in keys])
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)
