"""Order-dependent work without a task for a whole group: places, running totals, recursions, quantiles.

Rows are dealt by ranges of (group, order), so a group of any size lies in many
blocks. What a block leaves to those after it is one row a block and group.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut, written

#: groups whose figures are sent to every task at once; more are joined by shuffle
GROUPS = 100_000
#: a weight of 1e-100 is where a run of a recursion ends and the next begins
DECADES = 100


def blocks(df: DataFrame, order: list) -> DataFrame:
    """df with `_block`: numbers of ranges in the given order, written so that they stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id()))


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows beside the figures of their group, a row a group; sent to all tasks only if counted to be few."""
    if not by:
        return rows.join(groups)
    groups = cut(groups)
    few = groups.limit(GROUPS + 1).count() <= GROUPS
    names = {c: f"_of{k}" for k, c in enumerate(by)}
    right = groups.withColumnsRenamed(names)
    same = reduce(Column.__and__, [rows[c].eqNullSafe(right[n]) for c, n in names.items()])
    return rows.join(F.broadcast(right) if few else right, same, "left").drop(*names.values())


def with_means(rows: DataFrame, by: list[str], means: dict[str, str]) -> DataFrame:
    """rows with the mean of each named column in their group, by an aggregation joined back."""
    return with_groups(rows, rows.groupBy(*by).agg(*[F.avg(c).alias(out) for out, c in means.items()]), by)


def running(df: DataFrame, by: list[str], order: list, amount: Column, out: str) -> DataFrame:
    """df with the sum of `amount` over its group's rows up to and with each one, in an order without ties."""
    rows = blocks(df, [*by, *order])
    sizes = rows.groupBy(*by, "_block").agg(F.sum(amount).alias("_sum"))
    # a row a block and group
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.sum(amount).over(inside))
    names = {c: f"_of{k}" for k, c in enumerate([*by, "_block"])}
    right = sizes.withColumnsRenamed(names)
    same = reduce(Column.__and__, [rows[c].eqNullSafe(right[n]) for c, n in names.items()])
    return rows.join(right, same).withColumn(out, F.col("_here") + F.col("_before")).drop("_block", "_here", "_before", *names.values())


def ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with `_first`, one more than the rows of its group with larger values, and `_peers`, those with its own; nulls come last.

    Only how often each value occurs is put in order, so a frequent one is one row.
    """
    df = cut(df)
    counts = df.groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_peers"))
    counts = running(counts, by, [F.col("_value").desc_nulls_last()], F.col("_peers"), "_last")
    names = {c: f"_of{k}" for k, c in enumerate(by)}
    right = counts.withColumnsRenamed(names).withColumn("_first", F.col("_last") - F.col("_peers") + 1).drop("_last")
    same = reduce(Column.__and__, [df[c].eqNullSafe(right[n]) for c, n in names.items()], df[value].eqNullSafe(right["_value"]))
    return df.join(right, same).drop("_value", *names.values())


def recursive_mean(rows: DataFrame, by: list[str], keys: list, value: str, out: str, alpha: float = 0.3) -> DataFrame:
    """rows with s = alpha x + (1 - alpha) s of the row before, the first row's s being its x, and their place `pos` in the group from 0.

    Each row maps what came before to a s + b. Runs of rows are composed to one
    map each by sums of scaled values, their maps are composed by doubling, and
    what arrives at a run is applied to its rows. A run ends where the weight of
    what came before it falls under 1e-100, so nothing overflows; any alpha above
    0 and up to 1 is exact up to rounding. Rows without a value are left out;
    keys should leave no ties.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0 and at most 1")
    rows = blocks(rows.filter(F.col(value).isNotNull()), [*by, *keys])
    inside = Window.partitionBy(*by, "_block").orderBy(*keys)
    keep = 1 - alpha
    length = max(1, int(DECADES * math.log(10) / -math.log(keep))) if keep else 1
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1).withColumn("_run", F.floor(F.col("_at") / length)).withColumn("_step", F.col("_at") % length + 1)
    start = rows.groupBy(*by).agg(F.min("_block").alias("_start"))
    head = (F.col("_block") == F.col("_start")) & (F.col("_at") == 0)
    x = F.col(value).cast("double")
    rows = with_groups(rows, start, by).withColumn("_b", F.when(head, x).otherwise(alpha * x))
    run = [*by, "_block", "_run"]
    so_far = Window.partitionBy(*run).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(keep), F.col("_step")) if keep else F.lit(1.0)
    # the value's weight within its run is keep ^ (steps after it)
    local = F.sum(F.col("_b") / scale).over(so_far) * scale if keep else F.col("_b")
    rows = rows.withColumn("_local", local)

    order = Window.partitionBy(*by).orderBy("_block", "_run")
    maps = rows.groupBy(*run).agg(F.count("*").alias("_n"), F.max_by("_local", "_step").alias("_b"), F.max(head.cast("int")).alias("_head"))
    maps = maps.select(*run, "_n", "_b", F.when(F.col("_head") == 1, 0.0).otherwise(F.pow(F.lit(keep), F.col("_n"))).alias("_a"))
    maps = cut(maps)
    most = maps.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    for k in range(max(0, math.ceil(math.log2(most)))):
        back = lambda c, d, k=k: F.lag(c, 1 << k, d).over(order)
        maps = maps.select(*run, (F.col("_n") + back("_n", 0)).alias("_n"), (F.col("_b") + F.when(F.col("_a") > 0, F.col("_a") * back("_b", 0.0)).otherwise(0.0)).alias("_b"), (F.col("_a") * back("_a", 1.0)).alias("_a"))
    arrives = maps.select(*run, F.lag("_b", 1, 0.0).over(order).alias("_in"), F.lag("_n", 1, 0).over(order).alias("_before"))
    names = {c: f"_of{k}" for k, c in enumerate(run)}
    right = arrives.withColumnsRenamed(names)
    same = reduce(Column.__and__, [rows[c].eqNullSafe(right[n]) for c, n in names.items()])
    done = rows.join(right, same)
    first = F.when((F.col("_before") == 0), 0.0).otherwise(F.col("_in"))
    done = done.withColumn(out, F.col("_local") + (scale if keep else F.lit(0.0)) * first).withColumn("pos", F.col("_before") + F.col("_step") - 1)
    return done.drop("_block", "_at", "_run", "_step", "_start", "_b", "_local", "_in", "_before", *names.values())


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q", accuracy: int = 10_000) -> DataFrame:
    """(by..., out): exact quantiles of a group's values, interpolated between neighbours; nulls and NaN take no part.

    A mergeable sketch brackets each quantile by values whose ranks are surely
    around its own; one pass counts what lies below and inside the bracket and
    finds the values next to it; only what lies inside is put in order, by how
    often each value occurs: about 4 of `accuracy` parts of a group.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows if written(df) else cut(rows)
    edge = 2 / accuracy
    asked = [max(0.0, p - edge) for p in probs] + [min(1.0, p + edge) for p in probs]
    near = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", F.array(*map(F.lit, asked)), accuracy).alias("_e"))
    m = len(probs)
    low = [F.col("_min") if p - edge <= 0 else F.col("_e")[k] for k, p in enumerate(probs)]
    high = [F.col("_max") if p + edge >= 1 else F.col("_e")[m + k] for k, p in enumerate(probs)]
    near = near.select(*by, "_n", F.array(*low).alias("_lo"), F.array(*high).alias("_hi"))
    beside = with_groups(rows, near, by)
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    counts = [f(k) for k in range(m) for f in (lambda k: F.count_if(v < lo[k]).alias(f"_below{k}"), lambda k: F.max(F.when(v < lo[k], v)).alias(f"_under{k}"), lambda k: F.min(F.when(v > hi[k], v)).alias(f"_over{k}"))]
    counted = beside.groupBy(*by).agg(F.any_value("_n").alias("_n"), *counts)
    held = beside.select(*by, "_v", F.explode(F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: v.between(F.get(lo, k), F.get(hi, k)))).alias("_k"))
    held = held.groupBy(*by, "_k", "_v").agg(F.count("*").alias("_c"))
    inside = held.withColumn("_up", F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    spots = counted.select(*by, F.posexplode(F.array(*[F.struct((F.floor(at[k]) - F.col(f"_below{k}")).alias("r"), (at[k] - F.floor(at[k])).alias("f"), F.col(f"_under{k}").alias("under"), F.col(f"_over{k}").alias("over")) for k in range(m)])).alias("_k", "_s"))
    names = {c: f"_of{k}" for k, c in enumerate([*by, "_k"])}
    right = spots.withColumnsRenamed(names)
    same = reduce(Column.__and__, [inside[c].eqNullSafe(right[n]) for c, n in names.items()])
    r, first = F.col("_s.r"), F.col("_up") - F.col("_c")
    found = inside.join(right, same).groupBy(*by, "_k", "_s").agg(
        F.max(F.when((first <= r) & (r < F.col("_up")), F.col("_v"))).alias("_x"), F.max(F.when((first <= r + 1) & (r + 1 < F.col("_up")), F.col("_v"))).alias("_y"), F.max("_up").alias("_size")
    )
    x = F.when(r < 0, F.col("_s.under")).otherwise(F.col("_x"))
    y = F.coalesce(F.when(r + 1 >= F.col("_size"), F.col("_s.over")).otherwise(F.col("_y")), x)
    f = F.col("_s.f")
    # between equal neighbours nothing is weighed: rounded weights could lead a hair below the value
    between = F.when((f == 0) | (x == y), x).otherwise((1 - f) * x + f * y)
    sure = F.when((r >= -1) & (r < F.col("_size")), between).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", sure.alias("q")))), lambda s: s["q"]).alias(out))
