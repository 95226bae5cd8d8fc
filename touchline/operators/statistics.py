"""Resampling, folds, calibration and correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .ordered import quantiles, with_means


def quantile_bins(rows: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """1 plus the number of inner quantile edges below the value; equal edges leave bins empty."""
    edges = quantiles(rows, [], value, [k / bins for k in range(1, bins)], "_edges")
    return rows.join(edges).withColumn(out, (F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1).cast("int")).drop("_edges")


def fold(key: Column, folds: int) -> Column:
    return F.pmod(F.hash(key), F.lit(folds))


def cross_validated(rows: DataFrame, x: str, y: str, fold_: str) -> DataFrame:
    """rows with `predicted`: the line through all other folds, from sums of the whole less those of the fold."""
    sums = [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy")]
    own = rows.groupBy(fold_).agg(*sums)
    whole = Window.partitionBy(F.lit(0))
    rest = own.select(fold_, *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    lines = rest.select(fold_, slope.alias("_b"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("_a"))
    return rows.join(lines, fold_).withColumn("predicted", F.col("_a") + F.col("_b") * F.col(x)).drop("_a", "_b")


def uniform(*parts) -> Column:
    """A number from 0 to 1 that follows from its parts alone, so draws do not depend on partitions; 48 bits of an MD5 digest."""
    text = F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


#: chances that a Poisson(1) draw is at most 0, 1, 2, ...
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def poisson_one(u: Column) -> Column:
    """A Poisson(1) draw from a uniform one, by inverting the distribution function."""
    return sum(((u >= edge).cast("int") for edge in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def draws_of(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(n))))


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; null where a side does not vary."""
    a, b = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((a > 1e-9 * n * sxx) & (b > 1e-9 * n * syy), (n * sxy - sx * sy) / F.sqrt(a * b))


def bootstrap_correlation(rows: DataFrame, x: str, y: str, key: str, draws: int = 1000, seed: int = 42, level: float = 0.95, least: int = 5) -> DataFrame:
    """(n, estimate, low, high, draws): percentile interval of the correlation under Poisson weights by `key`.

    Rows with one key, such as those of a cluster, have one weight. Weights
    follow from draw and key, each draw is a handful of sums, and the interval is
    null with fewer than `least` rows or where half of the draws or more give no
    correlation.
    """
    many = draws_of(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, F.col(key).alias("_key")), draws)
    w = many.withColumn("_w", poisson_one(uniform(seed, F.col("_draw"), F.col("_key"))).cast("double"))
    a, b, c = F.col(x), F.col(y), F.col("_w")
    s = w.groupBy("_draw").agg(F.sum(c).alias("n"), F.sum(c * a).alias("sx"), F.sum(c * b).alias("sy"), F.sum(c * a * a).alias("sxx"), F.sum(c * b * b).alias("syy"), F.sum(c * a * b).alias("sxy"))
    r = correlation(*[F.col(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    tail = (1 - level) / 2
    spread = s.select(r.alias("r")).agg(F.percentile("r", F.lit(tail)).alias("low"), F.percentile("r", F.lit(1 - tail)).alias("high"), F.count("r").alias("draws"))
    seen = rows.agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.corr(x, y).alias("estimate"))
    enough = (F.col("n") >= least) & (F.col("draws") >= draws / 2)
    return seen.join(spread).select("n", "estimate", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), "draws")


def bootstrap_gain(rows: DataFrame, a: str, b: str, y: str, key: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(low, high): percentile interval of how much more a correlates with y than b, under the same weights."""
    many = draws_of(rows, draws).withColumn("_w", poisson_one(uniform(seed, F.col("_draw"), F.col(key))).cast("double"))
    w = F.col("_w")

    def sums(x: str):
        p, q = F.col(x), F.col(y)
        return [F.sum(w), F.sum(w * p), F.sum(w * q), F.sum(w * p * p), F.sum(w * q * q), F.sum(w * p * q)]

    drawn = many.groupBy("_draw").agg(*[c.alias(f"{x}{k}") for x in (a, b) for k, c in enumerate(sums(x))])
    r = [correlation(*[F.col(f"{x}{k}") for k in range(6)]) for x in (a, b)]
    return drawn.select((r[0] - r[1]).alias("g")).agg(F.percentile("g", F.lit(0.025)).alias("low"), F.percentile("g", F.lit(0.975)).alias("high"))


def by_chance(rows: DataFrame, u: Column, key: str, out: str, buckets: int = 64) -> DataFrame:
    """rows of each draw with their place by a uniform number: placed in parts of its range, after the sizes of the parts below."""
    parted = rows.withColumn("_u", u).withColumn("_part", F.floor(F.col("_u") * buckets))
    # one row a draw and part
    below = Window.partitionBy("_draw").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("_draw", "_part").agg(F.count("*").alias("_n")).select("_draw", "_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    order = Window.partitionBy("_draw", "_part").orderBy("_u", key)
    return parted.join(sizes, ["_draw", "_part"]).withColumn(out, F.row_number().over(order) + F.col("_below")).drop("_u", "_part", "_below")


def permutation(rows: DataFrame, x: str, y: str, key: str, draws: int = 500, seed: int = 42, least: int = 8) -> DataFrame:
    """(observed, null_mean, null_p95, p): the correlation against that of shuffled pairings; null with fewer than `least` rows.

    The k-th row by one chance takes its x, the k-th by another its y.
    """
    base = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    many = draws_of(base, draws)
    fixed = by_chance(many, uniform(seed, "x", F.col("_draw"), F.col(key)), key, "_k").select("_draw", "_k", x)
    moved = by_chance(many, uniform(seed, "y", F.col("_draw"), F.col(key)), key, "_k").select("_draw", "_k", y)
    r = fixed.join(moved, ["_draw", "_k"]).groupBy("_draw").agg(F.corr(x, y).alias("r"))
    seen = base.agg(F.corr(x, y).alias("observed"), F.count("*").alias("n"))
    found = r.join(seen).groupBy("observed", "n").agg(
        F.avg("r").alias("null_mean"), F.percentile(F.abs("r"), F.lit(0.95)).alias("null_p95"), ((F.count_if(F.abs("r") >= F.abs("observed")) + 1) / (F.count("r") + 1)).alias("p")
    )
    return found.select(*[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("observed", "null_mean", "null_p95", "p")])


def kendall(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(tau, n): tau-b, counting pairs that go against each other by halving the order of x.

    Each row goes once to each level of the halving; in a half pair, a right row
    counts the left rows with a larger y, in parts of the range of y with the
    sizes of the parts above; equal ys of a half are one row. No pair is ever made.
    """
    from .windows import rank_min, spread_by_value

    base = cut(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y))
    top = math.ceil(math.log2(base.count() + 1)) + 1
    ranked = spread_by_value(rank_min(base, x, "_r"), y)
    levels = ranked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top - 1))))
    levels = levels.withColumn("_group", F.expr("shiftright(_r, _level + 1)")).withColumn("_left", (F.expr("shiftright(_r, _level)") % 2).cast("long"))  # a larger x has the lower rank: it is the right half in ascending order
    keys = ["_level", "_group"]
    levels = levels.groupBy(*keys, "_bucket", y).agg(F.sum("_left").alias("_left"), F.sum(1 - F.col("_left")).alias("_right"))
    sizes = levels.groupBy(*keys, "_bucket").agg(F.sum("_left").alias("_n"))
    # one row a part of the range of y
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col(y).desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = levels.join(sizes, [*keys, "_bucket"]).withColumn("_larger", F.col("_above") + F.sum("_left").over(inside) - F.col("_left"))
    against = counted.agg(F.coalesce(F.sum((F.col("_larger") * F.col("_right")).cast("decimal(38,0)")), F.lit(0)).cast("double").alias("q"))

    def ties(*by):
        n = F.count("*").cast("decimal(38,0)")
        return base.groupBy(*by).agg((n * (n - 1) / 2).cast("double").alias("t")).agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("_".join(["t", *by])))

    n = base.agg(F.count("*").alias("n"))
    both = against.join(ties(x)).join(ties(y)).join(ties(x, y)).join(n)
    all_ = F.col("n") * (F.col("n") - 1) / 2
    tx, ty, txy = F.col(f"t_{x}"), F.col(f"t_{y}"), F.col(f"t_{x}_{y}")
    return both.select(F.try_divide(all_ - tx - ty + txy - 2 * F.col("q"), F.sqrt((all_ - tx) * (all_ - ty))).alias("tau"), "n")


def partial_spearman(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(rho, n): correlation of average ranks after each loses its group's mean."""
    from .windows import rank_average

    r = rank_average(rank_average(rows, x, [], "_x", floor=False), y, [], "_y", floor=False)
    r = with_means(cut(r), [group], {"_a": "_x", "_b": "_y"})
    r = r.withColumn("_u", F.col("_x") - F.col("_a")).withColumn("_v", F.col("_y") - F.col("_b"))
    return r.agg(F.corr("_u", "_v").alias("rho"), F.count("*").alias("n"))


def leave_one_out(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(low, high, spread) of the correlation when any one row is left out, from the sums less that row."""
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    own = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "syy": F.col(y) * F.col(y), "sxy": F.col(x) * F.col(y)}
    rows = rows.select(x, y)
    total = rows.agg(*[F.sum(own[k]).alias(k) for k in names])
    s = rows.join(total).select(*[(F.col(k) - own[k]).alias(k) for k in names])
    r = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))))
    return s.select(r.alias("r")).agg(F.min("r").alias("low"), F.max("r").alias("high"), (F.max("r") - F.min("r")).alias("spread"))


def principal_components(rows: DataFrame, columns: list[str], k: int):
    """(explained, components) of the standardised columns; the fit is a Spark job, what comes back is k x columns."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    full = VectorAssembler(inputCols=columns, outputCol="_raw").transform(rows.dropna(subset=columns))
    scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(full).transform(full)
    model = PCA(k=k, inputCol="_scaled", outputCol="_pc").fit(scaled)
    return model.explainedVariance.toArray().tolist(), model.pc.toArray().tolist()


def hypergeometric_tail(population: int, marked: int, drawn: int, k: int) -> float:
    """Chance of at least k marked among the drawn."""
    from math import comb

    return sum(comb(marked, i) * comb(population - marked, drawn - i) for i in range(k, min(marked, drawn) + 1)) / comb(population, drawn)


def fold_means(rows: DataFrame, y: str, fold_: str) -> DataFrame:
    """(fold, flat): the mean of all other folds."""
    own = rows.groupBy(fold_).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    whole = Window.partitionBy(F.lit(0))
    return own.select(fold_, ((F.sum("_s").over(whole) - F.col("_s")) / (F.sum("_n").over(whole) - F.col("_n"))).alias("flat"))


def skill_scores(rows: DataFrame, x: str, y: str, fold_: str, group: str) -> DataFrame:
    """(n, rmse, skill_persistence, skill_group): a line out of sample against y = x and against the group's mean of y; null with fewer than 10 rows."""
    told = with_means(cross_validated(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, fold_), [group], {"_mean": y})
    sse = lambda p: F.sum(F.pow(F.col(y) - F.col(p), 2))
    got = told.agg(F.count("*").alias("n"), sse("predicted").alias("model"), sse(x).alias("naive"), sse("_mean").alias("grouped"))
    skill = lambda c: F.when(F.col("n") >= 10, 1 - F.try_divide("model", F.nullif(F.col(c), F.lit(0.0))))
    return got.select("n", F.when(F.col("n") >= 10, F.sqrt(F.col("model") / F.col("n"))).alias("rmse"), skill("naive").alias("skill_persistence"), skill("grouped").alias("skill_group"))


def paired_rmse_bootstrap(rows: DataFrame, base: str, pro: str, y: str, key: str, fold_: str, draws: int = 1000, seed: int = 42, least: int = 12) -> DataFrame:
    """(n, rmse_base, rmse_pro, delta, low, high, better): out-of-sample errors of two signals on the same rows, the difference with its interval.

    Weights are Poisson by `key`: one for each row, or for each cluster.
    """
    rows = rows.filter(F.col(base).isNotNull() & F.col(pro).isNotNull() & F.col(y).isNotNull())
    told = cross_validated(cross_validated(rows, base, y, fold_).withColumnRenamed("predicted", "_p"), pro, y, fold_)
    errors = told.select(F.col(key).alias("_key"), F.pow(F.col(y) - F.col("_p"), 2).alias("a"), F.pow(F.col(y) - F.col("predicted"), 2).alias("b"))
    many = draws_of(errors, draws).withColumn("_w", poisson_one(uniform(seed, F.col("_draw"), F.col("_key"))).cast("double"))
    drawn = many.groupBy("_draw").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("a")).alias("a"), F.sum(F.col("_w") * F.col("b")).alias("b"))
    gap = F.sqrt(F.try_divide("a", F.nullif(F.col("n"), F.lit(0.0)))) - F.sqrt(F.try_divide("b", F.nullif(F.col("n"), F.lit(0.0))))
    spread = drawn.select(gap.alias("d")).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    seen = errors.agg(F.count("*").alias("n"), F.sqrt(F.avg("a")).alias("rmse_base"), F.sqrt(F.avg("b")).alias("rmse_pro"))
    row = seen.join(spread).withColumn("delta", F.col("rmse_base") - F.col("rmse_pro")).withColumn("better", F.col("low") > 0)
    return row.select("n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("rmse_base", "rmse_pro", "delta", "low", "high", "better")])


def moved_ranking(many: DataFrame, key: str, before: str, after: str, tops: tuple[int, ...] = (10, 20)) -> DataFrame:
    """(_draw, rho, top<k>...) of rankings by `after` against that by `before`, draw by draw.

    A draw is sorted in one task: its rows are the players of a season.
    """
    by = Window.partitionBy("_draw")
    placed = many.withColumn("_a", F.row_number().over(by.orderBy(F.col(before).desc(), key))).withColumn("_b", F.row_number().over(by.orderBy(F.col(after).desc(), key)))
    ranked = placed.withColumn("_x", F.rank().over(by.orderBy(before)) + (F.count("*").over(Window.partitionBy("_draw", before)) - 1) / 2).withColumn("_y", F.rank().over(by.orderBy(after)) + (F.count("*").over(Window.partitionBy("_draw", after)) - 1) / 2)
    return ranked.groupBy("_draw").agg(F.corr("_x", "_y").alias("rho"), *[(F.count_if((F.col("_a") <= k) & (F.col("_b") <= k)) / k).alias(f"top{k}") for k in tops])


def weight_sensitivity(rows: DataFrame, key: str, weights: dict[str, float], draws: int = 500, spread: float = 0.2, seed: int = 42, tops: tuple[int, int] = (10, 20)) -> DataFrame:
    """(median, low, least, top<k>, top<k>_least): agreement of the ranking with those under weights moved by up to +-spread.

    A missing score counts as the mean, 0; the moves follow from draw and name.
    """
    from functools import reduce

    value = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    many = draws_of(rows, draws)
    moved = {n: w * (1 + spread * (2 * uniform(seed, F.col("_draw"), n) - 1)) for n, w in weights.items()}
    whole = sum(weights.values())
    base = reduce(Column.__add__, [value(n) * (w / whole) for n, w in weights.items()])
    other = reduce(Column.__add__, [value(n) * w for n, w in moved.items()]) / reduce(Column.__add__, list(moved.values()))
    got = moved_ranking(many.select("_draw", key, base.alias("_v"), other.alias("_w")), key, "_v", "_w", tops)
    half = lambda c: F.percentile(c, F.lit(0.5))
    return got.agg(half("rho").alias("median"), F.percentile("rho", F.lit(0.05)).alias("low"), F.min("rho").alias("least"), *[f(f"top{k}").alias(f"top{k}{end}") for k in tops for f, end in ((half, ""), (F.min, "_least"))])


def role_weight_sensitivity(rows: DataFrame, key: str, score: str, role: str, weights: dict[str, float], draws: int = 500, spread: float = 0.2, seed: int = 42, top: int = 20) -> DataFrame:
    """(role, quota, quota_least, quota_most, median, overlap): what moves of the roles' weights do to who is among the best.

    The score has its role's weight in it; that is divided out and put back moved.
    """
    table = rows.sparkSession.createDataFrame(list(weights.items()), "_role string, _weight double")
    bare = rows.join(table, F.col(role) == F.col("_role")).select(key, F.col(role).alias("role"), F.col(score).alias("_v"), (F.col(score) / F.col("_weight")).alias("_bare"), "_weight")
    moved = 1 + spread * (2 * uniform(seed, F.col("_draw"), F.col("role")) - 1)
    many = draws_of(bare, draws).withColumn("_w", F.col("_bare") * F.col("_weight") * moved)
    by = Window.partitionBy("_draw")
    placed = many.withColumn("_a", F.row_number().over(by.orderBy(F.col("_v").desc(), key))).withColumn("_b", F.row_number().over(by.orderBy(F.col("_w").desc(), key)))
    quotas = placed.groupBy("_draw", "role").agg(F.count_if(F.col("_a") <= top).alias("q"), F.count_if(F.col("_b") <= top).alias("m"))
    quotas = quotas.groupBy("role").agg(F.max("q").alias("quota"), F.min("m").alias("quota_least"), F.max("m").alias("quota_most"))
    whole = moved_ranking(many, key, "_v", "_w", (top,)).agg(F.percentile("rho", F.lit(0.5)).alias("median"), F.percentile(f"top{top}", F.lit(0.5)).alias("overlap"))
    return quotas.join(whole)
