"""Regression diffs between rating tables, anomaly detectors over pipeline runs, and checks across seasons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .platform import last_against_rest, set_changes, severity, trust
from .quality import orphans, report
from .ordered import quantiles
from .windows import place, rank_average


@dataclass(frozen=True)
class DiffLimits:
    """Warning and critical limits of a regression diff."""

    rho: tuple[float, float] = (0.97, 0.95)
    top10: tuple[int, int] = (9, 8)
    top20: tuple[int, int] = (18, 16)
    large: float = 0.15
    large_share: tuple[float, float] = (0.05, 0.10)
    mean: tuple[float, float] = (0.05, 0.10)
    sd: tuple[float, float] = (0.08, 0.15)
    p95: tuple[float, float] = (0.08, 0.15)
    top: tuple[float, float] = (0.03, 0.05)
    common: float = 0.90


def regression_diff(old: DataFrame, new: DataFrame, key: str, value: str, limits: DiffLimits | None = None) -> DataFrame:
    """One row that compares two tables of (key, value) and a verdict: SAFE, WARNING or CRITICAL."""
    lim = limits or DiffLimits()
    a, b = old.select(key, F.col(value).alias("x")), new.select(key, F.col(value).alias("y"))
    # read by ranks, quantiles and counts: written once, so that the tables are made once
    both = cut(a.join(b, key, "full"))
    pairs = both.filter("x is not null and y is not null")
    ranked = rank_average(rank_average(pairs, "x", [], "_u", floor=False), "y", [], "_v", floor=False)
    placed = place(place(ranked, "x", [key], "_i"), "y", [key], "_j")
    shift = lambda f: F.abs(f("y") - f("x")) / F.nullif(F.abs(f("x")), F.lit(0.0))
    delta = F.abs(F.col("y") - F.col("x"))
    facts = placed.agg(
        F.corr("_u", "_v").alias("rho"),
        F.count_if((F.col("_i") <= 10) & (F.col("_j") <= 10)).alias("top10"),
        F.count_if((F.col("_i") <= 20) & (F.col("_j") <= 20)).alias("top20"),
        F.avg((delta >= lim.large).cast("double")).alias("large_share"),
        F.coalesce(F.max(F.when(F.col("_i") == 1, delta)), F.lit(0.0)).alias("top_delta"),
        F.coalesce(shift(F.avg), F.lit(0.0)).alias("mean_shift"),
        F.coalesce(shift(F.stddev_pop), F.lit(0.0)).alias("sd_shift"),
        F.count("*").alias("n"),
    )
    p95 = quantiles(both.filter("x is not null and y is not null").unpivot([], ["x", "y"], "_side", "_v"), ["_side"], "_v", [0.95])
    tail = lambda side: F.max(F.when(F.col("_side") == side, F.col("q")[0]))
    facts = facts.join(p95.agg(F.coalesce(shift(tail), F.lit(0.0)).alias("p95_shift")))
    share = both.agg((F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()) / F.greatest(F.count("x"), F.count("y"))).alias("common"))
    row = facts.join(share)
    short = lambda k: F.least(F.lit(1.0), F.col("n") / float(k))  # noqa: E731  short tables have shorter top lists

    def beyond(k: int):
        low = (F.col("rho") < lim.rho[k]) | (F.col("top10") < lim.top10[k] * short(10)) | (F.col("top20") < lim.top20[k] * short(20))
        high = [F.col(c) > getattr(lim, f)[k] for c, f in (("large_share", "large_share"), ("top_delta", "top"), ("mean_shift", "mean"), ("sd_shift", "sd"), ("p95_shift", "p95"))]
        return reduce(lambda x, y: x | y, high, low)

    return row.withColumn("verdict", F.when(beyond(1) | (F.col("common") < lim.common), "CRITICAL").when(beyond(0), "WARNING").otherwise("SAFE"))


@dataclass(frozen=True)
class Alarms:
    """Warning and critical levels of the detectors."""

    window_days: int = 14
    least: int = 5
    stale_hours: tuple[float, float] = (36, 96)
    backlog: tuple[float, float] = (20, 100)
    warn_share: tuple[float, float] = (0.2, 0.5)
    escalation: tuple[float, float] = (0.2, 0.4)
    escalation_least: int = 4
    drift: tuple[float, float] = (0.08, 0.15)


def alarm(rows: DataFrame, detector: str, levels: tuple[float, float]) -> DataFrame:
    """Findings of (stage, value) rows at or above the first level; confidence is the share of the second one reached."""
    v = F.col("value")
    return rows.filter(v >= levels[0]).select(F.lit(detector).alias("detector"), "stage", F.when(v >= levels[1], "critical").otherwise("warn").alias("severity"), F.least(F.lit(1.0), v / levels[1]).cast("double").alias("confidence"), v.cast("double").alias("value"))


def deviation(rows: DataFrame, detector: str) -> DataFrame:
    """Findings of (stage, z) rows."""
    z = F.col("z")
    return rows.filter(F.abs(z) >= 2.5).select(F.lit(detector).alias("detector"), "stage", severity(z).alias("severity"), trust(z).alias("confidence"), z.alias("value"))


def anomalies(runs: DataFrame, now: str, alarms: Alarms | None = None, expected: dict[str, int] | None = None, quarantine: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """(detector, stage, severity, confidence, value) over the window that ends now.

    runs: (run, stage, started, duration, failed, warned); quarantine: (source,
    at); ratings: (vintage, value). Detectors: duration of the last run of a
    stage, burst of its failures on the last day, hours since its last run, rows
    newly in quarantine, share of runs that warn or worse, its escalation from
    the first half of the window to the second, drift of the ratings' mean,
    deviation or 95th percentile between the last two vintages, and stages with
    fewer runs than expected.
    """
    lim = alarms or Alarms()
    at = F.lit(now).cast("timestamp_ntz")
    days = lambda n: F.expr(f"interval {int(n * 24)} hours")
    recent = runs.filter((F.col("started") >= at - days(lim.window_days)) & (F.col("started") <= at))
    enough = recent.groupBy("stage").agg(F.count("*").alias("n")).filter(F.col("n") > lim.least).select("stage")
    z = last_against_rest(recent.join(enough, "stage", "left_semi").withColumn("duration", F.col("duration").cast("double")), "stage", ["started", "run"], "duration")
    daily = recent.groupBy("stage", F.to_date("started").alias("day")).agg(F.count_if("failed").alias("n"))
    burst = last_against_rest(daily, "stage", ["day"], "n").filter("z >= 2.5")
    age = runs.groupBy("stage").agg((F.timestamp_diff("SECOND", F.max("started"), at) / 3600.0).alias("value"))
    late = F.col("started") >= at - days(lim.window_days / 2)
    share = recent.groupBy("stage").agg(F.avg(F.col("warned").cast("double")).alias("value"))
    halves = recent.groupBy("stage").agg(F.count("*").alias("n"), (F.avg(F.when(late, F.col("warned").cast("double"))) - F.avg(F.when(~late, F.col("warned").cast("double")))).alias("value"))
    found = [
        deviation(z, "duration"), deviation(burst, "failures"), alarm(age, "stale", lim.stale_hours), alarm(share, "warn_rate", lim.warn_share),
        alarm(halves.filter(F.col("n") >= lim.escalation_least), "escalation", lim.escalation),
    ]
    if quarantine is not None:
        new = quarantine.filter((F.col("at") >= at - days(lim.window_days)) & (F.col("at") <= at)).groupBy(F.col("source").alias("stage")).agg(F.count("*").cast("double").alias("value"))
        found.append(alarm(new, "quarantine", lim.backlog))
    if ratings is not None:
        figures = ratings.groupBy("vintage").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
        figures = figures.join(quantiles(ratings, ["vintage"], "value", [0.95]).select("vintage", F.col("q")[0].alias("p95")), "vintage")
        # one row a vintage
        order = Window.partitionBy(F.lit(0)).orderBy("vintage")
        moved = F.greatest(*[F.coalesce(F.abs(F.col(c) - F.lag(c).over(order)) / F.nullif(F.abs(F.lag(c).over(order)), F.lit(0.0)), F.lit(0.0)) for c in ("mean", "sd", "p95")])
        last = figures.withColumn("value", moved).agg(F.max_by("value", "vintage").alias("value")).select(F.lit("ratings").alias("stage"), "value")
        found.append(alarm(last, "drift", lim.drift))
    if expected:
        wanted = runs.sparkSession.createDataFrame(list(expected.items()), "stage string, wanted int")
        have = wanted.join(recent.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < wanted")
        found.append(have.select(F.lit("missing").alias("detector"), "stage", F.when(F.col("n") == 0, "critical").otherwise("warn").alias("severity"), F.lit(1.0).alias("confidence"), F.col("n").cast("double").alias("value")))
    return report(found)


def across_seasons(players: DataFrame, matches: DataFrame, ratings: DataFrame, coverage: DataFrame) -> DataFrame:
    """(check, severity, key, detail) over players (player_id, season, name, team, birth_date), matches (player_id, season), ratings (player_id, season, value) and coverage (season, pct).

    Seasons are integers. Names that share a word with the one before are
    information, others a warning; birth dates never change.
    """
    cast = lambda df, check, sev, key, detail: df.select(F.lit(check).alias("check"), (sev if not isinstance(sev, str) else F.lit(sev)).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    order = Window.partitionBy("player_id").orderBy("season")
    seen = players.select("*", *[F.lag(c).over(order).alias(f"_{c}") for c in ("name", "team", "birth_date")])
    share = F.arrays_overlap(F.split(F.lower("name"), " "), F.split(F.lower("_name"), " "))
    thin = coverage.filter("pct < 80")
    jump = ratings.withColumn("_before", F.lag("value").over(order)).withColumn("_d", F.abs(F.col("value") - F.col("_before"))).filter("_d >= 0.4")
    clubs = set_changes(players.select("season", "team").distinct(), "season", "team")
    lost = orphans(matches, "player_id", players.select("player_id").distinct(), "player_id").groupBy("player_id").agg(F.count("*").alias("n"))
    idle = players.join(matches.select("player_id", "season").distinct(), ["player_id", "season"], "left_anti")
    twice = players.groupBy("season", "name", "birth_date").agg(F.countDistinct("player_id").alias("n")).filter("n > 1 and birth_date is not null")
    return report([
        cast(thin, "coverage", F.when(F.col("pct") < 50, "critical").otherwise("warn"), F.col("season"), F.col("pct")),
        cast(seen.filter(F.col("_name").isNotNull() & (F.lower("name") != F.lower("_name"))), "name", F.when(share, "info").otherwise("warn"), F.col("player_id"), F.col("name")),
        cast(seen.filter("_birth_date is not null and birth_date <> _birth_date"), "birth_date", "critical", F.col("player_id"), F.col("birth_date")),
        cast(twice, "identity", "critical", F.col("name"), F.col("n")),
        cast(seen.filter("_team is not null and team <> _team"), "transfer", "info", F.col("player_id"), F.col("team")),
        cast(clubs, "club", "info", F.col("team"), F.col("change")),
        cast(lost, "orphan", F.when(F.sum("n").over(Window.partitionBy(F.lit(0))) < 10, "warn").otherwise("critical"), F.col("player_id"), F.col("n")),
        cast(idle, "idle", "info", F.col("player_id"), F.col("season")),
        cast(jump, "jump", F.when(F.col("_d") >= 0.8, "critical").otherwise("warn"), F.col("player_id"), F.round("_d", 4)),
    ])
