"""Queries over runs as a stream, and composed checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.operators import monitoring as M
from touchline.operators import statistics as S
from touchline.operators.cuts import cut, shared_folder
from touchline.operators.measures import mean
from touchline.streaming import keyed, monitor

from .binding import FACTS_SQL, RUNS_SQL, facts, fixtures, runs, table
from .registry import query
from .scans import LEADERBOARD_SQL, player_totals
from .statistics import PAIR_SQL, pairs, poisson_sql, rounded, uniform_sql


def scratch(spark) -> str:
    """A new folder among those that all executors share."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def arriving(spark, sf_dir):
    """(stream, folder): the events as files that arrive in a new folder."""
    folder = scratch(spark)
    stored = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    stored.write.parquet(f"{folder}/in")
    return monitor.read_events(spark, f"{folder}/in"), folder


@query("x_stream_daily_counts", "SELECT event_type AS stage, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def stream_daily(spark, sf_dir):
    """Daily counts by a stream with a watermark, as far as days are closed."""
    stream, folder = arriving(spark, sf_dir)
    monitor.drain(monitor.windowed_counts(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("stage", F.to_date("start").alias("day"), "n", "failures", "total")


@query("q8_closed_rounds", "WITH d AS (SELECT event_type AS stage, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) AS closing FROM events WHERE ts IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, greatest(CAST(day + 1 AS TIMESTAMP), closing + INTERVAL 2 HOUR) AS due FROM d) SELECT * FROM u WHERE due <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def closed_rounds(spark, sf_dir):
    """Rounds as a stream tells them: once each, by a timer of keyed state that then forgets them."""
    own = keyed.timers(spark)
    stream, folder = arriving(own, sf_dir)
    monitor.drain(keyed.closed_rounds(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("stage", "day", "n", "failures", "closing", "due")


@query("d25_sliding_counts", "WITH d AS (SELECT event_type AS stage, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2), w AS (SELECT stage, day - k AS start, n, failures, total FROM d, (SELECT unnest(range(0, 14))::INTEGER AS k)) SELECT stage, start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(total) AS DOUBLE) AS total FROM w WHERE CAST(start + 14 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    """Counts of 14 days from each day on, as far as they are closed; days are counted once and then put into windows."""
    stream, folder = arriving(spark, sf_dir)
    monitor.drain(keyed.sliding_counts(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("stage", F.to_date("start").alias("start"), "n", "failures", "total")


@query("d25_anomalies", f"""WITH {FACTS_SQL}, {RUNS_SQL}, w AS (SELECT *, size > 80 AND NOT (stage = 'view' AND day < DATE '2024-01-23') AS warned FROM r WHERE started >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY AND started <= TIMESTAMP '2024-01-30'),
 k AS (SELECT stage, CAST(duration AS DOUBLE) AS d, row_number() OVER (PARTITION BY stage ORDER BY started DESC, run DESC) AS k FROM w), z AS (SELECT stage, (max(d) FILTER (WHERE k = 1) - avg(d) FILTER (WHERE k > 1)) / nullif(stddev_pop(d) FILTER (WHERE k > 1), 0) AS z FROM k GROUP BY 1 HAVING count(*) > 5),
 dd AS (SELECT stage, day, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS n, row_number() OVER (PARTITION BY stage ORDER BY day DESC) AS k FROM w GROUP BY 1, 2), zb AS (SELECT stage, (max(n) FILTER (WHERE k = 1) - avg(n) FILTER (WHERE k > 1)) / nullif(stddev_pop(n) FILTER (WHERE k > 1), 0) AS z FROM dd GROUP BY 1),
 ag AS (SELECT stage, date_diff('second', max(started), TIMESTAMP '2024-01-30') / 3600.0 AS v FROM r GROUP BY 1), sh AS (SELECT stage, count(*) AS n, avg(warned::INT) AS v, avg(warned::INT) FILTER (WHERE started >= TIMESTAMP '2024-01-23') - avg(warned::INT) FILTER (WHERE started < TIMESTAMP '2024-01-23') AS e FROM w GROUP BY 1),
 qu AS (SELECT stage, count(*) AS v FROM w WHERE CAST(duration AS DOUBLE) > 130 GROUP BY 1), ra AS (SELECT season, CAST(xg AS DOUBLE) * CASE WHEN season = 2001 THEN 1.1 ELSE 1 END AS v FROM f), fi AS (SELECT season, avg(v) AS a, stddev_pop(v) AS b, quantile_cont(v, 0.95) AS c FROM ra GROUP BY 1), dr AS (SELECT season, greatest(abs(a / lag(a) OVER o - 1), abs(b / lag(b) OVER o - 1), abs(c / lag(c) OVER o - 1)) AS v FROM fi WINDOW o AS (ORDER BY season))
 SELECT 'duration' AS detector, stage, CASE WHEN abs(z) >= 4 THEN 'critical' ELSE 'warn' END AS severity, round(z, 5) AS value FROM z WHERE abs(z) >= 2.5
 UNION ALL SELECT 'failures', stage, CASE WHEN z >= 4 THEN 'critical' ELSE 'warn' END, round(z, 5) FROM zb WHERE z >= 2.5
 UNION ALL SELECT 'stale', stage, CASE WHEN v >= 96 THEN 'critical' ELSE 'warn' END, round(v, 5) FROM ag WHERE v >= 36
 UNION ALL SELECT 'warn_rate', stage, CASE WHEN v >= 0.5 THEN 'critical' ELSE 'warn' END, round(v, 5) FROM sh WHERE v >= 0.15
 UNION ALL SELECT 'escalation', stage, CASE WHEN e >= 0.4 THEN 'critical' ELSE 'warn' END, round(e, 5) FROM sh WHERE n >= 4 AND e >= 0.15
 UNION ALL SELECT 'quarantine', stage, CASE WHEN v >= 100 THEN 'critical' ELSE 'warn' END, CAST(v AS DOUBLE) FROM qu WHERE v >= 20
 UNION ALL SELECT 'drift', 'ratings', CASE WHEN v >= 0.15 THEN 'critical' ELSE 'warn' END, round(v, 5) FROM dr WHERE season = (SELECT max(season) FROM dr) AND v >= 0.08
 UNION ALL SELECT 'missing', s.stage, CASE WHEN n = 0 THEN 'critical' ELSE 'warn' END, CAST(n AS DOUBLE) FROM (SELECT v.stage, count(w.run) AS n FROM (VALUES ('signup'), ('nothing')) AS v(stage) LEFT JOIN w ON w.stage = v.stage GROUP BY 1) s WHERE n < 100000""")
def d25(spark, sf_dir):
    """All eight detectors; a tenth more is put on the last season's ratings, so that there is a drift to find."""
    r = runs(spark, sf_dir).withColumn("warned", (F.col("size") > 80) & ~((F.col("stage") == "view") & (F.col("day") < F.lit("2024-01-23").cast("date"))))
    held = r.filter("duration > 130").select(F.col("stage").alias("source"), F.col("started").alias("at"))
    rated = facts(spark, sf_dir).select(F.col("season").alias("vintage"), (F.col("xg").cast("double") * F.when(F.col("season") == 2001, 1.1).otherwise(1.0)).alias("value"))
    found = M.anomalies(r, "2024-01-30 00:00:00", M.Alarms(warn_share=(0.15, 0.5), escalation=(0.15, 0.4)), {"signup": 100000, "nothing": 100000}, held, rated)
    return found.select("detector", "stage", "severity", F.round("value", 5).alias("value"))


@query("d24_verdicts", "SELECT * FROM (VALUES ('same', 'SAFE'), ('doubled', 'CRITICAL'), ('turned', 'CRITICAL')) AS t(change, verdict)")
def d24_verdicts(spark, sf_dir):
    """The verdict on a table that is the same, doubled, and turned round."""
    old = cut(player_totals(spark, sf_dir).select("player", (F.col("xg") * 90 / F.col("mins")).alias("v")))
    changes = {"same": F.col("v"), "doubled": F.col("v") * 2, "turned": -F.col("v")}
    parts = [M.regression_diff(old, old.withColumn("v", c), "player", "v").select(F.lit(name).alias("change"), "verdict") for name, c in changes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("d22_suite", f"""WITH {FACTS_SQL}, q AS (SELECT player, season, arg_max(opp, (m, -opp)) AS team FROM (SELECT player, season, opp, sum(mins) AS m FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2),
 g AS (SELECT player, season, team, CASE WHEN player % 25 = 3 THEN 'one name' WHEN (player + season) % 7 = 0 THEN 'Other ' || player WHEN (player + season) % 9 = 0 THEN 'Nobody' ELSE 'p ' || player END AS name, CASE WHEN player % 25 = 3 THEN 'd' ELSE CAST(player + CASE WHEN (player + season) % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS born FROM q),
 l AS (SELECT *, lag(team) OVER o AS bt, lag(name) OVER o AS bn, lag(born) OVER o AS bb FROM g WINDOW o AS (PARTITION BY player ORDER BY season)),
 ma AS (SELECT DISTINCT CASE WHEN player % 17 = 0 THEN player + 5000 ELSE player END AS player, season FROM f WHERE (player + season) % 19 <> 0),
 lo AS (SELECT player, count(*) AS n FROM ma WHERE player NOT IN (SELECT player FROM g) GROUP BY 1),
 v AS (SELECT player, season, round(CAST(sum(xg) AS DOUBLE) / count(*), 6) AS v FROM f GROUP BY 1, 2), j AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY player ORDER BY season)) AS d FROM v),
 co AS (SELECT x.season, 100.0 * count(s.fixture) / count(*) AS pct FROM x LEFT JOIN (SELECT DISTINCT fixture FROM f) s ON x.fixture = s.fixture GROUP BY 1), tm AS (SELECT DISTINCT season, team FROM g), en AS (SELECT min(season) AS a, max(season) AS b FROM tm)
 SELECT 'coverage' AS "check", CASE WHEN pct < 50 THEN 'critical' ELSE 'warn' END AS severity, count(*) AS n FROM co WHERE pct < 80 GROUP BY 2
 UNION ALL SELECT 'name', CASE WHEN len(list_intersect(string_split(lower(name), ' '), string_split(lower(bn), ' '))) > 0 THEN 'info' ELSE 'warn' END, count(*) FROM l WHERE lower(name) <> lower(bn) GROUP BY 2
 UNION ALL SELECT 'birth_date', 'critical', count(*) FROM l WHERE born <> bb HAVING count(*) > 0
 UNION ALL SELECT 'identity', 'critical', count(*) FROM (SELECT season, name, born FROM g GROUP BY ALL HAVING count(DISTINCT player) > 1) HAVING count(*) > 0
 UNION ALL SELECT 'transfer', 'info', count(*) FROM l WHERE bt <> team HAVING count(*) > 0
 UNION ALL SELECT 'club', 'info', count(*) FROM (SELECT season, team FROM tm, en WHERE season > a AND NOT EXISTS (SELECT 1 FROM tm t WHERE t.team = tm.team AND t.season = tm.season - 1) UNION ALL SELECT season + 1, team FROM tm, en WHERE season < b AND NOT EXISTS (SELECT 1 FROM tm t WHERE t.team = tm.team AND t.season = tm.season + 1)) HAVING count(*) > 0
 UNION ALL SELECT 'orphan', CASE WHEN (SELECT sum(n) FROM lo) < 10 THEN 'warn' ELSE 'critical' END, count(*) FROM lo HAVING count(*) > 0
 UNION ALL SELECT 'idle', 'info', count(*) FROM g WHERE NOT EXISTS (SELECT 1 FROM ma WHERE ma.player = g.player AND ma.season = g.season) HAVING count(*) > 0
 UNION ALL SELECT 'jump', CASE WHEN d >= 0.8 THEN 'critical' ELSE 'warn' END, count(*) FROM j WHERE d >= 0.4 GROUP BY 2""")
def d22_suite(spark, sf_dir):
    """Findings of all nine checks, counted; names, birth dates, matches and twins are planted in the registry."""
    return season_findings(spark, sf_dir).groupBy("check", "severity").agg(F.count("*").alias("n"))


def coverage_of(games, rows):
    """(season, pct): the share of a season's fixtures that have facts."""
    seen = rows.select("fixture").distinct().withColumn("seen", F.lit(1))
    return games.join(seen, "fixture", "left").groupBy("season").agg((100.0 * F.count("seen") / F.count("*")).alias("pct"))


def season_findings(spark, sf_dir):
    rows = facts(spark, sf_dir)
    team = rows.groupBy("player", "season", "opp").agg(F.sum("mins").alias("m")).groupBy("player", "season").agg(F.max_by("opp", F.struct("m", -F.col("opp"))).alias("team"))
    k, both = F.col("player"), F.col("player") + F.col("season")
    name = F.when(k % 25 == 3, "one name").when(both % 7 == 0, F.concat(F.lit("Other "), k)).when(both % 9 == 0, "Nobody").otherwise(F.concat(F.lit("p "), k))
    born = F.when(k % 25 == 3, "d").otherwise((k + (both % 11 == 0).cast("int")).cast("string"))
    registry = team.select(k.alias("player_id"), "season", name.alias("name"), "team", born.alias("birth_date"))
    matches = rows.filter(both % 19 != 0).select(F.when(k % 17 == 0, k + 5000).otherwise(k).alias("player_id"), "season").distinct()
    ratings = rows.groupBy(F.col("player").alias("player_id"), "season").agg(F.round(mean("xg"), 6).alias("value"))
    return M.across_seasons(registry, matches, ratings, coverage_of(fixtures(spark, sf_dir), rows))


@query("m20_components", f"{LEADERBOARD_SQL}, r AS (SELECT corr(g / m, h / m) AS a, corr(g / m, q / m) AS b, corr(h / m, q / m) AS c FROM (SELECT a.*, (SELECT sum(goal) FROM f WHERE f.player = a.player AND mins > 0) AS q FROM a)), w AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM r), v AS (SELECT p, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS t FROM w), e AS (SELECT 1 + 2 * p * cos(t) AS x, 1 + 2 * p * cos(t + 2 * pi() / 3) AS z FROM v) SELECT 1 AS component, round(x / 3, 6) AS explained FROM e UNION ALL SELECT 2, round((3 - x - z) / 3, 6) FROM e UNION ALL SELECT 3, round(z / 3, 6) FROM e")
def m20(spark, sf_dir):
    """Explained share of the components of three rates; the SQL has the roots of the correlation matrix in closed form."""
    rows = player_totals(spark, sf_dir).select((F.col("xg") / F.col("mins")).alias("a"), (F.col("xa") / F.col("mins")).alias("b"), (F.col("goals") / F.col("mins")).alias("c"))
    explained, _ = S.principal_components(rows, ["a", "b", "c"], 3)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(explained, 1)], "component int, explained double")


@query("m16_hypergeometric", f"{LEADERBOARD_SQL}, n AS (SELECT count(*) AS n FROM a), c AS (SELECT count(*) AS k FROM (SELECT player FROM a ORDER BY g DESC, player LIMIT 20) JOIN (SELECT player FROM a ORDER BY h DESC, player LIMIT 20) USING (player)), lc AS (SELECT n, k, least(20, n) AS t FROM n, c) SELECT k AS common, round(t * t / CAST(n AS DOUBLE), 6) AS expected, round(list_sum(list_transform(range(k, t + 1), lambda i: exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + lgamma(n - t + 1) - lgamma(t - i + 1) - lgamma(n - 2 * t + i + 1) - lgamma(n + 1) + lgamma(t + 1) + lgamma(n - t + 1)))), 6) AS p FROM lc")
def m16(spark, sf_dir):
    """Chance that two top lists of 20 out of all players share as many as they do, were they independent."""
    from touchline.operators.joins import top_overlap

    t = player_totals(spark, sf_dir)
    n, common = t.count(), top_overlap(t, "player", "xg", "xa", 20).first()["common"]
    k = min(20, n)
    return spark.createDataFrame([(common, round(k * k / n, 6), round(S.hypergeometric_tail(n, k, k, common), 6))], "common long, expected double, p double")


PAIRED_SQL = """w AS (SELECT *, player % 5 AS k FROM z), l AS (SELECT f.k, regr_slope(w.y, w.x) AS b, regr_intercept(w.y, w.x) AS c, regr_slope(w.y, w.p) AS bp, regr_intercept(w.y, w.p) AS cp FROM (SELECT DISTINCT k FROM w) f JOIN w ON w.k <> f.k GROUP BY 1),
 er AS (SELECT player, team, pow(y - (c + b * x), 2) AS a, pow(y - (cp + bp * p), 2) AS b FROM w JOIN l USING (k))"""


def paired_sql(key: str, draws: int) -> str:
    u = uniform_sql("'42'", "CAST(d AS VARCHAR)", f"CAST({key} AS VARCHAR)")
    return f"""dr AS (SELECT unnest(range(1, {draws + 1})) AS d), dw AS (SELECT d, a, b, {poisson_sql(u)} AS w FROM er CROSS JOIN dr), dg AS (SELECT sqrt(sum(w * a) / sum(w)) - sqrt(sum(w * b) / sum(w)) AS g FROM dw GROUP BY d HAVING sum(w) > 0)
 SELECT (SELECT count(*) FROM er) AS n, (SELECT round(sqrt(avg(a)), 6) FROM er) AS rmse_base, (SELECT round(sqrt(avg(b)), 6) FROM er) AS rmse_pro, (SELECT round(sqrt(avg(a)) - sqrt(avg(b)), 6) FROM er) AS delta, round(quantile_cont(g, 0.025), 6) AS low, round(quantile_cont(g, 0.975), 6) AS high, quantile_cont(g, 0.025) > 0 AS better FROM dg"""


@query("m21_paired_rmse", f"{PAIR_SQL.replace('AS y FROM p JOIN', 'AS y, (g + 0.5 * h) * 90 / m AS p FROM p JOIN')}, {PAIRED_SQL}, {paired_sql('player', 200)}")
def m21(spark, sf_dir):
    """How much less one signal errs out of sample than another on the same players, with the interval of the difference."""
    rows = pairs(spark, sf_dir).withColumn("p", F.col("x") + 0.5 * F.col("y")).withColumn("k", F.col("player") % 5)
    return rounded(S.paired_rmse_bootstrap(rows, "x", "p", "y", "player", "k", 200), "rmse_base", "rmse_pro", "delta", "low", "high")


def moved_sql(score: str, other: str, tops: str) -> str:
    return f"pl AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY {score} DESC, player) AS a, row_number() OVER (PARTITION BY d ORDER BY {other} DESC, player) AS b, rank() OVER (PARTITION BY d ORDER BY {score}) + (count(*) OVER (PARTITION BY d, {score}) - 1) / 2.0 AS x, rank() OVER (PARTITION BY d ORDER BY {other}) + (count(*) OVER (PARTITION BY d, {other}) - 1) / 2.0 AS y FROM mv), pd AS (SELECT d, corr(x, y) AS rho, {tops} FROM pl GROUP BY 1)"


@query("m23_weight_sensitivity", f"{PAIR_SQL}, dr AS (SELECT unnest(range(1, 101)) AS d), mw AS (SELECT d, 0.32 * (1 + 0.2 * (2 * {uniform_sql(chr(39) + '42' + chr(39), 'CAST(d AS VARCHAR)', chr(39) + 'x' + chr(39))} - 1)) AS wx, 0.20 * (1 + 0.2 * (2 * {uniform_sql(chr(39) + '42' + chr(39), 'CAST(d AS VARCHAR)', chr(39) + 'y' + chr(39))} - 1)) AS wy FROM dr), mv AS (SELECT d, player, x * (0.32::DOUBLE / 0.52::DOUBLE) + y * (0.20::DOUBLE / 0.52::DOUBLE) AS s, (x * wx + y * wy) / (wx + wy) AS t FROM z CROSS JOIN mw), {moved_sql('s', 't', 'count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0 AS t10, count(*) FILTER (WHERE a <= 20 AND b <= 20) / 20.0 AS t20')} SELECT round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.05), 6) AS low, round(min(rho), 6) AS least, round(quantile_cont(t10, 0.5), 6) AS top10, CAST(min(t10) AS DOUBLE) AS top10_least, round(quantile_cont(t20, 0.5), 6) AS top20, CAST(min(t20) AS DOUBLE) AS top20_least FROM pd")
def m23(spark, sf_dir):
    got = S.weight_sensitivity(pairs(spark, sf_dir).select("player", "x", "y"), "player", {"x": 0.32, "y": 0.20}, 100)
    return rounded(got, "median", "low", "least", "top10", "top20")


