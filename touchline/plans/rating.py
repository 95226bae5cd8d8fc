"""Aggregations, windows and the rating."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import rating as R
from touchline.operators import vintages as V
from touchline.operators.cuts import kept
from touchline.operators.measures import argmax, consistency, mean, per90, total, weighted_mean
from touchline.operators.ordered import quantiles, running, with_groups, with_means
from touchline.operators.windows import ewma_series, last_n, place, rank_average, rank_min, robust_z, spearman

from .binding import FACTS_SQL, MATCHES_SQL, PLAYERS_SQL, RUNS_SQL, facts, matches, players, runs
from .registry import query
from .scans import LEADERBOARD_SQL, player_totals

KEYS = ("ship", "fixture", "line", "part")
ORDER = "ship, fixture, line, part"
SOS_SQL = "m AS (SELECT opp AS team, CAST(sum(xg) AS DOUBLE) / count(*) AS v FROM f GROUP BY 1), s AS (SELECT team, v / (SELECT round(avg(v), 12) FROM m) AS sos FROM m)"
VALUE = "CAST(xg + xa AS DOUBLE) * 90 / mins"


#: the whole index of one season, one table a step; ages, injuries and days out follow from the player's number
SEASON_SQL = f"""{FACTS_SQL}, {MATCHES_SQL.replace("WHERE mins > 0", "WHERE mins > 0 AND season = 1997")},
t AS (SELECT team, fixture, rnd, opp, venue, sum(xg) AS tx FROM m GROUP BY ALL),
co AS (SELECT opp AS team, CAST(sum(tx) AS DOUBLE) / count(*) AS v FROM t GROUP BY 1),
so AS (SELECT team, v / (SELECT round(avg(v), 12) FROM co) AS sos FROM co),
st AS (SELECT team FROM (SELECT team, sum(goal) AS g FROM m GROUP BY 1) ORDER BY g DESC, team LIMIT 6),
ti AS (SELECT team, row_number() OVER (ORDER BY sos, team) AS k FROM so QUALIFY k <= 7),
tc AS (SELECT *, least(1 / sos, 10) AS w, least(1 / sos, 10) * CAST(tx AS DOUBLE) AS wx FROM (SELECT t.*, coalesce(so.sos, 1) AS sos, unnest(list_filter(['total', venue, CASE WHEN t.opp <> t.team AND t.opp IN (SELECT team FROM st) THEN 'vs_strong' END, CASE WHEN t.opp <> t.team AND a.k - CASE WHEN b.k < a.k THEN 1 ELSE 0 END <= 6 THEN 'vs_tight' END], lambda x: x IS NOT NULL)) AS ctx
  FROM t LEFT JOIN so ON t.opp = so.team LEFT JOIN ti a ON a.team = t.opp LEFT JOIN ti b ON b.team = t.team)),
tt AS (SELECT team, ctx, count(*) AS tn, sum(w) AS tw, sum(wx) AS twx FROM tc GROUP BY 1, 2),
pc AS (SELECT player, m.team, role, tc.ctx, count(*) AS n, CAST(sum(mins) AS BIGINT) AS mins, CAST(sum(xg + xa) AS DOUBLE) AS own, CAST(sum(bu) AS DOUBLE) AS bu, CAST(sum(tc.tx) AS DOUBLE) AS tx, avg(tc.sos) AS sos, sum(tc.w) AS w, sum(tc.wx) AS wx,
  CASE WHEN count(*) >= 6 THEN avg(CAST(xg + xa AS DOUBLE) * 90 / mins) / (avg(CAST(xg + xa AS DOUBLE) * 90 / mins) + stddev_samp(CAST(xg + xa AS DOUBLE) * 90 / mins)) END AS consistency
  FROM m JOIN tc ON m.team = tc.team AND m.fixture = tc.fixture GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
wh AS (SELECT player, count(*) AS games, CAST(sum(mins) AS BIGINT) AS sm, min(rnd) >= 2 AS winter, min(rnd) AS first, count(DISTINCT rnd) AS played, (SELECT count(DISTINCT rnd) FROM m) AS rounds FROM m GROUP BY 1),
pr AS (SELECT ctx, coalesce(sum(own) FILTER (WHERE role IN ('FWD', 'MID')) / nullif(sum(tx) FILTER (WHERE role IN ('FWD', 'MID')), 0), 0.15) AS prior FROM pc GROUP BY 1),
d0 AS (SELECT player, role, ctx, n, mins, games, sm, winter, own / mins * 90 / sos AS output, bu / mins * 90 / sos AS buildup, consistency,
  CASE WHEN tx > 0 THEN (own + prior * k) / (tx + k) * 100 END AS centrality,
  CASE WHEN tn - n >= 6 AND wx > 0 AND twx - wx >= 1e-9 THEN exp(ln((wx / w) / ((twx - wx) / (tw - w))) * (tn - n) / (tn - n + 8.0)) END AS boost
  FROM (SELECT *, 12 * CASE WHEN winter THEN 1.8 ELSE 1 END * least(games / CAST(n AS DOUBLE), 8) AS k FROM pc JOIN wh USING (player) JOIN tt USING (team, ctx) JOIN pr USING (ctx))),
d AS (SELECT * REPLACE ((mins * output + kk * avg(output) OVER c) / (mins + kk) AS output, (mins * buildup + kk * avg(buildup) OVER c) / (mins + kk) AS buildup)
  FROM (SELECT *, 600 * greatest(1, least(3, greatest(least(2.5, greatest(1, 75 / greatest(30, least(90, CAST(sm AS DOUBLE) / games)))), least(3, greatest(1, 30.0 / games))))) AS kk FROM d0) WINDOW c AS (PARTITION BY role, ctx)),
l AS (UNPIVOT (SELECT player, role, ctx, output, buildup, centrality, boost, consistency FROM d) ON output, buildup, centrality, boost, consistency INTO NAME metric VALUE v),
le AS (SELECT ctx, role, metric, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM l GROUP BY 1, 2, 3),
ls AS (SELECT ctx, role, metric, count(*) AS n, avg(least(greatest(v, lo), hi)) AS mu, stddev_samp(least(greatest(v, lo), hi)) AS sd FROM l JOIN le USING (ctx, role, metric) GROUP BY 1, 2, 3),
lz AS (SELECT player, role, ctx, metric, CASE WHEN n < 3 THEN NULL WHEN sd = 0 THEN 0 ELSE greatest(-3, least(3, (v - mu) / sd)) END AS z FROM (SELECT l.*, CASE WHEN own.n < 6 THEN al.n ELSE own.n END AS n, CASE WHEN own.n < 6 THEN al.mu ELSE own.mu END AS mu, CASE WHEN own.n < 6 THEN al.sd ELSE own.sd END AS sd
  FROM l JOIN ls own USING (ctx, role, metric) LEFT JOIN ls al ON al.ctx = 'total' AND al.role = l.role AND al.metric = l.metric)),
zz AS (SELECT d.player, d.role, d.ctx, max(z) FILTER (WHERE metric = 'output') AS output, max(z) FILTER (WHERE metric = 'buildup') AS buildup, max(z) FILTER (WHERE metric = 'centrality') AS centrality, max(z) FILTER (WHERE metric = 'boost') AS boost, max(z) FILTER (WHERE metric = 'consistency') AS consistency
  FROM d LEFT JOIN lz USING (player, role, ctx) GROUP BY 1, 2, 3),
sk AS (SELECT player, CASE WHEN sx > 0 THEN (g - sx) / sqrt(sx) END AS finishing, e AS form, CASE WHEN len(vs) >= 5 THEN e / list_avg(vs) - 1 END AS trend FROM (SELECT *, list_reduce(vs, lambda s, x: 0.3 * x + 0.7 * s) AS e FROM (SELECT player, CAST(sum(xg) AS DOUBLE) AS sx, sum(goal) AS g, list(CAST(xg + xa AS DOUBLE) * 90 / mins ORDER BY rnd, fixture) AS vs FROM m GROUP BY 1))),
bo AS (SELECT s_suppkey AS player, CAST(16 + s_suppkey % 20 AS DOUBLE) AS age, s_suppkey % 5 AS injuries, s_suppkey % 7 * 10 AS days FROM supplier),
w0 AS (SELECT d.player, d.role, wh.* EXCLUDE (player), CASE WHEN wh.winter THEN rounds - first + 1 ELSE rounds END AS available, finishing, form, trend, age, injuries, days FROM d JOIN wh USING (player) JOIN sk USING (player) LEFT JOIN bo USING (player) WHERE ctx = 'total'),
w1 AS (SELECT *, CASE WHEN age BETWEEN 15 AND 45 THEN 0.55 * exp(-0.5 * pow((age - 23) / 3.5, 2)) + 0.25 * greatest(0, least(1, (23 - age) / 5)) + 0.20 * CASE WHEN age <= 27 THEN 1 ELSE greatest(0, 1 - (age - 27) * 0.06) END END AS age_index,
  CASE WHEN available >= 8 THEN 0.5 * least(1, played / CAST(available AS DOUBLE)) + 0.3 * greatest(0, 1 - least(injuries, 6) * 0.15) + 0.2 * greatest(0, 1 - days / 90.0) END AS reliability FROM w0),
ul AS (UNPIVOT (SELECT player, role, finishing, form, trend, age_index, reliability FROM w1) ON finishing, form, trend, age_index, reliability INTO NAME metric VALUE v),
ue AS (SELECT role, metric, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM ul GROUP BY 1, 2),
us AS (SELECT role, metric, count(*) AS n, avg(least(greatest(v, lo), hi)) AS mu, stddev_samp(least(greatest(v, lo), hi)) AS sd FROM ul JOIN ue USING (role, metric) GROUP BY 1, 2),
uz AS (SELECT player, metric, CASE WHEN n < 3 THEN NULL WHEN sd = 0 THEN 0 ELSE greatest(-3, least(3, (v - mu) / sd)) END AS z FROM ul JOIN us USING (role, metric)),
uw AS (SELECT player, max(z) FILTER (WHERE metric = 'finishing') AS finishing, max(z) FILTER (WHERE metric = 'form') AS form, max(z) FILTER (WHERE metric = 'trend') AS trend, max(z) FILTER (WHERE metric = 'age_index') AS age_index, max(z) FILTER (WHERE metric = 'reliability') AS reliability FROM uz GROUP BY 1),
rw AS (SELECT *, (coalesce(output, 0) * 0.32 + coalesce(buildup, 0) * 0.10 + coalesce(centrality, 0) * 0.18 + coalesce(boost, 0) * 0.05 + coalesce(consistency, 0) * 0.07 + coalesce(finishing, 0) * 0.20 + coalesce(form, 0) * 0.11)
  / nullif((output IS NOT NULL)::INT * 0.32::DOUBLE + (buildup IS NOT NULL)::INT * 0.10::DOUBLE + (centrality IS NOT NULL)::INT * 0.18::DOUBLE + (boost IS NOT NULL)::INT * 0.05::DOUBLE + (consistency IS NOT NULL)::INT * 0.07::DOUBLE + (finishing IS NOT NULL)::INT * 0.20::DOUBLE + (form IS NOT NULL)::INT * 0.11::DOUBLE, 0) AS raw FROM zz JOIN uw USING (player)),
pe AS (SELECT *, CASE WHEN age <= 28 THEN raw END AS fit FROM (SELECT player, rw.role, raw, games, sm, played, available, age, round(pow(greatest(0, least(1, sm / p95)) * greatest(0.3, least(1, games / 30.0)) * greatest(0.4, least(1, CAST(sm AS DOUBLE) / games / 90)) * ((output IS NOT NULL)::INT + (buildup IS NOT NULL)::INT + (centrality IS NOT NULL)::INT + (boost IS NOT NULL)::INT + (consistency IS NOT NULL)::INT) / 5.0, 0.25), 3) AS confidence
  FROM rw JOIN w1 USING (player) CROSS JOIN (SELECT quantile_cont(sm, 0.95) AS p95 FROM w1) WHERE ctx = 'total')),
sb AS (SELECT player, -stddev_samp(raw) AS stability FROM rw GROUP BY 1),
mo AS (SELECT pe.player, pe.role, stability, CASE WHEN fitted >= 8 AND age < 24 THEN raw - (b * age + c) END AS momentum FROM pe JOIN sb USING (player) CROSS JOIN (SELECT regr_slope(fit, age) AS b, regr_intercept(fit, age) AS c, count(fit) AS fitted FROM pe)),
ml AS (UNPIVOT mo ON stability, momentum INTO NAME metric VALUE v),
me AS (SELECT role, metric, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM ml GROUP BY 1, 2),
ms AS (SELECT role, metric, count(*) AS n, avg(least(greatest(v, lo), hi)) AS mu, stddev_samp(least(greatest(v, lo), hi)) AS sd FROM ml JOIN me USING (role, metric) GROUP BY 1, 2),
mz AS (SELECT player, max(z) FILTER (WHERE metric = 'stability') AS stability, max(z) FILTER (WHERE metric = 'momentum') AS momentum FROM (SELECT player, metric, CASE WHEN n < 3 THEN NULL WHEN sd = 0 THEN 0 ELSE greatest(-3, least(3, (v - mu) / sd)) END AS z FROM ml JOIN ms USING (role, metric)) GROUP BY 1),
pw AS (SELECT * FROM (VALUES ('young', 0.55, 0.15, 0.05, 0.07, 0.05, 0.13), ('prime', 0.65, 0.10, 0.07, 0.07, 0.05, 0.06), ('veteran', 0.60, 0.04, 0.18, 0.08, 0.05, 0.05)) AS x(kind, a, b, c, d, e, f)),
pp AS (SELECT rw.player, rw.role, rw.ctx, rw.raw, pe.games, pe.sm, confidence, played, available, stability, momentum,
  (coalesce(rw.raw, 0) * a + coalesce(age_index, 0) * b + coalesce(reliability, 0) * c + coalesce(stability, 0) * d + coalesce(trend, 0) * e + coalesce(momentum, 0) * f)
  / nullif(CAST((rw.raw IS NOT NULL)::INT * a + (age_index IS NOT NULL)::INT * b + (reliability IS NOT NULL)::INT * c + (stability IS NOT NULL)::INT * d + (trend IS NOT NULL)::INT * e + (momentum IS NOT NULL)::INT * f AS DOUBLE), 0) AS pro
  FROM rw JOIN pe USING (player) LEFT JOIN mz USING (player) JOIN pw ON kind = CASE WHEN age < 23 THEN 'young' WHEN age >= 29 THEN 'veteran' ELSE 'prime' END),
fw AS (SELECT *, (greatest(0.3, least(0.7, greatest(0, least(1, played / CAST(available AS DOUBLE))))) - 0.3) / 0.4 * 0.15 + 0.85 AS penalty, CASE role WHEN 'FWD' THEN 1 WHEN 'MID' THEN 0.85 WHEN 'DEF' THEN 0.55 ELSE 0.20 END AS rolew, avg(raw) OVER (PARTITION BY role, ctx) AS mraw, avg(pro) OVER (PARTITION BY role, ctx) AS mpro FROM pp),
fx AS (SELECT *, round(round(rolew * (mraw + (0.35 + 0.65 * confidence) * (raw - mraw)), 4) * penalty, 4) AS i, round(round(rolew * (mpro + (0.35 + 0.65 * confidence) * (pro - mpro)), 4) * penalty, 4) AS p FROM fw)"""


#: columns of the finished index, of one season's tables
INDEX_SQL = "SELECT player, role, any_value(games) AS n, any_value(sm) AS mins, any_value(confidence) AS confidence, max(i) FILTER (WHERE ctx = 'total') AS index, max(i) FILTER (WHERE ctx = 'home') AS index_home, max(i) FILTER (WHERE ctx = 'away') AS index_away, max(i) FILTER (WHERE ctx = 'vs_strong') AS index_vs_strong, max(i) FILTER (WHERE ctx = 'vs_tight') AS index_vs_tight, max(p) FILTER (WHERE ctx = 'total') AS pro FROM fx GROUP BY 1, 2"
ROUNDS = [3, 6, 9, 12]


def vintages_sql(seasons, rounds=ROUNDS) -> str:
    """The index of each season and vintage, each from the season's facts up to its round."""
    one = lambda y, r: SEASON_SQL.replace("WHERE mins > 0 AND season = 1997", f"WHERE mins > 0 AND season = {y} AND rnd <= {r}")
    return " UNION ALL ".join(f"SELECT {y} AS season, {r} AS as_of, * FROM (WITH {one(y, r)} {INDEX_SQL})" for y in seasons for r in rounds)


def season_matches(spark, sf_dir):
    return matches(facts(spark, sf_dir).filter("season = 1997"))


def bodies(spark, sf_dir):
    """Ages, injuries and days out, which follow from the player's number."""
    k = F.col("player")
    return players(spark, sf_dir).select("player", (16 + k % 20).cast("double").alias("age"), (k % 5).alias("injuries"), (k % 7 * 10).alias("days"))


def rate():
    return (F.col("xg") + F.col("xa")).cast("double") * 90 / F.col("mins")


@query("a1_sos", f"WITH {FACTS_SQL}, {SOS_SQL} SELECT team, round(sos, 6) AS sos FROM s")
def a1(spark, sf_dir):
    return R.strength_of_schedule(facts(spark, sf_dir)).select("team", F.round("sos", 6).alias("sos"))


@query("a2_sos_as_of", f"WITH {FACTS_SQL}, m AS (SELECT opp AS team, CAST(sum(xg) AS DOUBLE) / count(*) AS v FROM f WHERE season = 1998 AND rnd <= 3 GROUP BY 1) SELECT team, round(v / (SELECT round(avg(v), 12) FROM m), 6) AS sos FROM m")
def a2(spark, sf_dir):
    return R.strength_of_schedule(facts(spark, sf_dir).filter("season = 1998 and rnd <= 3")).select("team", F.round("sos", 6).alias("sos"))


@query("a3_per90", f"WITH {FACTS_SQL} SELECT player, season, round(CAST(sum(xg + xa) AS DOUBLE) * 90 / CAST(sum(mins) AS DOUBLE), 6) AS output FROM f GROUP BY 1, 2")
def a3(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("player", "season").agg(F.round(per90(F.col("xg") + F.col("xa"), "mins"), 6).alias("output"))


@query("a4_opponent_adjusted", f"WITH {FACTS_SQL}, {SOS_SQL} SELECT player, round(CAST(sum(xg + xa) AS DOUBLE) * 90 / sum(mins) / avg(coalesce(sos, 1)), 5) AS adjusted FROM f LEFT JOIN s ON f.opp = s.team GROUP BY 1")
def a4(spark, sf_dir):
    rows = facts(spark, sf_dir)
    joined = rows.join(R.strength_of_schedule(rows).withColumnRenamed("team", "opp"), "opp", "left")
    return joined.groupBy("player").agg(F.round(per90(F.col("xg") + F.col("xa"), "mins") / F.avg(F.coalesce("sos", F.lit(1.0))), 5).alias("adjusted"))


@query("a5_weighted_mean", f"WITH {FACTS_SQL}, {SOS_SQL} SELECT player, round(coalesce(sum({VALUE} * least(1 / sos, 10)) / sum(least(1 / sos, 10)), avg({VALUE})), 5) AS value FROM f LEFT JOIN s ON f.opp = s.team WHERE mins > 0 GROUP BY 1")
def a5(spark, sf_dir):
    rows = facts(spark, sf_dir)
    joined = rows.filter("mins > 0").join(R.strength_of_schedule(rows).withColumnRenamed("team", "opp"), "opp", "left")
    return joined.groupBy("player").agg(F.round(weighted_mean(rate(), F.least(1 / F.col("sos"), F.lit(10.0))), 5).alias("value"))


@query("a7_consistency", f"WITH {FACTS_SQL} SELECT player, season, round(CASE WHEN count(*) >= 6 THEN avg({VALUE}) / (avg({VALUE}) + stddev_samp({VALUE})) END, 6) AS consistency FROM f WHERE mins > 0 GROUP BY 1, 2")
def a7(spark, sf_dir):
    return facts(spark, sf_dir).filter("mins > 0").groupBy("player", "season").agg(F.round(consistency(rate()), 6).alias("consistency"))


@query("a8_context_k", f"WITH {FACTS_SQL} SELECT player, round(least(12 * 1.8 * (count(*) / CAST(nullif(count(*) FILTER (WHERE venue = 'home'), 0) AS DOUBLE)), 12 * 1.8 * 8), 6) AS k FROM f GROUP BY 1")
def a8(spark, sf_dir):
    n = F.count("*").cast("double")
    home = F.nullif(F.count_if(F.col("venue") == "home"), F.lit(0))
    return facts(spark, sf_dir).groupBy("player").agg(F.round(F.least(12 * 1.8 * (n / home), F.lit(12 * 1.8 * 8)), 6).alias("k"))


@query("a13_conversion", f"WITH {FACTS_SQL}, g AS (SELECT player, season, CAST(sum(goal) AS BIGINT) AS goals, CAST(sum(xg) AS DOUBLE) AS xg, CAST(sum(mins) AS DOUBLE) AS m FROM f GROUP BY 1, 2) SELECT player, season, round(CASE WHEN xg >= 0.5 THEN goals / xg END, 6) AS ratio, round(CASE WHEN xg > 0 THEN (goals - xg) / sqrt(xg) END, 6) AS finishing, round(goals * 90 / m, 6) AS goals90 FROM g")
def a13(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("player", "season").agg(F.sum("goal").alias("goals"), total("xg").alias("xg"), total("mins").alias("m"))
    return g.select("player", "season", F.round(F.when(F.col("xg") >= 0.5, F.col("goals") / F.col("xg")), 6).alias("ratio"), F.round(F.when(F.col("xg") > 0, (F.col("goals") - F.col("xg")) / F.sqrt("xg")), 6).alias("finishing"), F.round(F.col("goals") * 90 / F.col("m"), 6).alias("goals90"))


@query("a14_half_split", f"WITH {FACTS_SQL}, n AS (SELECT player, goal, xg, row_number() OVER (PARTITION BY player ORDER BY {ORDER}) AS k, count(*) OVER (PARTITION BY player) AS c FROM f), h AS (SELECT player, max(c) AS c, CAST(sum(goal) FILTER (WHERE k <= c // 2) AS DOUBLE) / nullif(CAST(sum(xg) FILTER (WHERE k <= c // 2) AS DOUBLE), 0) AS a, CAST(sum(goal) FILTER (WHERE k > c // 2) AS DOUBLE) / nullif(CAST(sum(xg) FILTER (WHERE k > c // 2) AS DOUBLE), 0) AS b FROM n GROUP BY 1) SELECT player, round(b - a, 6) AS trend FROM h WHERE c >= 8")
def a14(spark, sf_dir):
    rows = running(facts(spark, sf_dir), ["player"], [F.col(k) for k in KEYS], F.lit(1), "k")
    rows = with_groups(rows, facts(spark, sf_dir).groupBy("player").agg(F.count("*").alias("c")), ["player"])
    early = F.col("k") <= F.floor(F.col("c") / 2)

    def ratio(where):
        return F.try_divide(total(F.when(where, F.col("goal"))), F.nullif(total(F.when(where, F.col("xg"))), F.lit(0.0)))

    return rows.groupBy("player").agg(F.max("c").alias("c"), F.round(ratio(~early) - ratio(early), 6).alias("trend")).filter("c >= 8").drop("c")


@query("a16_count_distinct", f"WITH {FACTS_SQL} SELECT player, count(DISTINCT fixture) AS games, count(DISTINCT season * 100 + rnd) AS rounds FROM f GROUP BY 1")
def a16(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("player").agg(F.countDistinct("fixture").alias("games"), F.countDistinct(F.col("season") * 100 + F.col("rnd")).alias("rounds"))


@query("a17_standings", f"WITH {FACTS_SQL} SELECT team, CAST(sum(goal) AS BIGINT) AS points, row_number() OVER (ORDER BY sum(goal) DESC, team) AS place FROM f GROUP BY 1")
def a17(spark, sf_dir):
    return R.standings(facts(spark, sf_dir))


@query("a18_top_set", f"WITH {FACTS_SQL}, t AS (SELECT team, row_number() OVER (ORDER BY sum(goal) DESC, team) AS place FROM f GROUP BY 1) SELECT list_sort(list(team)) AS teams FROM t WHERE place <= 6")
def a18(spark, sf_dir):
    return R.standings(facts(spark, sf_dir)).filter("place <= 6").agg(F.sort_array(F.collect_list("team")).alias("teams"))


@query("a19_having", "SELECT l_orderkey AS fixture, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 4 AND abs(sum(l_quantity) - 100) > 30")
def a19(spark, sf_dir):
    from .binding import table

    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fixture")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return g.filter((F.col("n") != 4) & (F.abs(F.col("q") - 100) > 30)).select("fixture", "n")


@query("a20_weighted_providers", f"WITH {FACTS_SQL}, q AS (SELECT player, venue, CAST(sum(xg) AS DOUBLE) / count(*) AS v, count(*) AS n FROM f GROUP BY 1, 2) SELECT player, round(sum(v * n) / sum(n), 6) AS rating FROM q GROUP BY 1")
def a20(spark, sf_dir):
    q = facts(spark, sf_dir).groupBy("player", "venue").agg(mean("xg").alias("v"), F.count("*").alias("n"))
    return q.groupBy("player").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("rating"))


@query("a21_mode", f"WITH {FACTS_SQL}, q AS (SELECT player, opp, sum(mins) AS m FROM f GROUP BY 1, 2) SELECT player, opp AS mode FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY m DESC, opp) AS k FROM q) WHERE k = 1")
def a21(spark, sf_dir):
    q = facts(spark, sf_dir).groupBy("player", "opp").agg(F.sum("mins").alias("m"))
    return q.groupBy("player").agg(argmax(F.col("opp"), F.col("m"), F.col("opp")).alias("mode"))


@query("a22_team_mean", f"{LEADERBOARD_SQL}, t AS (SELECT team, avg(g * 90 / m) AS v, count(*) AS n FROM p JOIN a ON p.player = a.player GROUP BY 1) SELECT team, n, round(v, 6) AS mean_xg, row_number() OVER (ORDER BY v DESC, team) AS place FROM t")
def a22(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player").groupBy("team").agg(F.avg(F.col("xg") * 90 / F.col("mins")).alias("v"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("v").desc(), "team")).cast("long")
    return t.select("team", "n", F.round("v", 6).alias("mean_xg"), place.alias("place"))


@query("a23_insights", f"{LEADERBOARD_SQL}, j AS (SELECT p.player, role, g * 90 / m AS x, h * 90 / m AS y, m, n FROM p JOIN a ON p.player = a.player) SELECT arg_max(player, x) FILTER (WHERE role = 'FWD') AS best_forward, arg_max(player, y) FILTER (WHERE role = 'MID') AS best_midfielder, arg_max(player, x + y) FILTER (WHERE role = 'DEF') AS best_defender, arg_max(player, x) FILTER (WHERE player % 20 < 6) AS best_young, arg_max(player, m / n) AS most_used, arg_min(player, x + y) AS weakest FROM j")
def a23(spark, sf_dir):
    """The best of each of six kinds in one pass."""
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player").withColumn("x", F.col("xg") * 90 / F.col("mins")).withColumn("y", F.col("xa") * 90 / F.col("mins"))
    both, role = F.col("x") + F.col("y"), F.col("role")
    kinds = {"best_forward": (role == "FWD", F.col("x")), "best_midfielder": (role == "MID", F.col("y")), "best_defender": (role == "DEF", both), "best_young": (F.col("player") % 20 < 6, F.col("x")), "most_used": (F.lit(True), F.col("mins") / F.col("games")), "weakest": (F.lit(True), -both)}
    return t.agg(*[F.max_by("player", F.when(c, v)).alias(n) for n, (c, v) in kinds.items()])


@query("a24_quantile_bins", f"{LEADERBOARD_SQL}, e AS (SELECT quantile_cont(g, [0.2, 0.4, 0.6, 0.8]) AS e FROM a) SELECT CAST(1 + len(list_filter(e, lambda q: q < g)) AS INT) AS bin, count(*) AS n, round(avg(g), 6) AS mean_xg, round(stddev_samp(g), 5) AS sd FROM a CROSS JOIN e GROUP BY 1")
def a24(spark, sf_dir):
    """Bins by exact quantiles; equal edges fall together."""
    from touchline.operators.statistics import quantile_bins

    return quantile_bins(player_totals(spark, sf_dir), "xg", 5).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("xg"), 6).alias("mean_xg"), F.round(F.stddev_samp("xg"), 5).alias("sd"))


@query("a25_baseline", f"WITH {RUNS_SQL} SELECT stage, count(*) AS n, round(CAST(sum(duration) AS DOUBLE) / count(*), 6) AS mean, round(stddev_pop(CAST(duration AS DOUBLE)), 5) AS sd, round(quantile_cont(CAST(duration AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(duration AS DOUBLE), 0.95), 6) AS p95 FROM r GROUP BY 1")
def a25(spark, sf_dir):
    d = F.col("duration").cast("double")
    rows = runs(spark, sf_dir)
    plain = rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(mean("duration"), 6).alias("mean"), F.round(F.stddev_pop(d), 5).alias("sd"))
    return plain.join(quantiles(rows, ["stage"], "duration", [0.5, 0.95]), "stage").select("stage", "n", "mean", "sd", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))


@query("a26_daily_counts", f"WITH {RUNS_SQL} SELECT day, count(*) AS n, count(*) FILTER (WHERE failed) AS failures FROM r GROUP BY 1")
def a26(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))


@query("a27_share", f"WITH {RUNS_SQL} SELECT owner, round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END), 6) AS share FROM r GROUP BY 1")
def a27(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("owner").agg(F.round(F.avg(F.col("failed").cast("double")), 6).alias("share"))


@query("a28_collect", f"WITH {FACTS_SQL} SELECT player, string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons FROM f GROUP BY 1")
def a28(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("player").agg(F.array_join(F.sort_array(F.collect_set(F.col("season").cast("string"))), ",").alias("seasons"))


@query("a29_counters", f"WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE failed) AS failures, CAST(sum(size) AS BIGINT) AS rows_out FROM r")
def a29(spark, sf_dir):
    return runs(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("failed").alias("failures"), F.sum("size").alias("rows_out"))


RANKED_SQL = "(SELECT CAST(s_suppkey AS BIGINT) AS player, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(floor(s_acctbal / 500) AS INT) END AS v, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS role FROM supplier)"


def _ranked(spark, sf_dir):
    return players(spark, sf_dir).select("player", "role", F.when(F.col("player") % 11 != 0, F.floor(F.col("balance") / 500).cast("int")).alias("v"))


@query("w1_rank_average", f"SELECT player, CAST(floor(rank() OVER (ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) AS BIGINT) AS rank FROM {RANKED_SQL}")
def w1(spark, sf_dir):
    return rank_average(_ranked(spark, sf_dir), "v", [], "rank").select("player", "rank")


@query("w2_rank_min", f"SELECT player, role, rank() OVER (PARTITION BY role ORDER BY v DESC NULLS LAST) AS rank FROM {RANKED_SQL}")
def w2(spark, sf_dir):
    return rank_min(_ranked(spark, sf_dir), "v", "rank", ["role"]).select("player", "role", "rank")


@query("w3_row_number", f"SELECT player, role, row_number() OVER (PARTITION BY role ORDER BY v DESC NULLS LAST, player) AS place FROM {RANKED_SQL}")
def w3(spark, sf_dir):
    return place(_ranked(spark, sf_dir), "v", ["player"], "place", ["role"]).select("player", "role", "place")


@query("w4_spearman", f"{LEADERBOARD_SQL}, j AS (SELECT role, g, h FROM p JOIN a ON p.player = a.player), k AS (SELECT role, rank() OVER (PARTITION BY role ORDER BY g DESC) + (count(*) OVER (PARTITION BY role, g) - 1) / 2.0 AS x, rank() OVER (PARTITION BY role ORDER BY h DESC) + (count(*) OVER (PARTITION BY role, h) - 1) / 2.0 AS y FROM j) SELECT role, round(corr(x, y), 6) AS rho, count(*) AS n FROM k GROUP BY 1")
def w4(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player")
    return spearman(t, "xg", "xa", ["role"]).select("role", F.round("rho", 6).alias("rho"), "n")


@query("w5_cumulative", f"WITH {FACTS_SQL}, q AS (SELECT player, season, rnd, CAST(sum(goal) AS BIGINT) AS goals, sum(xg) AS xg FROM f WHERE season = 1999 GROUP BY 1, 2, 3) SELECT player, rnd, CAST(sum(goals) OVER w AS BIGINT) AS goals, CAST(sum(xg) OVER w AS DOUBLE) AS xg FROM q WINDOW w AS (PARTITION BY player ORDER BY rnd ROWS UNBOUNDED PRECEDING)")
def w5(spark, sf_dir):
    q = facts(spark, sf_dir).filter("season = 1999").groupBy("player", "rnd").agg(F.sum("goal").alias("goals"), F.sum("xg").alias("xg"))
    w = Window.partitionBy("player").orderBy("rnd").rowsBetween(Window.unboundedPreceding, 0)
    return q.select("player", "rnd", F.sum("goals").over(w).alias("goals"), F.sum("xg").over(w).cast("double").alias("xg"))


@query("w6_ewma", f"WITH {FACTS_SQL}, q AS (SELECT player, list({VALUE} ORDER BY {ORDER}) AS v FROM f WHERE season = 1996 AND mins > 0 GROUP BY 1) SELECT player, round(list_reduce(v, lambda s, x: 0.3 * x + 0.7 * s), 6) AS ewma, len(v) AS n FROM q")
def w6(spark, sf_dir):
    rows = ewma_series(facts(spark, sf_dir).filter("season = 1996 and mins > 0").withColumn("v", rate()), ["player"], list(KEYS), "v", "s")
    return rows.groupBy("player").agg(F.round(F.max_by("s", "pos"), 6).alias("ewma"), F.count("*").alias("n"))


@query("w7_form_trend", f"WITH {FACTS_SQL}, q AS (SELECT player, list({VALUE} ORDER BY {ORDER}) AS v FROM f WHERE season = 1996 AND mins > 0 GROUP BY 1) SELECT player, round(CASE WHEN len(v) >= 5 THEN list_reduce(v, lambda s, x: 0.3 * x + 0.7 * s) / list_avg(v) - 1 END, 6) AS trend FROM q")
def w7(spark, sf_dir):
    return R.form(facts(spark, sf_dir).filter("season = 1996"), list(KEYS)).select("player", F.round("trend", 6).alias("trend"))


@query("w8_last_six", f"WITH {FACTS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ship DESC, fixture DESC, line DESC, part DESC) AS k FROM f), t AS (SELECT player, CAST(sum(xg) AS DOUBLE) * 90 / sum(mins) AS season_rate FROM f GROUP BY 1) SELECT player, CAST(sum(mins) AS BIGINT) AS mins, round(CAST(sum(xg) AS DOUBLE) * 90 / sum(mins) / max(season_rate), 6) AS ratio FROM q JOIN t USING (player) WHERE k <= 6 GROUP BY 1")
def w8(spark, sf_dir):
    rows = facts(spark, sf_dir)
    season = rows.groupBy("player").agg(per90("xg", "mins").alias("season_rate"))
    recent = last_n(rows, ["player"], list(KEYS), 6).groupBy("player").agg(F.sum("mins").alias("mins"), per90("xg", "mins").alias("now"))
    return recent.join(season, "player").select("player", "mins", F.round(F.col("now") / F.col("season_rate"), 6).alias("ratio"))


@query("w9_rolling_mean", f"WITH {RUNS_SQL}, d AS (SELECT stage, day, sum(duration) AS v, count(*) AS n FROM r GROUP BY 1, 2) SELECT stage, day, round(CAST(sum(v) OVER w AS DOUBLE) / count(*) OVER w, 6) AS mean FROM d WINDOW w AS (PARTITION BY stage ORDER BY day ROWS 6 PRECEDING)")
def w9(spark, sf_dir):
    d = runs(spark, sf_dir).groupBy("stage", "day").agg(F.sum("duration").alias("v"))
    w = Window.partitionBy("stage").orderBy("day").rowsBetween(-6, 0)
    return d.select("stage", "day", F.round(F.sum("v").over(w).cast("double") / F.count("v").over(w), 6).alias("mean"))


@query("w10_robust_z", f"{LEADERBOARD_SQL}, j AS (SELECT p.player, role, g * 90 / m AS v FROM p JOIN a ON p.player = a.player), q AS (SELECT role, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM j GROUP BY 1), c AS (SELECT j.*, least(greatest(v, lo), hi) AS c FROM j JOIN q USING (role)), s AS (SELECT role, avg(c) AS mu, stddev_samp(c) AS sd, count(*) AS n FROM c GROUP BY 1) SELECT player, round(CASE WHEN n < 3 THEN NULL WHEN sd = 0 THEN 0 ELSE greatest(-3, least(3, (v - mu) / sd)) END, 5) AS z FROM c JOIN s USING (role)")
def w10(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player").withColumn("v", F.col("xg") * 90 / F.col("mins"))
    return robust_z(t, "v", ["role"], "z").select("player", F.round("z", 5).alias("z"))


@query("w11_role_mean", f"{LEADERBOARD_SQL} SELECT p.player, round(g - avg(g) OVER (PARTITION BY role), 3) AS above FROM p JOIN a ON p.player = a.player")
def w11(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player")
    return with_means(t, ["role"], {"mean": "xg"}).select("player", F.round(F.col("xg") - F.col("mean"), 3).alias("above"))


@query("w13_first_appearance", f"WITH {FACTS_SQL} SELECT player, season, min(rnd) AS first_rnd, min(ship) AS first_ship FROM f WHERE mins > 0 GROUP BY 1, 2")
def w13(spark, sf_dir):
    return facts(spark, sf_dir).filter("mins > 0").groupBy("player", "season").agg(F.min("rnd").alias("first_rnd"), F.min("ship").alias("first_ship"))


@query("w14_season_jump", f"WITH {FACTS_SQL}, q AS (SELECT player, season, round(CAST(sum(xg) AS DOUBLE) * 90 / sum(mins), 6) AS v FROM f GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY player ORDER BY season) AS before FROM q) SELECT player, season, round(v - before, 6) AS jump, CASE WHEN abs(v - before) >= 3 THEN 'critical' ELSE 'warn' END AS severity FROM l WHERE abs(v - before) >= 2")
def w14(spark, sf_dir):
    q = facts(spark, sf_dir).groupBy("player", "season").agg(F.round(per90("xg", "mins"), 6).alias("v"))
    q = q.withColumn("before", F.lag("v").over(Window.partitionBy("player").orderBy("season")))
    jump = F.col("v") - F.col("before")
    return q.filter(F.abs(jump) >= 2).select("player", "season", F.round(jump, 6).alias("jump"), F.when(F.abs(jump) >= 3, "critical").otherwise("warn").alias("severity"))


@query("w15_set_change", f"WITH {FACTS_SQL}, q AS (SELECT DISTINCT season, opp AS team FROM f WHERE opp % 5 <> season % 5) SELECT q.season, q.team, 'appeared' AS change FROM q LEFT JOIN q AS b ON b.season = q.season - 1 AND b.team = q.team WHERE b.team IS NULL AND q.season > (SELECT min(season) FROM q) UNION ALL SELECT q.season + 1, q.team, 'disappeared' FROM q LEFT JOIN q AS b ON b.season = q.season + 1 AND b.team = q.team WHERE b.team IS NULL AND q.season < (SELECT max(season) FROM q)")
def w15(spark, sf_dir):
    from touchline.operators.platform import set_changes

    q = facts(spark, sf_dir).filter("opp % 5 <> season % 5").select("season", F.col("opp").alias("team")).distinct()
    return set_changes(q, "season", "team")


@query("w16_nth_event", f"WITH {FACTS_SQL}, g AS (SELECT DISTINCT season, team, fixture, ship FROM f), n AS (SELECT season, row_number() OVER (PARTITION BY season, team ORDER BY ship, fixture) AS k, ship < TIMESTAMP '2001-01-01' AS played FROM g), b AS (SELECT season, k, bool_and(played) AS complete FROM n GROUP BY 1, 2) SELECT season, coalesce(min(k) FILTER (WHERE NOT complete) - 1, max(k)) AS complete_rounds FROM b GROUP BY 1")
def w16(spark, sf_dir):
    """In each season the longest run of n for which every team's n-th game is played."""
    from touchline.operators.platform import complete_rounds

    g = facts(spark, sf_dir).select("season", "team", "fixture", "ship").distinct()
    return complete_rounds(g.withColumn("played", F.col("ship") < F.lit("2001-01-01").cast("timestamp_ntz")), "team", ["ship", "fixture"], "played", ["season"])


@query("w17_half_windows", f"WITH {RUNS_SQL} SELECT stage, round(CAST(count(*) FILTER (WHERE size > 80 AND day > DATE '2024-01-15') AS DOUBLE) / count(*) FILTER (WHERE day > DATE '2024-01-15') - CAST(count(*) FILTER (WHERE size > 80 AND day <= DATE '2024-01-15') AS DOUBLE) / count(*) FILTER (WHERE day <= DATE '2024-01-15'), 6) AS change FROM r GROUP BY 1")
def w17(spark, sf_dir):
    late, hit = F.col("day") > F.lit("2024-01-15").cast("date"), F.col("size") > 80
    share = lambda where: F.count_if(where & hit) / F.count_if(where)
    return runs(spark, sf_dir).groupBy("stage").agg(F.round(share(late) - share(~late), 6).alias("change"))


@query("w18_last_vs_baseline", f"WITH {RUNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY started DESC, run DESC) AS k FROM r) SELECT stage, round((max(CAST(duration AS DOUBLE)) FILTER (WHERE k = 1) - avg(CAST(duration AS DOUBLE)) FILTER (WHERE k > 1)) / stddev_pop(CAST(duration AS DOUBLE)) FILTER (WHERE k > 1), 5) AS z FROM k GROUP BY 1")
def w18(spark, sf_dir):
    from touchline.operators.platform import last_against_rest

    return last_against_rest(runs(spark, sf_dir).withColumn("duration", F.col("duration").cast("double")), "stage", ["started", "run"], "duration").select("stage", F.round("z", 5).alias("z"))


@query("w20_percentile", f"SELECT player, round((count(*) OVER () - rank) * 100.0 / count(*) OVER (), 6) AS pct FROM (SELECT player, floor(rank() OVER (ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) AS rank FROM {RANKED_SQL})")
def w20(spark, sf_dir):
    rows = _ranked(spark, sf_dir)
    r = rank_average(rows, "v", [], "rank").join(rows.agg(F.count("*").alias("n")))
    return r.select("player", F.round((F.col("n") - F.col("rank")) * 100.0 / F.col("n"), 6).alias("pct"))


@query("w21_movers", f"WITH {FACTS_SQL}, v AS (SELECT season, player, row_number() OVER (PARTITION BY season ORDER BY CAST(sum(xg) AS DOUBLE) / sum(mins) DESC, player) AS k FROM f WHERE season IN (1998, 1999) AND (season = 1999 OR player % 20 <> 7) GROUP BY 1, 2), m AS (SELECT a.player, a.k - b.k AS moved FROM v a JOIN v b ON a.player = b.player AND a.season = 1998 AND b.season = 1999) (SELECT player, moved, 'up' AS kind FROM m ORDER BY moved DESC, player LIMIT 3) UNION ALL (SELECT player, moved, 'down' FROM m ORDER BY moved, player LIMIT 3) UNION ALL (SELECT player, NULL, 'new' FROM v WHERE season = 1999 AND k <= 100 AND player NOT IN (SELECT player FROM v WHERE season = 1998))")
def w21(spark, sf_dir):
    from touchline.operators.serving import movers

    v = facts(spark, sf_dir).filter("season = 1999 or season = 1998 and player % 20 <> 7").groupBy("season", "player").agg((total("xg") / total("mins")).alias("v"))
    return movers(v.filter("season = 1998").drop("season"), v.filter("season = 1999").drop("season"), "player", "v", 3)


@query("m1_minutes_shrinkage", f"{LEADERBOARD_SQL}, j AS (SELECT p.player, role, CAST(m AS DOUBLE) AS m, CAST(c AS BIGINT) AS c, g * 90 / m AS v FROM p JOIN (SELECT *, (SELECT count(*) FROM f WHERE f.player = a.player AND mins > 0) AS c FROM a) a ON p.player = a.player), k AS (SELECT *, 600 * greatest(1, least(3, greatest(1, least(2.5, 75 / greatest(30, least(90, m / c)))) * greatest(1, least(3, 30.0 / c)))) AS k, avg(v) OVER (PARTITION BY role) AS prior FROM j) SELECT player, round((m * v + k * prior) / (m + k), 5) AS shrunk FROM k")
def m1(spark, sf_dir):
    t = facts(spark, sf_dir).filter("mins > 0").groupBy("player", "role").agg(F.sum("mins").alias("mins"), F.count("*").alias("n"), per90("xg", "mins").alias("v")).withColumn("ctx", F.lit("total"))
    return R.minutes_shrinkage(t, "v", "s").select("player", F.round("s", 5).alias("shrunk"))


@query("m2_composite", f"{LEADERBOARD_SQL}, j AS (SELECT player, CASE WHEN player % 3 = 0 THEN NULL ELSE g / m END AS x, CASE WHEN player % 5 = 0 THEN NULL ELSE h / m END AS y FROM a) SELECT player, round((coalesce(x, 0) * 0.32 + coalesce(y, 0) * 0.20) / nullif((CASE WHEN x IS NOT NULL THEN 0.32 ELSE 0 END) + (CASE WHEN y IS NOT NULL THEN 0.20 ELSE 0 END), 0), 6) AS index FROM j")
def m2(spark, sf_dir):
    t = player_totals(spark, sf_dir).select("player", F.when(F.col("player") % 3 != 0, F.col("xg") / F.col("mins")).alias("x"), F.when(F.col("player") % 5 != 0, F.col("xa") / F.col("mins")).alias("y"))
    return t.select("player", F.round(R.composite({"output": F.col("x"), "finishing": F.col("y")}, R.RULES.weights), 6).alias("index"))


@query("m3_confidence", f"{LEADERBOARD_SQL}, q AS (SELECT quantile_cont(m, 0.95) AS p95 FROM a) SELECT player, round(pow(least(1, m / p95) * greatest(0.3, least(1, n / 30.0)) * greatest(0.4, least(1, m / n / 90.0)) * ((CASE WHEN g IS NOT NULL THEN 1.0 ELSE 0 END) + (CASE WHEN player % 2 = 0 THEN 1.0 ELSE 0 END)) / 2, 0.25), 3) AS confidence FROM a CROSS JOIN q")
def m3(spark, sf_dir):
    t = player_totals(spark, sf_dir).withColumn("n", F.col("games")).withColumn("y", F.when(F.col("player") % 2 == 0, F.col("xa")))
    return R.confidence(t, ["xg", "y"]).select("player", "confidence")


@query("m4_dead_dimension", f"{LEADERBOARD_SQL} SELECT 'xg' AS dim, stddev_samp(g) IS NULL OR stddev_samp(g) < 0.05 AS dead FROM a UNION ALL SELECT 'zero', stddev_samp(g * 0) IS NULL OR stddev_samp(g * 0) < 0.05 FROM a")
def m4(spark, sf_dir):
    t = player_totals(spark, sf_dir).select(F.col("xg"), (F.col("xg") * 0).alias("zero"))
    return t.unpivot([], ["xg", "zero"], "dim", "v").groupBy("dim").agg(F.coalesce(F.stddev_samp("v") < 0.05, F.lit(True)).alias("dead"))


@query("m5_momentum", f"{LEADERBOARD_SQL}, j AS (SELECT a.player, CAST(balance / 500 AS DOUBLE) AS age, g * 90 / m AS v FROM p JOIN a ON p.player = a.player), k AS (SELECT regr_slope(v, age) AS b, regr_intercept(v, age) AS c FROM j WHERE age <= 15) SELECT player, round(v - (c + b * age), 5) AS momentum FROM j CROSS JOIN k WHERE age < 10")
def m5(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player").select("player", (F.col("balance") / 500).alias("age"), (F.col("xg") * 90 / F.col("mins")).alias("v"))
    line = t.filter("age <= 15").agg(F.regr_slope("v", "age").alias("b"), F.regr_intercept("v", "age").alias("c"))
    return t.filter("age < 10").join(line).select("player", F.round(F.col("v") - (F.col("c") + F.col("b") * F.col("age")), 5).alias("momentum"))


@query("m7_role_weighted", f"{LEADERBOARD_SQL}, j AS (SELECT p.player, role, g * 90 / m AS v, least(1.0, n / 700.0) AS c FROM p JOIN a ON p.player = a.player), k AS (SELECT *, avg(v) OVER (PARTITION BY role) AS mu FROM j) SELECT player, round(CASE role WHEN 'FWD' THEN 1 WHEN 'MID' THEN 0.85 WHEN 'DEF' THEN 0.55 ELSE 0.20 END * (mu + (0.35 + 0.65 * c) * (v - mu)), 5) AS value FROM k")
def m7(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player").withColumn("v", F.col("xg") * 90 / F.col("mins"))
    t = with_means(t, ["role"], {"mu": "v"})
    return t.select("player", F.round(R.role_weighted(F.col("v"), F.col("mu"), F.least(F.lit(1.0), F.col("games") / 700.0), F.col("role")), 5).alias("value"))


@query("m8_availability", f"{LEADERBOARD_SQL} SELECT player, round((greatest(0.3, least(0.7, greatest(0, least(1, n / 1000.0)))) - 0.3) / 0.4 * 0.15 + 0.85, 6) AS penalty FROM a")
def m8(spark, sf_dir):
    return player_totals(spark, sf_dir).select("player", F.round(R.availability_penalty(F.col("games"), F.lit(1000.0)), 6).alias("penalty"))


@query("m9_age_index", f"WITH {PLAYERS_SQL}, j AS (SELECT player, 14 + balance / 300 AS age FROM p) SELECT player, round(CASE WHEN age BETWEEN 15 AND 45 THEN 0.55 * exp(-0.5 * pow((age - 23) / 3.5, 2)) + 0.25 * greatest(0, least(1, (23 - age) / 5)) + 0.20 * CASE WHEN age <= 27 THEN 1 ELSE greatest(0, 1 - (age - 27) * 0.06) END END, 6) AS aii FROM j")
def m9(spark, sf_dir):
    return players(spark, sf_dir).select("player", F.round(R.age_index(14 + F.col("balance") / 300), 6).alias("aii"))


@query("m10_reliability", f"{LEADERBOARD_SQL} SELECT player, round(CASE WHEN n >= 8 THEN 0.5 * least(1, (n - 3.0) / n) + 0.3 * greatest(0, 1 - least(player % 9, 6) * 0.15) + 0.2 * greatest(0, 1 - (player % 120) / 90.0) END, 6) AS pri FROM a")
def m10(spark, sf_dir):
    return player_totals(spark, sf_dir).select("player", F.round(R.reliability(F.col("games") - 3, F.col("games"), F.col("player") % 9, F.col("player") % 120), 6).alias("pri"))




def _dims(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("a6_boost", f"WITH {SEASON_SQL} SELECT player, ctx, round(boost, 6) AS boost FROM d0")
def a6(spark, sf_dir):
    """What the team makes with a player against without, drawn to 1 by the number of games without."""
    return R.context_dimensions(season_matches(spark, sf_dir)).select("player", "ctx", *_dims("boost"))


@query("a10_contexts", f"""WITH {FACTS_SQL}, {SOS_SQL}, tight AS (SELECT team, row_number() OVER (ORDER BY sos, team) AS k FROM s QUALIFY k <= 7), strong AS (SELECT team FROM (SELECT team, sum(goal) AS g FROM f GROUP BY 1) ORDER BY g DESC, team LIMIT 6),
 c AS (SELECT player, 'total' AS ctx, xg, xa, mins FROM f UNION ALL SELECT player, venue, xg, xa, mins FROM f UNION ALL SELECT player, 'vs_strong', xg, xa, mins FROM f WHERE opp IN (SELECT team FROM strong) AND opp <> team
 UNION ALL SELECT player, 'vs_tight', xg, xa, mins FROM f WHERE opp <> team AND opp IN (SELECT b.team FROM tight b WHERE b.team <> f.team AND (SELECT count(*) FROM tight o WHERE o.k <= b.k AND o.team <> f.team) <= 6))
 SELECT player, ctx, count(*) AS n, round(CAST(sum(xg + xa) AS DOUBLE) * 90 / CAST(sum(mins) AS DOUBLE), 6) AS output FROM c WHERE mins > 0 GROUP BY 1, 2 HAVING count(*) >= 4""")
def a10(spark, sf_dir):
    """Every player faces six tight teams, those of a tight team too."""
    rows = facts(spark, sf_dir)
    sos = R.strength_of_schedule(rows)
    found = R.dimensions(R.contexts(rows, R.standings(rows).filter("place <= 6"), R.tight_ranks(sos, 6)), sos)
    return found.select("player", "ctx", "n", F.round("output", 6).alias("output"))


@query("a11_centrality", f"WITH {SEASON_SQL} SELECT player, ctx, round(centrality, 6) AS centrality FROM d0")
def a11(spark, sf_dir):
    """Share of the team's output, drawn to that of forwards and midfielders in the same context (a11, a12)."""
    return R.context_dimensions(season_matches(spark, sf_dir)).select("player", "ctx", *_dims("centrality"))


@query("a9_dimensions", f"WITH {SEASON_SQL} SELECT player, ctx, n, mins, round(output, 6) AS output, round(buildup, 6) AS buildup, round(centrality, 6) AS centrality, round(boost, 6) AS boost, round(consistency, 6) AS consistency FROM d0")
def a9(spark, sf_dir):
    return R.context_dimensions(season_matches(spark, sf_dir)).select("player", "ctx", "n", "mins", *_dims(*R.DIMENSIONS))


@query("a15_kpi", f"WITH {SEASON_SQL}, o AS (SELECT player, team, CAST(sum(xa) AS DOUBLE) * 90 / CAST(sum(mins) AS DOUBLE) AS xa90, avg(tc.sos) AS sos, count(*) AS n, CAST(sum(tx) AS DOUBLE) AS x FROM m JOIN tc USING (team, fixture) WHERE ctx = 'total' GROUP BY 1, 2), a AS (SELECT team, count(*) AS n, CAST(sum(tx) AS DOUBLE) AS x FROM t GROUP BY 1) SELECT player, round(xa90, 6) AS xa90, round(sos, 6) AS sos, round(o.x / o.n, 6) AS team_with, round((a.x - o.x) / nullif(a.n - o.n, 0), 6) AS team_without FROM o JOIN a USING (team)")
def a15(spark, sf_dir):
    return R.key_figures(season_matches(spark, sf_dir)).select("player", *_dims("xa90", "sos", "team_with", "team_without"))


@query("w12_context_stability", f"WITH {SEASON_SQL} SELECT player, round(stability, 6) AS stability FROM sb")
def w12(spark, sf_dir):
    """How little the five contexts' scores differ, from the scores before any weight of the role."""
    return R.context_spread(season_matches(spark, sf_dir)).select("player", *_dims("stability"))


@query("w19_trend_axis", f"WITH {SEASON_SQL}, wk AS (SELECT team, row_number() OVER (ORDER BY sos DESC, team) AS k FROM so QUALIFY k <= 7), own AS (SELECT player, m.team, m.fixture, m.rnd, tx AS x, m.opp <> m.team AND a.k - CASE WHEN b.k < a.k THEN 1 ELSE 0 END <= 6 AS tight, m.opp <> m.team AND c.k - CASE WHEN e.k < c.k THEN 1 ELSE 0 END <= 6 AS weak FROM m JOIN t USING (team, fixture) LEFT JOIN ti a ON a.team = m.opp LEFT JOIN ti b ON b.team = m.team LEFT JOIN wk c ON c.team = m.opp LEFT JOIN wk e ON e.team = m.team), y AS (SELECT player, rnd, CAST(sum(x) AS DOUBLE) / count(*) AS team_with, CAST(sum(x) FILTER (WHERE tight) AS DOUBLE) / nullif(count(*) FILTER (WHERE tight), 0) AS tight, CAST(sum(x) FILTER (WHERE weak) AS DOUBLE) / nullif(count(*) FILTER (WHERE weak), 0) AS weak FROM own GROUP BY 1, 2), z AS (SELECT p.player, t.rnd, CAST(sum(tx) AS DOUBLE) / count(*) AS team_without FROM (SELECT DISTINCT player, team FROM m) p JOIN t USING (team) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.player = p.player AND m.fixture = t.fixture) GROUP BY 1, 2) SELECT coalesce(y.player, z.player) AS player, coalesce(y.rnd, z.rnd) AS rnd, team_with, tight, weak, team_without FROM y FULL JOIN z ON y.player = z.player AND y.rnd = z.rnd")
def w19(spark, sf_dir):
    """The team's output by round with a player, against tight and weak teams, and without the player."""
    return R.team_trend(season_matches(spark, sf_dir))


@query("w6_ewma_series", f"WITH RECURSIVE {FACTS_SQL}, q AS (SELECT player, {VALUE} AS x, row_number() OVER (PARTITION BY player ORDER BY {ORDER}) AS k FROM f WHERE season = 1996 AND mins > 0), e AS (SELECT player, k, x AS s FROM q WHERE k = 1 UNION ALL SELECT q.player, q.k, 0.3 * q.x + 0.7 * e.s FROM q JOIN e ON q.player = e.player AND q.k = e.k + 1) SELECT player, k - 1 AS pos, round(s, 4) AS ewma FROM e")
def w6s(spark, sf_dir):
    rows = facts(spark, sf_dir).filter("season = 1996 and mins > 0").withColumn("value", rate())
    return ewma_series(rows, ["player"], list(KEYS), "value", "ewma").select("player", F.col("pos").cast("long").alias("pos"), F.round("ewma", 4).alias("ewma"))


@query("rating_season", f"WITH {SEASON_SQL}, g AS (SELECT player, role, any_value(games) AS n, any_value(sm) AS mins, any_value(confidence) AS confidence, max(i) FILTER (WHERE ctx = 'total') AS index, max(i) FILTER (WHERE ctx = 'home') AS index_home, max(i) FILTER (WHERE ctx = 'away') AS index_away, max(i) FILTER (WHERE ctx = 'vs_strong') AS index_vs_strong, max(i) FILTER (WHERE ctx = 'vs_tight') AS index_vs_tight, max(p) FILTER (WHERE ctx = 'total') AS pro FROM fx GROUP BY 1, 2) SELECT *, CAST(floor(rank() OVER (ORDER BY index DESC NULLS LAST) + (count(*) OVER (PARTITION BY index) - 1) / 2.0) AS BIGINT) AS rank, CAST(floor(rank() OVER (ORDER BY pro DESC NULLS LAST) + (count(*) OVER (PARTITION BY pro) - 1) / 2.0) AS BIGINT) AS pro_rank FROM g")
def season(spark, sf_dir):
    """The whole index of one season: seven dimensions in five contexts, and the index with its modulators."""
    return R.season_index(season_matches(spark, sf_dir), bodies(spark, sf_dir))


SEASONS = range(1995, 2002)
RANKS_SQL = ", ".join(f"CAST(floor(rank() OVER (PARTITION BY season, as_of ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY season, as_of, {c}) - 1) / 2.0) AS BIGINT) AS {r}" for c, r in (("index", "rank"), ("pro", "pro_rank")))


@query("rating_vintages", f"SELECT *, {RANKS_SQL} FROM ({vintages_sql(SEASONS)})")
def rating_vintages(spark, sf_dir):
    """The whole index of every season as of four rounds, from states that add up over rounds."""
    return V.season_vintages(matches(facts(spark, sf_dir)), bodies(spark, sf_dir), ROUNDS)


def index_vintages(spark, sf_dir):
    """The index of two seasons as of four rounds; several validations read it, so a session writes it once."""
    two = lambda: V.season_vintages(matches(facts(spark, sf_dir).filter("season in (1998, 1999)")), bodies(spark, sf_dir), ROUNDS)
    return kept(spark, ("index_vintages", sf_dir), two)


#: season 1999 at its vintages: the index, what was known (`before`) and what came strictly later, for 90 minutes
def outcomes_sql(rounds=ROUNDS) -> str:
    part = lambda op: f"CAST(sum(goal + xa) FILTER (WHERE rnd {op} as_of) AS DOUBLE) * 90 / sum(mins) FILTER (WHERE rnd {op} as_of)"
    return f"ix AS MATERIALIZED ({vintages_sql([1999], rounds)}), ou AS MATERIALIZED (SELECT as_of, player, {part('<=')} AS before, {part('>')} AS later, coalesce(sum(mins) FILTER (WHERE rnd > as_of), 0) AS mins_later FROM f CROSS JOIN (SELECT unnest({rounds}) AS as_of) WHERE season = 1999 AND mins > 0 GROUP BY 1, 2), iq AS MATERIALIZED (SELECT ix.as_of, ix.player, p.team, ix.role, index, pro, CAST(ix.mins AS DOUBLE) AS mins, CAST(16 + ix.player % 20 AS DOUBLE) AS age, before, later, mins_later FROM ix JOIN ou USING (as_of, player) JOIN p USING (player))"


def outcomes(spark, sf_dir):
    """The index of season 1999 at its vintages, beside what was known and what came strictly later; facts meet the rounds once."""
    rows = facts(spark, sf_dir).filter("season = 1999 and mins > 0").withColumn("as_of", F.explode(F.array(*map(F.lit, ROUNDS))))
    known = F.col("rnd") <= F.col("as_of")
    part = lambda where: per90(F.when(where, F.col("goal") + F.col("xa")), F.when(where, F.col("mins")))
    told = rows.groupBy("as_of", "player", "team").agg(part(known).alias("before"), part(~known).alias("later"), F.coalesce(F.sum(F.when(~known, F.col("mins"))), F.lit(0)).alias("mins_later"))
    index = index_vintages(spark, sf_dir).filter("season = 1999").select("as_of", "player", "role", "index", "pro", F.col("mins").cast("double").alias("mins"))
    return kept(spark, ("outcomes", sf_dir), lambda: index.join(told, ["as_of", "player"]).join(bodies(spark, sf_dir).select("player", "age"), "player"))


@query("m6_age_profile", f"WITH {SEASON_SQL} SELECT player, ctx, p AS pro FROM fx")
def m6(spark, sf_dir):
    """The index and five modulators by weights of the age, in each context."""
    return R.scored(season_matches(spark, sf_dir), bodies(spark, sf_dir)).select("player", "ctx", F.col("pro_").alias("pro"))


@query("m11_availability", f"WITH {SEASON_SQL} SELECT player, CAST(available AS BIGINT) AS available, played, injuries, days, round(age_index, 6) AS age_index, round(reliability, 6) AS reliability FROM w1")
def m11(spark, sf_dir):
    """Rounds a player could have played (from the first one for those who came in winter), with age and injuries."""
    found = R.prepared(season_matches(spark, sf_dir), bodies(spark, sf_dir))
    return found.select("player", F.col("available").cast("long").alias("available"), "played", "injuries", "days", *_dims("age_index", "reliability"))
