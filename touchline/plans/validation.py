"""Composed tests of the index: against outside ratings, against what came later, and against itself with parts moved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import rating as R
from touchline.operators import statistics as S
from touchline.operators.cuts import cut, kept
from touchline.operators.measures import mean, per90
from touchline.operators.ordered import quantiles
from touchline.operators.windows import last_n, place, rank_average, spearman

from .binding import FACTS_SQL, MATCHES_SQL, facts, matches, players, table
from .monitoring import PAIRED_SQL, moved_sql, paired_sql
from .rating import SEASON_SQL, bodies, index_vintages, outcomes, outcomes_sql, season_matches, vintages_sql
from .registry import ORACLES, QUERIES, query
from .statistics import bootstrap_sql, rounded, uniform_sql


def rank_sql(column: str, by: str = "") -> str:
    """Average rank of a column."""
    part = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({part}ORDER BY {column}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{column}) - 1) / 2.0)"


def agreement(rows, x: str, y: str):
    """(r, rho, n) over the rows that have both."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rank_average(rank_average(both, x, [], "_x", floor=False), y, [], "_y", floor=False)
    return ranked.agg(F.corr(x, y).alias("r"), F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def effect(rows, by: str, value: str):
    """(d): the difference of value between the top and the bottom quarter by another column, in pooled deviations."""
    edge = quantiles(rows, [], by, [0.25, 0.75]).select(F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    top, low = F.when(F.col(by) >= F.col("_hi"), F.col(value)), F.when(F.col(by) <= F.col("_lo"), F.col(value))
    return rows.join(edge).agg(((F.avg(top) - F.avg(low)) / F.sqrt((F.var_samp(top) + F.var_samp(low)) / 2)).alias("d"))


#: x is the index of season 1999 as of round 6, y what came after it
INDEX_PAIR_SQL = f"WITH {FACTS_SQL}, {outcomes_sql([6])}, z AS (SELECT player, role, team, index AS x, later AS y FROM iq WHERE mins_later >= 90)"


def index_pairs(spark, sf_dir):
    return outcomes(spark, sf_dir).filter("as_of = 6 and mins_later >= 90").select("player", "role", "team", F.col("index").alias("x"), F.col("later").alias("y"))


RATED_SQL = f"""{INDEX_PAIR_SQL}, ra AS (SELECT s_suppkey + CASE WHEN s_suppkey % 5 = 2 THEN 9000 ELSE 0 END AS player, lower(s_name) AS name, s_acctbal AS rating FROM supplier WHERE s_suppkey % 3 <> 1),
 pn AS (SELECT z.*, lower(p.name) AS name FROM z JOIN p USING (player)), jo AS (SELECT pn.player, pn.role, pn.x, coalesce(a.rating, b.rating) AS y FROM pn LEFT JOIN ra a ON a.player = pn.player LEFT JOIN ra b ON b.name = pn.name WHERE coalesce(a.rating, b.rating) IS NOT NULL)"""


def rated(spark, sf_dir):
    """The index beside an outside rating, joined by id and, for those it misses, by name."""
    p = players(spark, sf_dir)
    given = p.filter("player % 3 <> 1").select((F.col("player") + F.when(F.col("player") % 5 == 2, 9000).otherwise(0)).alias("_id"), F.lower("name").alias("_name"), F.col("balance").alias("_rating"))
    own = index_pairs(spark, sf_dir).drop("y").join(p.select("player", F.lower("name").alias("name")), "player")
    by_id, by_name = given.select(F.col("_id").alias("player"), F.col("_rating").alias("_a")), given.select(F.col("_name").alias("name"), F.col("_rating").alias("_b"))
    both = own.join(by_id, "player", "left").join(by_name, "name", "left").withColumn("y", F.coalesce("_a", "_b"))
    return both.filter("y is not null").select("player", "role", "x", "y")


@query("va_external_rating", f"WITH {RATED_SQL[5:]}, k AS (SELECT *, {rank_sql('x')} AS u, {rank_sql('y')} AS v FROM jo), c AS (SELECT u - avg(u) OVER (PARTITION BY role) AS u, v - avg(v) OVER (PARTITION BY role) AS v FROM k), l AS (SELECT a.player, corr(b.x, b.y) AS r FROM jo a JOIN jo b ON a.player <> b.player GROUP BY 1), e AS (SELECT quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM jo), {bootstrap_sql('jo', 'player', 100)} SELECT (SELECT count(*) FROM jo) AS n, (SELECT round(corr(x, y), 6) FROM jo) AS r, (SELECT round(corr(u, v), 6) FROM k) AS rho, (SELECT round(corr(u, v), 6) FROM c) AS partial, (SELECT round(max(r) - min(r), 6) FROM l) AS spread, (SELECT round((avg(y) FILTER (WHERE x >= hi) - avg(y) FILTER (WHERE x <= lo)) / sqrt((var_samp(y) FILTER (WHERE x >= hi) + var_samp(y) FILTER (WHERE x <= lo)) / 2), 6) FROM jo CROSS JOIN e) AS d, round(low, 6) AS low, round(high, 6) AS high FROM bq")
def va(spark, sf_dir):
    rows = cut(rated(spark, sf_dir))
    parts = [agreement(rows, "x", "y"), S.partial_spearman(rows, "x", "y", "role").select(F.col("rho").alias("partial")), S.leave_one_out(rows, "x", "y").select("spread"), effect(rows, "x", "y"), S.bootstrap_correlation(rows, "x", "y", "player", 100).select("low", "high")]
    return rounded(reduce(lambda a, b: a.join(b), parts), "r", "rho", "partial", "spread", "d", "low", "high")


@query("vb_overlap", f"WITH {RATED_SQL[5:]}, i AS (SELECT player, row_number() OVER (ORDER BY x DESC, player) AS k FROM z), o AS (SELECT player, row_number() OVER (ORDER BY y DESC, player) AS k FROM jo), f2 AS (SELECT player, row_number() OVER (ORDER BY x DESC, player) AS k FROM jo), n AS (SELECT count(*) AS n, (SELECT count(*) FROM f2 JOIN o USING (player) WHERE f2.k <= 10 AND o.k <= 10) AS c FROM jo), t AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) * sum(abs(sign(a.y - b.y)))) AS tau FROM jo a JOIN jo b ON a.player < b.player) SELECT (SELECT count(*) FROM i JOIN o USING (player) WHERE i.k <= 10 AND o.k <= 10) AS raw, c AS fair, (SELECT round(tau, 6) FROM t) AS tau, round(100.0 / n, 6) AS expected, round(list_sum(list_transform(range(c, 11), lambda q: exp(2 * lgamma(11) - 2 * lgamma(11 - q) - lgamma(q + 1) + 2 * lgamma(n - 9) - lgamma(n - 19 + q) - lgamma(n + 1)))), 6) AS p FROM n")
def vb(spark, sf_dir):
    """Ten best of both lists: among all players, among those both know, with the chance of as many by luck."""
    rows = cut(rated(spark, sf_dir))
    ten = lambda df, c: df.orderBy(F.col(c).desc(), "player").limit(10).select("player")
    raw = ten(index_pairs(spark, sf_dir), "x").join(ten(rows, "y"), "player").count()
    fair, n = ten(rows, "x").join(ten(rows, "y"), "player").count(), rows.count()
    tau = S.kendall(rows, "x", "y", "player").first()["tau"]
    k = min(10, n)
    expected, p = (round(k * k / n, 6), round(S.hypergeometric_tail(n, k, k, fair), 6)) if n else (None, None)
    return spark.createDataFrame([(raw, fair, None if tau is None else round(tau, 6), expected, p)], "raw long, fair long, tau double, expected double, p double")


@query("vb_top_ten", f"{INDEX_PAIR_SQL}, u AS (SELECT player, row_number() OVER (ORDER BY x DESC, player) AS k FROM z), v AS (SELECT player, row_number() OVER (ORDER BY y DESC, player) AS k FROM z) SELECT u.player, u.k AS place, v.k AS other FROM u JOIN v USING (player) WHERE u.k <= 10 AND abs(u.k - v.k) >= 4")
def vb(spark, sf_dir):
    z = place(place(index_pairs(spark, sf_dir), "x", ["player"], "place"), "y", ["player"], "other")
    return z.filter((F.col("place") <= 10) & (F.abs(F.col("place") - F.col("other")) >= 4)).select("player", "place", "other")


@query("vn_by_role", f"{INDEX_PAIR_SQL}, k AS (SELECT role, rank() OVER (PARTITION BY role ORDER BY x) AS u, rank() OVER (PARTITION BY role ORDER BY y) AS v FROM z) SELECT role, round(corr(u, v), 6) AS rho, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 8")
def vn(spark, sf_dir):
    return spearman(index_pairs(spark, sf_dir), "x", "y", ["role"]).filter("n >= 8").select("role", F.round("rho", 6).alias("rho"), "n")


@query("vf_team_validity", f"{INDEX_PAIR_SQL}, t AS (SELECT team, avg(x) AS x FROM z GROUP BY 1), c AS (SELECT opp AS team, CAST(sum(xg) AS DOUBLE) / count(*) AS y FROM f WHERE season = 1999 GROUP BY 1) SELECT round(corr(t.x, c.y), 6) AS r, count(*) AS n FROM t JOIN c USING (team)")
def vf(spark, sf_dir):
    t = index_pairs(spark, sf_dir).groupBy("team").agg(F.avg("x").alias("tx"))
    c = facts(spark, sf_dir).filter("season = 1999").groupBy(F.col("opp").alias("team")).agg(mean("xg").alias("cy"))
    return t.join(c, "team").agg(F.round(F.corr("tx", "cy"), 6).alias("r"), F.count("*").alias("n"))


HALVES_SQL = f"""WITH {FACTS_SQL}, hq AS (SELECT player, role, CAST(sum(xg) FILTER (WHERE rnd <= 6) AS DOUBLE) * 90 / sum(mins) FILTER (WHERE rnd <= 6) AS x, CAST(sum(xg) FILTER (WHERE rnd > 6) AS DOUBLE) * 90 / sum(mins) FILTER (WHERE rnd > 6) AS y, CAST(sum(xg) FILTER (WHERE rnd % 2 = 1) AS DOUBLE) / sum(mins) FILTER (WHERE rnd % 2 = 1) AS o, CAST(sum(xg) FILTER (WHERE rnd % 2 = 0) AS DOUBLE) / sum(mins) FILTER (WHERE rnd % 2 = 0) AS e, count(*) FILTER (WHERE rnd <= 6) AS m, count(*) FILTER (WHERE rnd > 6) AS n FROM f WHERE season = 1998 AND mins > 0 GROUP BY 1, 2), h AS (SELECT * FROM hq WHERE m >= 4 AND n >= 4)"""


def halves(spark, sf_dir):
    """Rates of the early and late rounds of a season, and of odd and even ones, for players with four games in each half."""
    part = lambda where, c: F.when(where, F.col(c))
    rate = lambda where: per90(part(where, "xg"), part(where, "mins"))
    early, odd = F.col("rnd") <= 6, F.col("rnd") % 2 == 1
    q = facts(spark, sf_dir).filter("season = 1998 and mins > 0").groupBy("player", "role").agg(rate(early).alias("x"), rate(~early).alias("y"), rate(odd).alias("o"), rate(~odd).alias("e"), F.count_if(early).alias("m"), F.count_if(~early).alias("n"))
    return q.filter("m >= 4 and n >= 4")


@query("vc_split_half", f"{HALVES_SQL}, k AS (SELECT *, {rank_sql('x')} AS u, {rank_sql('y')} AS v, {rank_sql('o')} AS s, {rank_sql('e')} AS t FROM h), ta AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(sum(abs(sign(a.x - b.x))) AS DOUBLE) * sum(abs(sign(a.y - b.y)))) AS tau FROM h a JOIN h b ON a.player < b.player), w AS (SELECT *, player % 5 AS fold, avg(y) OVER (PARTITION BY role) AS g FROM h), l AS (SELECT f.fold, regr_slope(w.y, w.x) AS b, regr_intercept(w.y, w.x) AS c FROM (SELECT DISTINCT fold FROM w) f JOIN w ON w.fold <> f.fold GROUP BY 1), lo AS (SELECT a.player, corr(b.x, b.y) AS r FROM h a JOIN h b ON a.player <> b.player GROUP BY 1) SELECT count(*) AS n, round(corr(u, v), 6) AS rho, (SELECT round(tau, 6) FROM ta) AS tau, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(sqrt(avg(pow(y - x, 2))), 6) AS rmse, round(avg(abs(y - x)), 6) AS mae, (SELECT round(1 - sum(pow(y - (c + b * x), 2)) / sum(pow(y - x, 2)), 6) FROM w JOIN l USING (fold)) AS skill_persistence, (SELECT round(1 - sum(pow(y - (c + b * x), 2)) / sum(pow(y - g, 2)), 6) FROM w JOIN l USING (fold)) AS skill_group, (SELECT round(max(r) - min(r), 6) FROM lo) AS spread, round(2 * corr(s, t) / (1 + corr(s, t)), 6) AS reliability FROM k")
def vc(spark, sf_dir):
    """What the first half of a season tells of the second, and how well odd rounds agree with even ones."""
    rows = cut(halves(spark, sf_dir))
    odd = agreement(rows, "o", "e").select((2 * F.col("rho") / (1 + F.col("rho"))).alias("reliability"))
    line = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("x"), 2))).alias("rmse"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mae"))
    skill = S.skill_scores(rows.withColumn("fold", F.col("player") % 5), "x", "y", "fold", "role").select("skill_persistence", "skill_group")
    parts = [agreement(rows, "x", "y").select("n", "rho"), S.kendall(rows, "x", "y", "player").select("tau"), line, skill, S.leave_one_out(rows, "x", "y").select("spread"), odd]
    found = reduce(lambda a, b: a.join(b), parts)
    return rounded(found, *[c for c in found.columns if c != "n"])


@query("vc_placebo", f"{HALVES_SQL}, dr AS (SELECT unnest(range(1, 101)) AS d), px AS (SELECT d, x, row_number() OVER (PARTITION BY d ORDER BY {uniform_sql(chr(39) + '42' + chr(39), chr(39) + 'x' + chr(39), 'CAST(d AS VARCHAR)', 'CAST(player AS VARCHAR)')}, player) AS k FROM h CROSS JOIN dr), py AS (SELECT d, y, row_number() OVER (PARTITION BY d ORDER BY {uniform_sql(chr(39) + '42' + chr(39), chr(39) + 'y' + chr(39), 'CAST(d AS VARCHAR)', 'CAST(player AS VARCHAR)')}, player) AS k FROM h CROSS JOIN dr), pr AS (SELECT d, corr(x, y) AS r FROM px JOIN py USING (d, k) GROUP BY 1), o AS (SELECT corr(x, y) AS observed FROM h) SELECT round(max(observed), 6) AS observed, round(avg(r), 6) AS null_mean, round(quantile_cont(abs(r), 0.95), 6) AS null_p95, round((count(*) FILTER (WHERE abs(r) >= abs(observed)) + 1) / (count(r) + 1.0), 6) AS p FROM pr CROSS JOIN o")
def vc_placebo(spark, sf_dir):
    return rounded(S.permutation(cut(halves(spark, sf_dir)), "x", "y", "player", 100), "observed", "null_mean", "null_p95", "p")


DIMS = ("output", "buildup", "centrality", "boost", "consistency", "finishing", "form")


def whole_scores(spark, sf_dir):
    """The seven scores of the whole season beside what the steps after the weighted mean need."""
    return kept(spark, ("whole_scores", sf_dir), lambda: R.scored(season_matches(spark, sf_dir), bodies(spark, sf_dir)).filter("ctx = 'total'"))


@query("vg_structure", f"WITH {SEASON_SQL}, tz AS (SELECT * FROM rw WHERE ctx = 'total'), lz2 AS (UNPIVOT (SELECT player, {', '.join(DIMS)} FROM tz) ON {', '.join(DIMS)} INTO NAME dim VALUE z) SELECT a.dim AS a, b.dim AS b, round(corr(a.z, b.z), 6) AS r, count(*) AS n FROM lz2 a JOIN lz2 b ON a.player = b.player AND a.dim < b.dim GROUP BY 1, 2 HAVING count(*) >= 5")
def vg(spark, sf_dir):
    """Correlations of the seven scores, pair by pair."""
    long = whole_scores(spark, sf_dir).unpivot(["player"], list(DIMS), "dim", "z").filter("z is not null")
    a, b = long.select("player", F.col("dim").alias("a"), F.col("z").alias("za")), long.select("player", F.col("dim").alias("b"), F.col("z").alias("zb"))
    return a.join(b, "player").filter("a < b").groupBy("a", "b").agg(F.round(F.corr("za", "zb"), 6).alias("r"), F.count("*").alias("n")).filter("n >= 5")


@query("vg_components")
def vg_components(spark, sf_dir):
    """Explained shares of the components of the seven scores over complete rows; tested against a decomposition by numpy."""
    explained, _ = S.principal_components(whole_scores(spark, sf_dir), list(DIMS), len(DIMS))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(explained, 1)], "component int, explained double")


WEIGHTS = R.RULES.weights
MOVES_SQL = ", ".join(f"{w}::DOUBLE * (1 + 0.2 * (2 * {uniform_sql(chr(39) + '42' + chr(39), 'CAST(d AS VARCHAR)', chr(39) + n + chr(39))} - 1)) AS w_{n}" for n, w in WEIGHTS.items())


@query("vh_sensitivity", f"WITH {SEASON_SQL}, dr AS (SELECT unnest(range(1, 61)) AS d), mw AS (SELECT d, {MOVES_SQL} FROM dr), mv AS (SELECT d, player, {' + '.join(f'coalesce({n}, 0) * {w / sum(WEIGHTS.values())!r}::DOUBLE' for n, w in WEIGHTS.items())} AS s, ({' + '.join(f'coalesce({n}, 0) * w_{n}' for n in WEIGHTS)}) / ({' + '.join(f'w_{n}' for n in WEIGHTS)}) AS t FROM rw CROSS JOIN mw WHERE ctx = 'total'), {moved_sql('s', 't', 'count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0 AS t10, count(*) FILTER (WHERE a <= 20 AND b <= 20) / 20.0 AS t20')} SELECT round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.05), 6) AS low, round(min(rho), 6) AS least, round(quantile_cont(t10, 0.5), 6) AS top10, CAST(min(t10) AS DOUBLE) AS top10_least, round(quantile_cont(t20, 0.5), 6) AS top20, CAST(min(t20) AS DOUBLE) AS top20_least FROM pd")
def vh(spark, sf_dir):
    """The ranking by the seven scores under weights moved by up to a fifth."""
    got = S.weight_sensitivity(whole_scores(spark, sf_dir).select("player", *DIMS), "player", WEIGHTS, 60)
    return rounded(got, "median", "low", "least", "top10", "top20")


ROLES_SQL = ", ".join(f"('{role}', {w}::DOUBLE)" for role, w in R.RULES.role_weights.items())


@query("vh_role_weights", f"WITH {SEASON_SQL}, rx AS (SELECT * FROM (VALUES {ROLES_SQL}) AS t(role, w)), z AS (SELECT player, role, i AS x FROM fx WHERE ctx = 'total' AND i IS NOT NULL), dr AS (SELECT unnest(range(1, 61)) AS d), mv AS (SELECT d, player, role, x AS s, x / w * w * (1 + 0.2 * (2 * {uniform_sql(chr(39) + '42' + chr(39), 'CAST(d AS VARCHAR)', 'role')} - 1)) AS t FROM z JOIN rx USING (role) CROSS JOIN dr), q AS (SELECT d, role, row_number() OVER (PARTITION BY d ORDER BY s DESC, player) AS a, row_number() OVER (PARTITION BY d ORDER BY t DESC, player) AS b FROM mv), qd AS (SELECT d, role, count(*) FILTER (WHERE a <= 20) AS q, count(*) FILTER (WHERE b <= 20) AS m FROM q GROUP BY 1, 2), {moved_sql('s', 't', 'count(*) FILTER (WHERE a <= 20 AND b <= 20) / 20.0 AS t20')}, qa AS (SELECT round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(t20, 0.5), 6) AS overlap FROM pd) SELECT role, max(q) AS quota, min(m) AS quota_least, max(m) AS quota_most, any_value(median) AS median, any_value(overlap) AS overlap FROM qd CROSS JOIN qa GROUP BY 1")
def vh_role_weights(spark, sf_dir):
    """Quotas of the roles among the best twenty by the index, and their range where each role's weight, divided out and put back, moves by up to a fifth."""
    rows = whole_scores(spark, sf_dir).filter("raw_ is not null").select("player", "role", "raw_")
    return rounded(S.role_weight_sensitivity(rows, "player", "raw_", "role", R.RULES.role_weights, 60), "median", "overlap")


ABLATED_SQL = " UNION ALL ".join(f"SELECT '{gone}' AS dropped, player, role, confidence, penalty, rolew, i, ({' + '.join(f'coalesce({n}, 0) * {w}' for n, w in WEIGHTS.items() if n != gone)}) / nullif(CAST({' + '.join(f'({n} IS NOT NULL)::INT * {w}' for n, w in WEIGHTS.items() if n != gone)} AS DOUBLE), 0) AS raw FROM ab" for gone in WEIGHTS)


@query("vo_ablation", f"WITH {SEASON_SQL}, ab AS (SELECT rw.* EXCLUDE (raw), confidence, penalty, rolew, i FROM rw JOIN fx USING (player, role, ctx) WHERE ctx = 'total'), av AS ({ABLATED_SQL}), aw AS (SELECT *, round(round(rolew * (mu + (0.35 + 0.65 * confidence) * (raw - mu)), 4) * penalty, 4) AS j FROM (SELECT *, avg(raw) OVER (PARTITION BY dropped, role) AS mu FROM av)), ak AS (SELECT *, {rank_sql('i', 'dropped')} AS u, {rank_sql('j', 'dropped')} AS v, row_number() OVER (PARTITION BY dropped ORDER BY i DESC, player) AS a, row_number() OVER (PARTITION BY dropped ORDER BY j DESC, player) AS b FROM aw) SELECT dropped, round(corr(u, v), 6) AS rho, count(*) FILTER (WHERE a <= 10 AND b <= 10) AS top10, count(*) AS n FROM ak GROUP BY 1")
def vo(spark, sf_dir):
    """The index without one dimension at a time, with every step after the weighted mean done again, against the whole index."""
    rows = whole_scores(spark, sf_dir)
    keep = ["player", "role", "confidence", "played", "available", F.col("raw_").alias("full")]
    parts = [rows.select(F.lit(gone).alias("dropped"), *keep, R.composite({n: F.col(n) for n in WEIGHTS if n != gone}, {n: w for n, w in WEIGHTS.items() if n != gone}).alias("raw")) for gone in WEIGHTS]
    many = cut(R.finished(reduce(lambda a, b: a.union(b), parts), "raw", ["dropped", "role"]).withColumnRenamed("dropped", "_draw").withColumnRenamed("raw_", "again"))
    got = S.moved_ranking(many, "player", "full", "again", (10,)).join(many.groupBy("_draw").agg(F.count("*").alias("n")), "_draw")
    return got.select(F.col("_draw").alias("dropped"), F.round("rho", 6).alias("rho"), F.round(F.col("top10") * 10).cast("long").alias("top10"), "n")


def errors_sql(x: str, p: str, y: str, where: str, key: str = "player", draws: int = 60) -> str:
    """Paired errors of x and p on y, over rows of iq; weights by `key`."""
    z = f"z AS (SELECT player, CAST({key} AS VARCHAR) AS team, {x} AS x, {p} AS p, {y} AS y FROM iq WHERE {where} AND {x} IS NOT NULL AND {p} IS NOT NULL AND {y} IS NOT NULL)"
    return f"WITH {z}, {PAIRED_SQL}, {paired_sql('team', draws)}"


LATER = "mins_later >= 90"
INCREMENT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS part, * FROM ({errors_sql('index', 'pro', 'later - before', f'{LATER} AND {where}', key)})"
    for name, where, key in (("as of 6", "as_of = 6", "player"), ("as of 9", "as_of = 9", "player"), ("pooled", "as_of IN (6, 9)", "player"), ("each row its own weight", "as_of IN (6, 9)", "player || '/' || as_of"), ("under 25", "as_of IN (6, 9) AND age < 25", "player"))
)
RECENT_SQL = f"re AS (SELECT player, CAST(sum(goal) AS DOUBLE) * 90 / sum(mins) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rnd DESC, fixture DESC, line DESC, part DESC) AS k FROM f WHERE season = 1999 AND mins > 0) WHERE k <= 6 GROUP BY 1 HAVING sum(mins) >= 120), rz AS (SELECT player, CAST(player AS VARCHAR) AS team, index AS x, pro AS p, recent AS y FROM iq JOIN re USING (player) WHERE as_of = 12)"


def errors(rows, x: str, p: str, y: str, key, draws: int = 60):
    """The row of paired errors of x and p on y, out of sample by folds of players, weights by `key`."""
    rows = cut(rows.select("player", F.col(x).alias("x"), F.col(p).alias("p"), y.alias("y"), key.cast("string").alias("key"), (F.col("player") % 5).alias("k")))
    return rounded(S.paired_rmse_bootstrap(rows, "x", "p", "y", "key", "k", draws, least=1), "rmse_base", "rmse_pro", "delta", "low", "high")


@query("vi_incremental", f"WITH {FACTS_SQL}, {outcomes_sql([6, 9, 12])}, {RECENT_SQL} {INCREMENT_SQL} UNION ALL SELECT 'in sample' AS part, * FROM (WITH z AS (SELECT * FROM rz), {PAIRED_SQL}, {paired_sql('team', 60)})")
def vi(spark, sf_dir):
    """How much less the index with its modulators errs on the later change than the index: at two vintages, over both with a weight a player,
    with a weight a row, and for players under 25; without vintages, on the last six games of the season."""
    later = outcomes(spark, sf_dir).filter(LATER)
    both, change, player = later.filter("as_of in (6, 9)"), F.col("later") - F.col("before"), F.col("player")
    recent = last_n(facts(spark, sf_dir).filter("season = 1999 and mins > 0"), ["player"], ["rnd", "fixture", "line", "part"], 6).groupBy("player").agg((F.sum("goal").cast("double") * 90 / F.sum("mins")).alias("recent"), F.sum("mins").alias("m")).filter("m >= 120")
    parts = [
        ("as of 6", later.filter("as_of = 6"), change, player), ("as of 9", later.filter("as_of = 9"), change, player), ("pooled", both, change, player),
        ("each row its own weight", both, change, F.concat_ws("/", "player", "as_of")), ("under 25", both.filter("age < 25"), change, player),
        ("in sample", outcomes(spark, sf_dir).filter("as_of = 12").join(recent, "player"), F.col("recent"), player),
    ]
    return reduce(lambda a, b: a.unionByName(b), [errors(rows, "index", "pro", y, key).withColumn("part", F.lit(name)) for name, rows, y, key in parts])


BASELINES, CRITERIA = {"output": "before", "minutes": "mins", "value": "worth"}, {"level": "later", "improvement": "later - before"}
BASELINE_SQL = " UNION ALL ".join(
    f"SELECT '{b}' AS baseline, '{c}' AS criterion, * FROM ({errors_sql(x, 'index', y, LATER + ' AND as_of IN (6, 9)').replace('FROM iq WHERE', 'FROM (SELECT iq.*, p_retailprice AS worth FROM iq LEFT JOIN part ON p_partkey = player) WHERE')})" for b, x in BASELINES.items() for c, y in CRITERIA.items()
)


@query("vq_beats_baseline", f"WITH {FACTS_SQL}, {outcomes_sql([6, 9])} {BASELINE_SQL}")
def vq(spark, sf_dir):
    """The index against three naive baselines on the later level and the later change, with a weight a player: above 0 where the index errs less."""
    worth = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), F.col("p_retailprice").cast("double").alias("worth"))
    rows = cut(outcomes(spark, sf_dir).filter(f"{LATER} and as_of in (6, 9)").join(worth, "player", "left"))
    made = [errors(rows, x, "index", F.expr(y), F.col("player")).withColumn("baseline", F.lit(b)).withColumn("criterion", F.lit(c)) for b, x in BASELINES.items() for c, y in CRITERIA.items()]
    return reduce(lambda a, b: a.unionByName(b), made)


PERSIST_SQL = f"""WITH {FACTS_SQL}, {outcomes_sql()}, q AS (SELECT * FROM iq), g AS (SELECT player, CAST(sum(CAST(index AS DECIMAL(10,4))) AS DOUBLE) / count(index) AS mean_v, min(index) AS min_v FROM q WHERE as_of <= 9 GROUP BY 1 HAVING count(index) >= 3), pv AS (SELECT player, index AS before FROM ({vintages_sql([1998], [12])})), j AS (SELECT g.player, mean_v, min_v, pv.before, later FROM g JOIN q ON q.player = g.player AND as_of = 9 LEFT JOIN pv ON pv.player = g.player WHERE later IS NOT NULL AND pv.before IS NOT NULL), k AS (SELECT player, {rank_sql('mean_v')} AS a, {rank_sql('min_v')} AS b, {rank_sql('before')} AS c, {rank_sql('later')} AS y FROM j)"""


@query("vp_persistence", f"{PERSIST_SQL}, x1 AS (SELECT player, a AS x, y FROM k), x2 AS (SELECT player, b AS x, y FROM k), {bootstrap_sql('x1', 'player', 60)}, {bootstrap_sql('x2', 'player', 60).replace('dr AS', 'dr2 AS').replace('FROM x2 CROSS JOIN dr', 'FROM x2 CROSS JOIN dr2').replace('bw', 'bw2').replace('bs AS', 'bs2 AS').replace('FROM bs ', 'FROM bs2 ').replace('br AS', 'br2 AS').replace('FROM br)', 'FROM br2)').replace('bq AS', 'bq2 AS').replace('SELECT (n', 'SELECT d, (n')}, d1 AS (SELECT d, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM bs), df AS (SELECT d1.r - br2.r AS g FROM d1 JOIN br2 USING (d)) SELECT (SELECT count(*) FROM k) AS n, (SELECT round(corr(a, y), 6) FROM k) AS rho_mean, (SELECT round(corr(b, y), 6) FROM k) AS rho_min, (SELECT round(corr(c, y), 6) FROM k) AS rho_before, round(quantile_cont(g, 0.025), 6) AS low, round(quantile_cont(g, 0.975), 6) AS high FROM df")
def vp(spark, sf_dir):
    """Mean and least index over three vintages, and the index of the season before, against what came after; the gain of the mean over the least with its interval."""
    q = outcomes(spark, sf_dir)
    g = q.filter("as_of <= 9").groupBy("player").agg(mean(F.col("index").cast("decimal(10,4)")).alias("mean_v"), F.min("index").alias("min_v"), F.count("index").alias("m")).filter("m >= 3")
    before = index_vintages(spark, sf_dir).filter("season = 1998 and as_of = 12 and index is not null").select("player", F.col("index").alias("before"))
    j = g.join(q.filter("as_of = 9 and later is not null").select("player", "later"), "player").join(before, "player")
    for c, r in (("mean_v", "a"), ("min_v", "b"), ("before", "c"), ("later", "y")):
        j = rank_average(j, c, [], r, floor=False)
    k = cut(j.select("player", "a", "b", "c", "y"))
    seen = k.agg(F.count("*").alias("n"), *[F.corr(c, "y").alias(n) for c, n in (("a", "rho_mean"), ("b", "rho_min"), ("c", "rho_before"))])
    return rounded(seen.join(S.bootstrap_gain(k, "a", "b", "y", "player", 60)), "rho_mean", "rho_min", "rho_before", "low", "high")


@query("vm_calibration", f"{INDEX_PAIR_SQL}, e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM z), b AS (SELECT CAST(1 + len(list_filter(e, lambda q: q < x)) AS INT) AS bin, avg(x) AS x, avg(y) AS y FROM z CROSS JOIN e GROUP BY 1), l AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS c, max(y) - min(y) AS w FROM b), k AS (SELECT {rank_sql('x')} AS u, {rank_sql('y')} AS v FROM b) SELECT round(any_value(s), 6) AS slope, round(avg(abs(y - (c + s * x))) / any_value(w), 6) AS ace, (SELECT round(corr(u, v), 6) FROM k) AS monotony, count(*) AS bins, (SELECT count(*) FROM (SELECT y - lag(y) OVER (ORDER BY bin) AS d FROM b) WHERE d < 0) AS drops FROM b CROSS JOIN l")
def vm(spark, sf_dir):
    """Deciles of the index against what follows: slope, mean error over the range, monotony, and how many deciles fall."""
    b = cut(S.quantile_bins(index_pairs(spark, sf_dir), "x", 10).groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
    line = b.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("_c"), (F.max("y") - F.min("y")).alias("_w"))
    ace = b.join(line).agg(F.first("slope").alias("slope"), (F.avg(F.abs(F.col("y") - (F.col("_c") + F.col("slope") * F.col("x")))) / F.first("_w")).alias("ace"), F.count("*").alias("bins"))
    mono = agreement(b, "x", "y").select(F.col("rho").alias("monotony"))
    after = b.select((F.col("bin") + 1).alias("bin"), F.col("y").alias("_before"))
    drops = b.join(after, "bin").agg(F.count_if(F.col("y") < F.col("_before")).alias("drops"))
    return rounded(ace.join(mono).join(drops), "slope", "ace", "monotony").select("slope", "ace", "monotony", "bins", "drops")


CONVERGE_SQL = f"WITH {FACTS_SQL}, {outcomes_sql()}, j AS (SELECT a.as_of, a.player, a.index AS x, b.index AS y FROM ix a JOIN ix b ON a.player = b.player AND b.as_of = 12 WHERE a.index IS NOT NULL AND b.index IS NOT NULL), k AS (SELECT *, {rank_sql('x', 'as_of')} AS u, {rank_sql('y', 'as_of')} AS t, row_number() OVER (PARTITION BY as_of ORDER BY x DESC, player) AS a, row_number() OVER (PARTITION BY as_of ORDER BY y DESC, player) AS b FROM j), c AS (SELECT as_of, round(corr(u, t), 6) AS rho, count(*) AS n, count(*) FILTER (WHERE a <= 25 AND b <= 25) AS top25, max(a - b) AS most_up, max(b - a) AS most_down FROM k GROUP BY 1 HAVING count(*) >= 20)"


def converged(spark, sf_dir):
    """Each vintage's ranking against the last one's."""
    q = index_vintages(spark, sf_dir).filter("season = 1999 and index is not null").select("as_of", "player", F.col("index").alias("v"))
    many = q.join(q.filter("as_of = 12").select("player", F.col("v").alias("y")), "player").withColumnRenamed("as_of", "_draw")
    n = many.groupBy("_draw").agg(F.count("*").alias("n")).filter("n >= 20")
    from pyspark.sql import Window

    by = Window.partitionBy("_draw")
    placed = many.withColumn("a", F.row_number().over(by.orderBy(F.col("v").desc(), "player"))).withColumn("b", F.row_number().over(by.orderBy(F.col("y").desc(), "player")))
    moved = placed.groupBy("_draw").agg(F.max(F.col("a") - F.col("b")).cast("long").alias("most_up"), F.max(F.col("b") - F.col("a")).cast("long").alias("most_down"))
    got = S.moved_ranking(many, "player", "v", "y", (25,)).join(n, "_draw").join(moved, "_draw")
    return got.select(F.col("_draw").alias("as_of"), F.round("rho", 6).alias("rho"), "n", F.round(F.col("top25") * 25).cast("long").alias("top25"), "most_up", "most_down")


@query("vl_convergence", f"{CONVERGE_SQL} SELECT * FROM c")
def vl(spark, sf_dir):
    return converged(spark, sf_dir)


@query("vl_across_seasons", f"WITH sx AS MATERIALIZED ({vintages_sql([1998, 1999], [12])}), j AS (SELECT a.player, a.index AS x, b.index AS y FROM sx a JOIN sx b ON a.player = b.player AND a.season = 1998 AND b.season = 1999 WHERE a.index IS NOT NULL AND b.index IS NOT NULL), k AS (SELECT {rank_sql('x')} AS u, {rank_sql('y')} AS v, row_number() OVER (ORDER BY x DESC, player) AS a, row_number() OVER (ORDER BY y DESC, player) AS b FROM j) SELECT round(corr(u, v), 6) AS rho, count(*) AS n, count(*) FILTER (WHERE a <= 25 AND b <= 25) AS top25 FROM k HAVING count(*) >= 10")
def vl_across(spark, sf_dir):
    """How far the final ranking of one season agrees with that of the season before, over players of both."""
    last = index_vintages(spark, sf_dir).filter("as_of = 12 and index is not null")
    both = cut(last.filter("season = 1998").select("player", F.col("index").alias("x")).join(last.filter("season = 1999").select("player", F.col("index").alias("y")), "player"))
    placed = place(place(both, "x", ["player"], "a"), "y", ["player"], "b").agg(F.count_if((F.col("a") <= 25) & (F.col("b") <= 25)).alias("top25"))
    return agreement(both, "x", "y").join(placed).filter("n >= 10").select(F.round("rho", 6).alias("rho"), "n", "top25")


@query("v_first_stable_round", f"{CONVERGE_SQL} SELECT min(as_of) AS earliest, min(as_of) FILTER (WHERE rho >= 0.85) AS first_stable, count(*) AS vintages FROM c")
def v_first(spark, sf_dir):
    """The earliest vintage, and the first whose ranking agrees with the last by 0.85 or more."""
    return converged(spark, sf_dir).agg(F.min("as_of").alias("earliest"), F.min(F.when(F.col("rho") >= 0.85, F.col("as_of"))).alias("first_stable"), F.count("*").alias("vintages"))


@query("vr_market_value", f"{INDEX_PAIR_SQL}, w AS (SELECT 'Supplier ' || s_suppkey || ' ' || s_suppkey AS name, s_acctbal AS worth FROM supplier WHERE s_suppkey % 4 <> 3), n AS (SELECT player, 'supplier ' || player AS key, x FROM z), k AS (SELECT {rank_sql('x')} AS u, {rank_sql('worth')} AS v FROM n JOIN (SELECT lower(split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2)) AS key, worth FROM w) USING (key)) SELECT round(corr(u, v), 6) AS rho, count(*) AS n FROM k HAVING count(*) >= 20")
def vr(spark, sf_dir):
    """The index against market values that are listed by name, with the last word of the name said twice."""
    p = players(spark, sf_dir).filter("player % 4 <> 3")
    listed = p.select(T.market_name(F.concat(F.lit("Suppliér "), F.col("player"), F.lit(" "), F.col("player"))).alias("key"), F.col("balance").alias("worth"))
    own = index_pairs(spark, sf_dir).select(F.concat(F.lit("supplier "), F.col("player")).alias("key"), "x")
    return agreement(cut(own.join(listed, "key")), "x", "worth").filter("n >= 20").select(F.round("rho", 6).alias("rho"), "n")


INDEXED_SQL = f"WITH {SEASON_SQL}, g AS (SELECT player, max(i) AS index, max(p) AS pro FROM fx WHERE ctx = 'total' GROUP BY 1), ix AS (SELECT player, index, pro, row_number() OVER (ORDER BY index DESC, player) AS a, row_number() OVER (ORDER BY pro DESC, player) AS b, {rank_sql('index')} AS u, {rank_sql('pro')} AS v FROM g)"


def indexed(spark, sf_dir):
    """Places by the index and by the index with its modulators."""
    rows = whole_scores(spark, sf_dir).select("player", F.col("raw_").alias("index"), F.col("pro_").alias("pro"), "age_index", "reliability")
    return cut(place(place(cut(rows), "index", ["player"], "a"), "pro", ["player"], "b"))


@query("vd_movers", f"{INDEXED_SQL} (SELECT player, a - b AS moved, 'up' AS kind FROM ix ORDER BY moved DESC, player LIMIT 8) UNION ALL (SELECT player, a - b AS moved, 'down' FROM ix ORDER BY moved, player LIMIT 8)")
def vd_movers(spark, sf_dir):
    """The eight players that the modulators lift most, and the eight they lower most."""
    moved = indexed(spark, sf_dir).select("player", (F.col("a") - F.col("b")).alias("moved"))
    up = moved.orderBy(F.col("moved").desc(), "player").limit(8).withColumn("kind", F.lit("up"))
    return up.union(moved.orderBy("moved", "player").limit(8).withColumn("kind", F.lit("down")))


@query("vd_agreement", f"{INDEXED_SQL} SELECT (SELECT count(*) FROM ix) AS n, (SELECT round(corr(index, pro), 6) FROM ix) AS r, (SELECT round(corr(u, v), 6) FROM ix) AS rho, (SELECT count(*) FROM ix WHERE abs(a - b) > 2) AS moved, (SELECT round(corr(index, z), 6) FROM ix JOIN (SELECT player, age_index AS z FROM uw) USING (player)) AS r_age, (SELECT round(corr(index, z), 6) FROM ix JOIN (SELECT player, reliability AS z FROM uw) USING (player)) AS r_reliability")
def vd_agreement(spark, sf_dir):
    """How far the two rankings agree, how many players move by more than two places, and what age and fitness have to do with the index."""
    rows = indexed(spark, sf_dir)
    seen = rows.agg(F.count_if(F.abs(F.col("a") - F.col("b")) > 2).alias("moved"), F.corr("index", "age_index").alias("r_age"), F.corr("index", "reliability").alias("r_reliability"))
    return rounded(agreement(rows, "index", "pro").join(seen), "r", "rho", "r_age", "r_reliability")


@query("v_dataset_facts", f"WITH {FACTS_SQL}, {MATCHES_SQL} SELECT count(*) AS rows, count(DISTINCT player) AS players, count(DISTINCT team) AS teams, count(DISTINCT fixture) AS fixtures, count(DISTINCT season) AS seasons, max(rnd) AS last_round FROM m")
def v_facts(spark, sf_dir):
    """What everything else is computed from, counted and not written down."""
    distinct = lambda c, n: F.countDistinct(c).alias(n)
    return matches(facts(spark, sf_dir)).agg(F.count("*").alias("rows"), distinct("player", "players"), distinct("team", "teams"), distinct("fixture", "fixtures"), distinct("season", "seasons"), F.max("rnd").alias("last_round"))


#: figures that are shown large: their name, the verification, its column
HEADLINES = {
    "halves_rho": ("vc_split_half", "rho"), "monotony": ("vm_calibration", "monotony"), "calibration_error": ("vm_calibration", "ace"), "first_round": ("v_first_stable_round", "earliest"),
    "first_stable": ("v_first_stable_round", "first_stable"), "across_seasons": ("vl_across_seasons", "rho"), "team_r": ("vf_team_validity", "r"), "overlap": ("vb_overlap", "fair"), "weights_median": ("vh_sensitivity", "median"),
}


def synthesis_sql() -> str:
    """Every headline out of its verification's own SQL."""
    told = [f"(SELECT round({column}, 3) FROM ({ORACLES[name]})) AS {title}" for title, (name, column) in HEADLINES.items()]
    told += [f"(SELECT {pick}(dropped, rho) FROM ({ORACLES['vo_ablation']})) AS {title}" for title, pick in (("most_useful", "arg_min"), ("least_useful", "arg_max"))]
    told += [f"(SELECT count(*) FILTER (WHERE better AND criterion = '{c}') FROM ({ORACLES['vq_beats_baseline']})) AS beaten_on_{c}" for c in CRITERIA]
    return "SELECT " + ", ".join(told)


@query("v_synthesis", synthesis_sql())
def v_synthesis(spark, sf_dir):
    """One row of the figures that say most: of halves, calibration, convergence, teams, overlap, weights, ablation and baselines."""
    frames: dict = {}
    for title, (name, column) in HEADLINES.items():
        frames.setdefault(name, []).append(F.round(column, 3).alias(title))
    parts = [QUERIES[name](spark, sf_dir).select(*columns) for name, columns in frames.items()]
    parts.append(QUERIES["vo_ablation"](spark, sf_dir).agg(F.min_by("dropped", "rho").alias("most_useful"), F.max_by("dropped", "rho").alias("least_useful")))
    parts.append(QUERIES["vq_beats_baseline"](spark, sf_dir).agg(*[F.count_if(F.col("better") & (F.col("criterion") == c)).alias(f"beaten_on_{c}") for c in CRITERIA]))
    return reduce(lambda a, b: a.join(b, how="cross"), [cut(p) for p in parts])
