"""Statistics, text, data quality, platform, validation and serving queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import joins as J
from touchline.operators import platform as P
from touchline.operators import quality as Q
from touchline.operators import rating as R
from touchline.operators import serving as V
from touchline.operators import statistics as S
from touchline.operators.cuts import cut
from touchline.operators.measures import mean, per90, total
from touchline.operators.ordered import quantiles, with_groups
from touchline.operators.selection import best_trio, cheapest_trio

from .binding import FACTS_SQL, FIXTURES_SQL, PLAYERS_SQL, RUNS_SQL, facts, fixtures, players, runs, table
from .registry import query
from .scans import LEADERBOARD_SQL, player_totals

PAIR_SQL = f"{LEADERBOARD_SQL}, z AS (SELECT p.player, role, team, g * 90 / m AS x, h * 90 / m AS y FROM p JOIN a ON p.player = a.player)"


def pairs(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player")
    return t.select("player", "role", "team", (F.col("xg") * 90 / F.col("mins")).alias("x"), (F.col("xa") * 90 / F.col("mins")).alias("y"))


@query("m12_pearson", f"{PAIR_SQL} SELECT role, round(corr(x, y), 6) AS r, count(*) AS n FROM z GROUP BY role HAVING count(*) >= 3")
def m12(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("role").agg(F.round(F.corr("x", "y"), 6).alias("r"), F.count("*").alias("n")).filter("n >= 3")


@query("m12_kendall", f"{PAIR_SQL} SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 6) AS tau, (SELECT count(*) FROM z) AS n FROM z a JOIN z b ON a.player < b.player")
def m12k(spark, sf_dir):
    return S.kendall(pairs(spark, sf_dir), "x", "y", "player").select(F.round("tau", 6).alias("tau"), "n")


def uniform_sql(*parts: str) -> str:
    return "(CAST('0x' || substr(md5(concat_ws('/', " + ", ".join(parts) + ")), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


def poisson_sql(u: str) -> str:
    return f"len(list_filter([{', '.join(repr(e) for e in S.POISSON)}]::DOUBLE[], lambda e: e <= {u}))"


def bootstrap_sql(source: str, key: str, draws: int) -> str:
    """From a table `source` (x, y and the key): the interval of the correlation under the same weights."""
    return f"""dr AS (SELECT unnest(range(1, {draws + 1})) AS d), bw AS (SELECT d, x, y, {poisson_sql(uniform_sql("'42'", "CAST(d AS VARCHAR)", f"CAST({key} AS VARCHAR)"))} AS w FROM {source} CROSS JOIN dr),
 bs AS (SELECT d, CAST(sum(w) AS DOUBLE) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM bw GROUP BY 1),
 br AS (SELECT (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM bs WHERE n * sxx - sx * sx > 1e-9 * n * sxx AND n * syy - sy * sy > 1e-9 * n * syy),
 bq AS (SELECT quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high, count(r) AS draws FROM br)"""


@query("m13_bootstrap", f"{PAIR_SQL}, {bootstrap_sql('z', 'player', 300)} SELECT (SELECT count(*) FROM z) AS n, round((SELECT corr(x, y) FROM z), 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, draws FROM bq")
def m13(spark, sf_dir):
    return rounded(S.bootstrap_correlation(pairs(spark, sf_dir), "x", "y", "player", 300), "estimate", "low", "high")


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("m14_leave_one_out", f"{PAIR_SQL}, l AS (SELECT a.player, corr(b.x, b.y) AS r FROM z a JOIN z b ON a.player <> b.player GROUP BY 1) SELECT round(min(r), 6) AS low, round(max(r), 6) AS high, round(max(r) - min(r), 6) AS spread FROM l")
def m14(spark, sf_dir):
    return S.leave_one_out(pairs(spark, sf_dir), "x", "y").select(*[F.round(c, 6).alias(c) for c in ("low", "high", "spread")])


@query("m15_partial_spearman", f"{PAIR_SQL}, k AS (SELECT role, rank() OVER (ORDER BY x DESC) AS u, rank() OVER (ORDER BY y DESC) AS v FROM z), c AS (SELECT u - avg(u) OVER (PARTITION BY role) AS u, v - avg(v) OVER (PARTITION BY role) AS v FROM k) SELECT round(corr(u, v), 6) AS rho, count(*) AS n FROM c")
def m15(spark, sf_dir):
    return S.partial_spearman(pairs(spark, sf_dir), "x", "y", "role").select(F.round("rho", 6).alias("rho"), "n")


@query("m17_cross_validation", f"{PAIR_SQL}, w AS (SELECT *, player % 5 AS k, avg(y) OVER (PARTITION BY role) AS g FROM z), l AS (SELECT f.k, regr_slope(w.y, w.x) AS b, regr_intercept(w.y, w.x) AS c FROM (SELECT DISTINCT k FROM w) f JOIN w ON w.k <> f.k GROUP BY 1) SELECT count(*) AS n, round(sqrt(avg(pow(y - (c + b * x), 2))), 6) AS rmse, round(1 - sum(pow(y - (c + b * x), 2)) / sum(pow(y - x, 2)), 6) AS skill_persistence, round(1 - sum(pow(y - (c + b * x), 2)) / sum(pow(y - g, 2)), 6) AS skill_group FROM w JOIN l USING (k)")
def m17(spark, sf_dir):
    """Out-of-sample error of a line in five folds, and its skill against x itself and against the role's mean (m17, m18)."""
    return rounded(S.skill_scores(pairs(spark, sf_dir).withColumn("k", F.col("player") % 5), "x", "y", "k", "role"), "rmse", "skill_persistence", "skill_group")


@query("m19_permutation", f"{PAIR_SQL}, dr AS (SELECT unnest(range(1, 201)) AS d), px AS (SELECT d, x, row_number() OVER (PARTITION BY d ORDER BY {uniform_sql("'42'", "'x'", 'CAST(d AS VARCHAR)', 'CAST(player AS VARCHAR)')}, player) AS k FROM z CROSS JOIN dr), py AS (SELECT d, y, row_number() OVER (PARTITION BY d ORDER BY {uniform_sql("'42'", "'y'", 'CAST(d AS VARCHAR)', 'CAST(player AS VARCHAR)')}, player) AS k FROM z CROSS JOIN dr), pr AS (SELECT d, corr(x, y) AS r FROM px JOIN py USING (d, k) GROUP BY 1), o AS (SELECT corr(x, y) AS observed FROM z) SELECT round(max(observed), 6) AS observed, round(avg(r), 6) AS null_mean, round(quantile_cont(abs(r), 0.95), 6) AS null_p95, round((count(*) FILTER (WHERE abs(r) >= abs(observed)) + 1) / (count(r) + 1.0), 6) AS p FROM pr CROSS JOIN o")
def m19(spark, sf_dir):
    return rounded(S.permutation(pairs(spark, sf_dir), "x", "y", "player", 200), "observed", "null_mean", "null_p95", "p")


FOLDED_SQL = f"cf AS (SELECT *, CAST(floor({uniform_sql(chr(39) + 'fold' + chr(39), 'CAST(team AS VARCHAR)')} * 5) AS BIGINT) AS k FROM z), cl AS (SELECT f.k, regr_slope(w.y, w.x) AS b, regr_intercept(w.y, w.x) AS c FROM (SELECT DISTINCT k FROM cf) f JOIN cf w ON w.k <> f.k GROUP BY 1)"


def team_folds(rows):
    """Five folds of whole teams."""
    return rows.withColumn("k", F.floor(S.uniform("fold", F.col("team")) * 5))


@query("m22_cluster_bootstrap", f"{PAIR_SQL}, {FOLDED_SQL}, {bootstrap_sql('z', 'team', 300)} SELECT (SELECT count(*) FROM z) AS n, round((SELECT corr(x, y) FROM z), 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high, draws, (SELECT round(sqrt(avg(pow(y - (c + b * x), 2))), 6) FROM cf JOIN cl USING (k)) AS rmse FROM bq")
def m22(spark, sf_dir):
    """Weights by team, and the error of a line out of sample in folds of whole teams."""
    rows = pairs(spark, sf_dir)
    told = S.cross_validated(team_folds(rows), "x", "y", "k").agg(F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("predicted"), 2))), 6).alias("rmse"))
    return rounded(S.bootstrap_correlation(rows, "x", "y", "team", 300), "estimate", "low", "high").join(told)


@query("m25_team_correlation", f"{PAIR_SQL}, t AS (SELECT team, avg(x) AS x, avg(y) AS y FROM z GROUP BY 1) SELECT round(corr(x, y), 6) AS r, count(*) AS n FROM t")
def m25(spark, sf_dir):
    t = pairs(spark, sf_dir).groupBy("team").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return t.agg(F.round(F.corr("x", "y"), 6).alias("r"), F.count("*").alias("n"))


@query("m27_distribution_shift", f"{PAIR_SQL} SELECT round(abs(avg(y) - avg(x)) / abs(avg(x)), 6) AS mean_shift, round(abs(stddev_pop(y) - stddev_pop(x)) / stddev_pop(x), 6) AS sd_shift, round(abs(quantile_cont(y, 0.95) - quantile_cont(x, 0.95)) / quantile_cont(x, 0.95), 6) AS p95_shift FROM z")
def m27(spark, sf_dir):
    def shift(f):
        return F.round(F.abs(f("y") - f("x")) / F.abs(f("x")), 6)

    rows = pairs(spark, sf_dir)
    tail = quantiles(rows.unpivot([], ["x", "y"], "side", "v"), ["side"], "v", [0.95])
    p95 = lambda side: F.max(F.when(F.col("side") == side, F.col("q")[0]))
    return rows.agg(shift(F.avg).alias("mean_shift"), shift(F.stddev_pop).alias("sd_shift")).join(tail.agg(shift(p95).alias("p95_shift")))


@query("m28_relative_spread", f"WITH {FACTS_SQL}, q AS (SELECT player, season, CAST(sum(xg) AS DOUBLE) / count(*) AS v FROM f GROUP BY 1, 2) SELECT player, round((max(v) - min(v)) / abs(avg(v)), 6) AS spread FROM q GROUP BY 1")
def m28(spark, sf_dir):
    q = facts(spark, sf_dir).groupBy("player", "season").agg(mean("xg").alias("v"))
    return q.groupBy("player").agg(F.round((F.max("v") - F.min("v")) / F.abs(F.avg("v")), 6).alias("spread"))


@query("m29_severity", f"WITH {RUNS_SQL}, s AS (SELECT stage, avg(CAST(duration AS DOUBLE)) AS mu, stddev_pop(CAST(duration AS DOUBLE)) AS sd FROM r GROUP BY 1), z AS (SELECT run, abs((CAST(duration AS DOUBLE) - mu) / sd) AS z FROM r JOIN s USING (stage)) SELECT run, CASE WHEN z >= 4 THEN 'critical' ELSE 'warn' END AS severity, round(least(1, 0.5 + 0.5 * (z - 2.5) / 1.5), 6) AS trust FROM z WHERE z >= 2.5")
def m29(spark, sf_dir):
    d, rows = F.col("duration").cast("double"), runs(spark, sf_dir)
    z = with_groups(rows, rows.groupBy("stage").agg(F.avg(d).alias("mu"), F.stddev_pop(d).alias("sd")), ["stage"])
    z = z.withColumn("z", (d - F.col("mu")) / F.col("sd")).filter(F.abs("z") >= 2.5)
    return z.select("run", P.severity(F.col("z")).alias("severity"), F.round(P.trust(F.col("z")), 6).alias("trust"))


@query("m30_cohens_d", f"{PAIR_SQL}, q AS (SELECT quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM z) SELECT round((avg(y) FILTER (WHERE x >= hi) - avg(y) FILTER (WHERE x <= lo)) / sqrt((var_samp(y) FILTER (WHERE x >= hi) + var_samp(y) FILTER (WHERE x <= lo)) / 2), 6) AS d FROM z CROSS JOIN q")
def m30(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    edge = quantiles(rows, [], "x", [0.25, 0.75]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    top, low = F.when(F.col("x") >= F.col("hi"), F.col("y")), F.when(F.col("x") <= F.col("lo"), F.col("y"))
    return rows.join(edge).agg(F.round((F.avg(top) - F.avg(low)) / F.sqrt((F.var_samp(top) + F.var_samp(low)) / 2), 6).alias("d"))


@query("m32_above_expectation", f"WITH {FACTS_SQL}, a AS (SELECT player, CAST(sum(xg) AS DOUBLE) * 90 / sum(mins) AS v FROM f GROUP BY 1), b AS (SELECT player, CAST(sum(xg) AS DOUBLE) * 90 / sum(mins) AS v FROM f WHERE season = 2000 GROUP BY 1) SELECT player, round(b.v - a.v, 6) AS above FROM a JOIN b USING (player)")
def m32(spark, sf_dir):
    rows = facts(spark, sf_dir)
    every = rows.groupBy("player").agg(per90("xg", "mins").alias("a"))
    one = rows.filter("season = 2000").groupBy("player").agg(per90("xg", "mins").alias("b"))
    return every.join(one, "player").select("player", F.round(F.col("b") - F.col("a"), 6).alias("above"))


@query("m34_health", "SELECT user_id AS owner, CAST(greatest(0, least(100, 100 - sum(CASE WHEN value > 150 THEN 20 WHEN value > 140 THEN 5 ELSE 0 END))) AS BIGINT) AS score FROM events WHERE event_type = 'error' GROUP BY 1")
def m34_all(spark, sf_dir):
    """All errors, scored by owner: one score of the whole table would sit at its floor."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    severity = F.when(F.col("value") > 150, "critical").when(F.col("value") > 140, "high").otherwise("none")
    return Q.health(e.select(F.col("user_id").alias("owner"), severity.alias("severity")), {"critical": 20, "high": 5}, ("owner",))


@query("f2_unicode_fold")
def f2_all(spark, sf_dir):
    """The whole text of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_unicode("text").alias("name"))


@query("f4_latin_fold", "SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[''.]', '', 'g'), '[-\\s]+', ' ', 'g')) AS name FROM documents")
def f4_all(spark, sf_dir):
    """The whole text of every document of any language or none; a null text stays null."""
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_latin(F.col("text")).alias("name"))


@query("f6_slug", "SELECT p_partkey AS part, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def f6(spark, sf_dir):
    # a file may be one task to read; the work on names is dealt to all
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(F.col("p_partkey").alias("part"), T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("f7_display_name", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 AND contains(lower(c_name), 'customer') THEN c_name ELSE c_name || ' ' || c_mktsegment END AS name FROM customer")
def f7(spark, sf_dir):
    last = F.when(F.col("c_custkey") % 3 == 1, F.lit("Customer")).when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.display_name(F.col("c_name"), last).alias("name"))


@query("f8_clean_name", "SELECT s_suppkey AS player, trim(replace(s_name, '#', '')) AS name, list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'nbsp' END, CASE WHEN s_suppkey % 3 = 0 THEN 'shy' END, 'zero-width', CASE WHEN s_suppkey % 5 = 0 THEN 'control' END, 'space'], lambda c: c IS NOT NULL) AS reasons FROM supplier")
def f8(spark, sf_dir):
    """Cleaned names beside the reasons why they had to be."""
    k = F.col("s_suppkey")
    mark = lambda n, text: F.when(k % n == 0, text).otherwise("")
    dirty = F.concat(F.lit(" "), F.replace(F.col("s_name"), F.lit("#"), F.lit("\u200b")), mark(3, "\u00ad"), mark(2, "\u00a0"), mark(5, "\x07"))
    return table(spark, sf_dir, "supplier").select(k.alias("player"), T.clean_name(F.regexp_replace(dirty, "\\x07", "")).alias("name"), T.invisible(dirty).alias("reasons"))


@query("f1_role_key", "SELECT c_custkey AS id, lower(trim(c_name)) || ' & co' AS key FROM customer")
def f1(spark, sf_dir):
    """Keys of names with character references, marks and letters beyond ASCII."""
    dirty = F.concat(F.lit(" "), F.replace(F.col("c_name"), F.lit("e"), F.lit("é")), F.lit(" &amp; co漢 "))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.role_key(dirty).alias("key"))


@query("f3_audit_fold", "SELECT c_custkey AS id, lower(c_name) || ' of x' AS name FROM customer")
def f3(spark, sf_dir):
    """Names with tabs, controls, marks and invisible characters."""
    dirty = F.concat(F.replace(F.col("c_name"), F.lit("u"), F.lit("ü\u200b")), F.lit("\tof\x07\x07X "))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.fold_audit(dirty).alias("name"))


@query("f10_season_arithmetic", "SELECT o_orderkey AS fixture, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INT) AS start, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS label FROM orders")
def f10(spark, sf_dir):
    start = T.season_of(F.col("o_orderdate")).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture"), start.alias("start"), T.season_label(start).alias("label"))


@query("f11_age", "SELECT o_orderkey AS fixture, round(date_diff('day', DATE '1970-03-01', CAST(o_orderdate AS DATE)) / 365.25, 2) AS age FROM orders")
def f11(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture"), T.age_in_years(F.lit("1970-03-01").cast("date"), F.to_date("o_orderdate")).alias("age"))


@query("f12_age_hours", "SELECT event_id AS run, date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') // 3600 AS hours FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY")
def f12(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= now - F.expr("interval 3 days"))
    return e.select(F.col("event_id").alias("run"), F.floor(F.timestamp_diff("SECOND", F.date_trunc("second", "ts").cast("timestamp_ntz"), now) / 3600).cast("long").alias("hours"))


@query("f13_role_from_positions", f"WITH {FACTS_SQL}, q AS (SELECT player, CASE WHEN opp % 4 = 0 THEN 'B' WHEN opp % 4 = 1 THEN 'D' WHEN opp % 4 = 2 THEN 'C' ELSE 'A' END AS bucket, sum(mins) AS m FROM f GROUP BY 1, 2), w AS (SELECT player, coalesce(sum(m) FILTER (WHERE bucket = 'B'), 0) AS b, coalesce(sum(m) FILTER (WHERE bucket = 'D'), 0) AS d, coalesce(sum(m) FILTER (WHERE bucket = 'C'), 0) AS c, coalesce(sum(m) FILTER (WHERE bucket = 'A'), 0) AS a FROM q GROUP BY 1), r AS (SELECT player, d + CASE WHEN c + a >= b THEN 0 ELSE b END AS d, c + CASE WHEN c + a >= b THEN b ELSE 0 END AS c, a FROM w) SELECT player, CASE WHEN greatest(d, c, a) < 200 THEN NULL WHEN d >= c AND d >= a THEN 'DEF' WHEN c >= a THEN 'MID' ELSE 'FWD' END AS role FROM r")
def f13(spark, sf_dir):
    """Role by minutes in position buckets; wing-backs count for the midfield where that and attack have as many minutes."""
    side = F.when(F.col("opp") % 4 == 0, "B").when(F.col("opp") % 4 == 1, "D").when(F.col("opp") % 4 == 2, "C").otherwise("A")
    w = facts(spark, sf_dir).groupBy("player").agg(*[F.coalesce(F.sum(F.when(side == k, F.col("mins"))), F.lit(0)).alias(k) for k in "BDCA"])
    up = F.col("C") + F.col("A") >= F.col("B")
    w = w.select("player", (F.col("D") + F.when(up, 0).otherwise(F.col("B"))).alias("d"), (F.col("C") + F.when(up, F.col("B")).otherwise(0)).alias("c"), F.col("A").alias("a"))
    best = F.greatest("d", "c", "a")
    return w.select("player", F.when(best < 200, None).when(F.col("d") == best, "DEF").when(F.col("c") == best, "MID").otherwise("FWD").alias("role"))


@query("f15_role_precedence", f"WITH {FACTS_SQL}, o AS (SELECT player, arg_max(CASE WHEN opp % 3 = 0 THEN 'DEF' WHEN opp % 3 = 1 THEN 'MID' ELSE 'FWD' END, mins * 1000000 + fixture) AS seen, sum(mins) AS m FROM f WHERE season = 2001 GROUP BY 1) SELECT p.player, coalesce(CASE WHEN p.player % 13 = 0 THEN 'FWD' END, CASE WHEN m >= 2000 THEN seen END, CASE WHEN p.player % 4 = 2 AND coalesce(m, 0) >= 1 THEN seen END, CASE WHEN p.player % 4 <> 2 THEN p.role END) AS role FROM p LEFT JOIN o USING (player)")
def f15(spark, sf_dir):
    """An override, else the observed role with enough minutes, else for blank ones the observed with any, else the registry's."""
    side = F.when(F.col("opp") % 3 == 0, "DEF").when(F.col("opp") % 3 == 1, "MID").otherwise("FWD")
    seen = facts(spark, sf_dir).filter("season = 2001").groupBy("player").agg(F.max_by(side, F.col("mins") * 1000000 + F.col("fixture")).alias("seen"), F.sum("mins").alias("m"))
    p = players(spark, sf_dir).select("player", F.when(F.col("player") % 4 != 2, F.col("role")).alias("registry"), F.when(F.col("player") % 13 == 0, "FWD").alias("override"))
    return p.join(seen, "player", "left").select("player", R.role_by_precedence(F.col("override"), F.col("seen"), F.col("m"), F.col("registry"), 2000).alias("role"))


@query("f17_entity_resolution", f"WITH {PLAYERS_SQL}, t AS (SELECT player, name, 'T' || team AS team FROM p), q AS (SELECT lower(name) AS name, CASE WHEN player % 3 = 1 THEN team WHEN player % 6 = 2 THEN lower(team) WHEN player % 3 = 2 THEN 'X' END AS team FROM t UNION ALL SELECT 'nobody', 'T1'), j AS (SELECT q.*, t.player, CASE WHEN q.team = t.team THEN 1.0 WHEN t.player IS NULL THEN 0.0 WHEN q.team IS NULL THEN 0.6 WHEN lower(q.team) = lower(t.team) THEN 0.95 ELSE 0.0 END AS c FROM q LEFT JOIN t ON q.name = lower(t.name)) SELECT name, team, CASE WHEN c > 0 THEN player END AS id, CASE WHEN c > 0 THEN 'OK' WHEN player IS NULL THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CAST(c AS DOUBLE) AS confidence, CASE WHEN c > 0 THEN NULL WHEN player IS NULL THEN CAST([] AS BIGINT[]) ELSE [player] END AS candidates FROM j")
def f17(spark, sf_dir):
    """Names with their team, with another spelling of it, with another team, and without one."""
    p = players(spark, sf_dir).withColumn("team", F.concat(F.lit("T"), "team"))
    k = F.col("player")
    asked = p.select(F.lower("name").alias("name"), F.when(k % 3 == 1, F.col("team")).when(k % 6 == 2, F.lower("team")).when(k % 3 == 2, "X").alias("team")).union(spark.createDataFrame([("nobody", "T1")], "name string, team string"))
    return Q.resolve_entities(asked, p.select(k.alias("id"), "name", "team", k.alias("at")), F.lower)


@query("f18_finite", "SELECT event_id AS run, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def f18_all(spark, sf_dir):
    from touchline.sources.sinks import clean

    e = table(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return clean(e.select(F.col("event_id").alias("run"), bad.alias("value")))


@query("f21_regex_extract", "SELECT page_id, list_transform(regexp_extract_all(url, '[0-9]+'), lambda s: CAST(s AS BIGINT)) AS numbers FROM pages")
def f21(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)).cast("array<bigint>").alias("numbers"))


@query("d2_natural_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d2(spark, sf_dir):
    return Q.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d3_foreign_keys", "SELECT 'orders.customer' AS code, 'critical' AS severity, count(*) AS n FROM orders WHERE o_custkey + 700 NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0 UNION ALL SELECT 'lineitem.orders', 'critical', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0")
def d3(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") + 700)
    return Q.report([Q.finding(Q.orphans(o, "k", table(spark, sf_dir, "customer"), "c_custkey"), "orders.customer", "critical"), Q.finding(Q.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey"), "lineitem.orders", "critical")])


@query("d4_duplicate_names", "WITH k AS (SELECT p_partkey AS id, p_brand AS team, lower(trim(p_name)) AS name, 'name' AS kind FROM part UNION SELECT p_partkey, p_brand, lower(trim(p_name)) || ' ' || lower(split_part(p_type, ' ', 1)), 'full' FROM part) SELECT kind, name, team, count(DISTINCT id) AS ids FROM k GROUP BY ALL HAVING count(DISTINCT id) > 1")
def d4(spark, sf_dir):
    """One name, or name and surname, in one team under several ids; both keys of a row at once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.col("p_name"), F.lit("​ ")).alias("name"), F.split("p_type", " ")[0].alias("surname"), F.col("p_brand").alias("team"))
    return Q.same_names(p, T.fold_unicode)


@query("d7_aggregate_mismatch", f"WITH {FACTS_SQL}, s AS (SELECT player, sum(mins) AS m, CAST(sum(xg) AS DOUBLE) AS x FROM f WHERE season = 1997 GROUP BY 1), c AS (SELECT p.player, CAST(p.player * 25 AS DOUBLE) AS sm, CAST(p.player AS DOUBLE) AS sx, CAST(coalesce(m, 0) AS DOUBLE) AS m, coalesce(x, 0) AS x FROM p LEFT JOIN s ON s.player = p.player) SELECT player, 'CON-001' AS code, sm AS stated, m AS summed FROM c WHERE abs(sm - m) > 30 UNION ALL SELECT player, 'CON-003', sx, round(x, 6) FROM c WHERE abs(sx - x) > 0.5")
def d7(spark, sf_dir):
    """Stated minutes and expected goals against the sums of the facts."""
    p = players(spark, sf_dir).select("player", (F.col("player") * 25).cast("double").alias("mins_"), F.col("player").cast("double").alias("xg_"))
    rows, of_season = facts(spark, sf_dir), F.col("season") == 1997
    parts = [Q.aggregate_mismatch(p, rows, "player", stated, value, of_season, tolerance).select("player", F.lit(code).alias("code"), F.col(stated).alias("stated"), F.round(F.col("summed").cast("double"), 6).alias("summed")) for code, stated, value, tolerance in (("CON-001", "mins_", F.col("mins"), 30), ("CON-003", "xg_", F.col("xg"), 0.5))]
    return Q.report(parts)


@query("d8_zero_games", f"WITH {PLAYERS_SQL} SELECT player FROM p WHERE balance < 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = player)")
def d8(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player"))
    return players(spark, sf_dir).filter("balance < 0").join(lines, "player", "left_semi").select("player")


@query("d9_round_size", f"WITH {FIXTURES_SQL} SELECT season, rnd, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) <> 180")
def d9(spark, sf_dir):
    return fixtures(spark, sf_dir).groupBy("season", "rnd").agg(F.count("*").alias("n")).filter("n <> 180")


@query("d10_temporal", "SELECT 'TMP-001' AS code, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01' UNION ALL SELECT 'TMP-002', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'TMP-003', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT l_shipdate BETWEEN make_timestamp(CAST(year(o_orderdate) AS BIGINT), 1, 1, 0, 0, 0.0) AND make_timestamp(CAST(year(o_orderdate) + 1 AS BIGINT), 12, 31, 0, 0, 0.0)")
def d10(spark, sf_dir):
    """Fixtures in the future, ends before beginnings, and dates outside the season."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    year = F.year("o_orderdate")
    inside = F.col("l_shipdate").between(F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz"), F.make_date(year + 1, F.lit(12), F.lit(31)).cast("timestamp_ntz"))
    future = Q.count_broken(o, {"TMP-001": F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")})
    return future.union(Q.count_broken(both, {"TMP-002": F.col("l_shipdate") < F.col("o_orderdate"), "TMP-003": ~inside}))


@query("d13_metric_checks", f"{LEADERBOARD_SQL}, z AS (SELECT a.*, (SELECT CAST(sum(goal) AS BIGINT) FROM f WHERE f.player = a.player AND mins > 0) AS q, (SELECT count(*) FROM f WHERE f.player = a.player AND mins > 0) - CASE WHEN player % 9 = 4 THEN 600 ELSE 0 END AS s, 10 + player % 40 AS age FROM a), t AS (SELECT team, fixture, CAST(sum(xg) AS DOUBLE) AS x FROM f GROUP BY 1, 2) SELECT 'MET-001' AS code, count(*) AS n FROM z WHERE m >= 300 AND NOT g * 90 / m BETWEEN 9 AND 9.8 UNION ALL SELECT 'MET-002', count(*) FROM z WHERE m >= 300 AND NOT h * 90 / m BETWEEN 7 AND 7.8 UNION ALL SELECT 'MET-003', count(*) FROM z WHERE m >= 300 AND NOT q * 90.0 / m BETWEEN 0 AND 1.2 UNION ALL SELECT 'MET-004', count(*) FROM z WHERE q > s UNION ALL SELECT 'MET-005', count(*) FROM z WHERE NOT m BETWEEN 0 AND 15500 UNION ALL SELECT 'MET-006', count(*) FROM z WHERE m >= 500 AND g > 1 AND NOT q / g BETWEEN 0 AND 0.13 UNION ALL SELECT 'MET-008', count(*) FROM z WHERE NOT age BETWEEN 15 AND 45 UNION ALL SELECT 'MET-010', count(*) FROM t WHERE NOT x BETWEEN 0 AND 7")
def d13(spark, sf_dir):
    """Eight plausibility checks of rates, goals against shots, minutes, conversion, age and a team's output, each behind its least minutes."""
    rows = facts(spark, sf_dir)
    t = player_totals(spark, sf_dir).join(rows.filter("mins > 0").groupBy("player").agg(F.count("*").alias("lines")), "player")
    t = t.withColumn("shots", F.col("lines") - F.when(F.col("player") % 9 == 4, 600).otherwise(0)).withColumn("age", 10 + F.col("player") % 40)
    m, per = F.col("mins"), lambda c: F.col(c) * 90 / F.col("mins")
    checks = {
        "MET-001": (m >= 300) & ~per("xg").between(9, 9.8), "MET-002": (m >= 300) & ~per("xa").between(7, 7.8), "MET-003": (m >= 300) & ~per("goals").between(0, 1.2),
        "MET-004": F.col("goals") > F.col("shots"), "MET-005": ~m.between(0, 15500), "MET-006": (m >= 500) & (F.col("xg") > 1) & ~(F.col("goals") / F.col("xg")).between(0, 0.13), "MET-008": ~F.col("age").between(15, 45),
    }
    team = rows.groupBy("team", "fixture").agg(total("xg").alias("x"))
    return Q.count_broken(t, checks).union(Q.count_broken(team, {"MET-010": ~F.col("x").between(0, 7)}))


HOMONYM_SQL = """t AS (SELECT l_suppkey AS player, l_orderkey AS fixture, CAST(sum(l_quantity) AS BIGINT) AS mins, count(*) FILTER (WHERE l_returnflag = 'R') AS goals, CAST(sum(CAST(l_discount AS DECIMAL(9,2))) AS DOUBLE) AS xg, CAST(sum(CAST(l_tax AS DECIMAL(9,2))) AS DOUBLE) AS xa FROM lineitem GROUP BY 1, 2),
 pl AS (SELECT player + 1000 AS player, fixture, mins, goals, CASE WHEN fixture % 35 = 0 THEN xg + 1 ELSE xg END AS xg, xa FROM t WHERE fixture % 5 = 0), fa AS (SELECT * FROM t UNION ALL SELECT * FROM pl),
 lo AS (SELECT * FROM fa WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.player = fa.player AND t.fixture = fa.fixture AND t.mins = fa.mins)),
 wr AS (SELECT *, EXISTS (SELECT 1 FROM t b WHERE b.fixture = lo.fixture AND b.mins = lo.mins AND b.player <> lo.player AND b.goals = lo.goals AND b.xg = lo.xg AND b.xa = lo.xa) AS wrong FROM lo),
 re AS (SELECT player, count(*) FILTER (WHERE NOT wrong) AS unexplained FROM wr GROUP BY 1 HAVING bool_or(wrong) AND count(*) FILTER (WHERE NOT wrong) > 0)"""


def homonyms(spark, sf_dir):
    """A source and facts with planted rows: those of a true row's namesake, and every seventh of them with another xg."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("fixture")).agg(
        F.sum("l_quantity").cast("long").alias("mins"), F.count_if(F.col("l_returnflag") == "R").alias("goals"), total(F.col("l_discount").cast("decimal(9,2)")).alias("xg"), total(F.col("l_tax").cast("decimal(9,2)")).alias("xa"))
    planted = t.filter("fixture % 5 = 0").withColumn("player", F.col("player") + 1000).withColumn("xg", F.when(F.col("fixture") % 35 == 0, F.col("xg") + 1).otherwise(F.col("xg")))
    return t.union(planted), t


@query("d17_homonym_repair", f"WITH {HOMONYM_SQL} SELECT player, count(*) AS n FROM fa WHERE NOT EXISTS (SELECT 1 FROM wr WHERE wr.player = fa.player AND wr.fixture = fa.fixture AND wrong AND wr.player NOT IN (SELECT player FROM re)) GROUP BY 1")
def d17(spark, sf_dir):
    """Rows of somebody else go where source, twin and all four figures say so, and nothing unexplained is left."""
    kept, _ = Q.remove_homonym_rows(*homonyms(spark, sf_dir))
    return kept.groupBy("player").agg(F.count("*").alias("n"))


@query("d17_refused", f"WITH {HOMONYM_SQL} SELECT player, unexplained FROM re")
def d17_refused(spark, sf_dir):
    return Q.remove_homonym_rows(*homonyms(spark, sf_dir))[1]


@query("d18_orphan_repair", "SELECT l_suppkey AS player, count(DISTINCT l_orderkey) + CASE WHEN l_suppkey % 10 = 3 THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1")
def d18(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("fixture")).distinct()
    # even players have a game too many; players ending in 3 lack one beside it, so they are left alone
    extra = players(spark, sf_dir).filter("player % 2 = 0 or player % 10 = 3").select("player", F.lit(-1).cast("long").alias("fixture"))
    truth = source.union(players(spark, sf_dir).filter("player % 10 = 3").select("player", F.lit(-2).cast("long").alias("fixture")))
    return Q.remove_orphan_games(source.union(extra), truth, "player", "fixture").groupBy("player").agg(F.count("*").alias("n"))


@query("d19_merge_split", "SELECT s_name AS name, s_suppkey AS keep, s_suppkey + 1000 AS \"drop\" FROM supplier WHERE s_suppkey % 4 = 1")
def d19(spark, sf_dir):
    """Every fourth player's even games stand under a second record, told from all keys by its half; a name goes with its player, so namesakes stay apart."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("game")).distinct()
    record = lambda half: F.struct("player", half.alias("half")).alias("id")
    split = lines.select(record(((F.col("player") % 4 == 1) & (F.col("game") % 2 == 0)).cast("int")), "game")
    p = players(spark, sf_dir).select("player", F.struct("name", "player").alias("name"))
    names = p.select(record(F.lit(0)), "name").union(p.select(record(F.lit(1)), "name"))
    found = Q.merge_split(split, names, lines.join(p, "player").select("name", "game"))
    number = lambda c: F.col(f"{c}.player") + 1000 * F.col(f"{c}.half")
    return found.select("name.name", number("keep").alias("keep"), number("drop").alias("drop"))


IMPORT_SQL = """so AS (SELECT l_suppkey AS player, l_orderkey AS fixture, count(*) FILTER (WHERE l_returnflag = 'R') AS goals, CAST(sum(CAST(l_discount AS DECIMAL(9,2))) AS DOUBLE) AS xg FROM lineitem GROUP BY 1, 2),
 pe AS (SELECT l_suppkey AS player, l_orderkey AS fixture, count(*) FILTER (WHERE l_returnflag = 'R') AS pg, CAST(sum(CAST(l_discount AS DECIMAL(9,2))) AS DOUBLE) AS px FROM lineitem WHERE l_linenumber = 1 AND l_linestatus = 'O' GROUP BY 1, 2),
 ha AS (SELECT player, fixture FROM so WHERE fixture % 6 <> 0 AND player % 11 <> 3 UNION SELECT player, -player FROM so WHERE player % 9 = 2),
 kn AS (SELECT DISTINCT player FROM ha), mi AS (SELECT so.* FROM so JOIN kn USING (player) WHERE NOT EXISTS (SELECT 1 FROM ha WHERE ha.player = so.player AND ha.fixture = so.fixture)),
 re AS (SELECT player, min(reason) AS reason FROM (SELECT player, 'outside the calendar' AS reason FROM mi WHERE fixture % 1000 = 0 UNION ALL SELECT player, 'more games than the source' FROM ha WHERE fixture < 0) GROUP BY 1)"""


def imports(spark, sf_dir, twice=False):
    """Rows here, the source, names, penalties and a calendar: some games miss, some players have one too many, some fixtures are unknown."""
    lines = table(spark, sf_dir, "lineitem")
    key = [F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("fixture")]
    source = lines.groupBy(*key).agg(F.count_if(F.col("l_returnflag") == "R").alias("goals"), total(F.col("l_discount").cast("decimal(9,2)")).alias("xg"))
    penalties = lines.filter("l_linenumber = 1 and l_linestatus = 'O'").groupBy(*key).agg(F.count_if(F.col("l_returnflag") == "R").alias("pen_goals"), total(F.col("l_discount").cast("decimal(9,2)")).alias("pen_xg"))
    have = source.filter("fixture % 6 <> 0 and player % 11 <> 3").select("player", "fixture").union(source.filter("player % 9 = 2").select("player", -F.col("player"))).distinct()
    names = players(spark, sf_dir).select("player", F.when(F.lit(twice) & (F.col("player") < 3), "one name").otherwise(F.col("name")).alias("name"))
    calendar = table(spark, sf_dir, "orders").filter("o_orderkey % 1000 <> 0").select(F.col("o_orderkey").alias("fixture"))
    return have, source, names, penalties, calendar


@query("d20_import_missing", f"WITH {IMPORT_SQL} SELECT mi.player, mi.fixture, mi.goals, mi.xg, greatest(0, mi.goals - coalesce(pg, 0)) AS npg, round(greatest(0, mi.xg - coalesce(px, 0)), 3) AS npxg FROM mi LEFT JOIN pe ON pe.player = mi.player AND pe.fixture = mi.fixture WHERE mi.player NOT IN (SELECT player FROM re)")
def d20(spark, sf_dir):
    return Q.import_missing(*imports(spark, sf_dir))[0]


@query("d20_refused", f"WITH {IMPORT_SQL} SELECT player, reason FROM re UNION ALL SELECT -1, 'rows added while a name is split: ' || 0")
def d20_refused(spark, sf_dir):
    """Who is left alone and why; and nothing is added while one name has two players with games."""
    added, _ = Q.import_missing(*imports(spark, sf_dir, twice=True))
    _, refused = Q.import_missing(*imports(spark, sf_dir))
    blocked = added.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("player"), F.concat(F.lit("rows added while a name is split: "), F.col("n")).alias("reason"))
    return refused.union(blocked)


MERGE_SQL = "m AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 1.2 ELSE p_retailprice * 1.05 END AS b FROM part)"


def _providers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("part"), F.lit("first").alias("provider"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("price"))
    b = p.select(F.col("p_partkey").alias("part"), F.lit("second").alias("provider"), (F.col("p_retailprice") * F.when(F.col("p_partkey") % 5 == 0, 1.2).otherwise(1.05)).alias("price"))
    return Q.provider_merge(a.union(b), ["part"], ["price"], ["first", "second"])


@query("d21_provider_merge", f"WITH {MERGE_SQL} SELECT part, round(coalesce(a, b), 6) AS price FROM m")
def d21(spark, sf_dir):
    return _providers(spark, sf_dir)[0].select("part", F.round("price", 6).alias("price"))


@query("d21_provider_conflicts", f"WITH {MERGE_SQL} SELECT part, 'price' AS \"column\", CAST(2 AS BIGINT) AS providers FROM m WHERE a IS NOT NULL AND abs(a - b) > 0.10 * abs((a + b) / 2)")
def d21c(spark, sf_dir):
    return _providers(spark, sf_dir)[1]


@query("d21_categorical", "WITH q AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS a, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#0' ELSE ' ' || lower(p_brand) END AS b FROM part) SELECT part, coalesce(a, b) AS brand, a IS NOT NULL AND lower(trim(a)) <> lower(trim(b)) AS conflict, CASE WHEN a IS NULL THEN 'second' ELSE 'first,second' END AS seen FROM q")
def d21_text(spark, sf_dir):
    """Text columns: the first provider's value, whether the others differ beyond case and space, and who was seen."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("part"), F.lit("first").alias("provider"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("brand"))
    b = p.select(F.col("p_partkey").alias("part"), F.lit("second").alias("provider"), F.when(F.col("p_partkey") % 3 == 0, "Brand#0").otherwise(F.concat(F.lit(" "), F.lower("p_brand"))).alias("brand"))
    return Q.merge_text(a.union(b), ["part"], "brand", ["first", "second"])


@query("d22_transfers", f"WITH {FACTS_SQL}, q AS (SELECT player, season, arg_max(opp, (m, -opp)) AS team FROM (SELECT player, season, opp, sum(mins) AS m FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2), l AS (SELECT *, lag(team) OVER (PARTITION BY player ORDER BY season) AS before FROM q) SELECT player, season, before, team FROM l WHERE before <> team")
def d22(spark, sf_dir):
    q = facts(spark, sf_dir).groupBy("player", "season", "opp").agg(F.sum("mins").alias("m"))
    q = q.groupBy("player", "season").agg(F.max_by("opp", F.struct("m", -F.col("opp"))).alias("team"))
    return q.withColumn("before", F.lag("team").over(Window.partitionBy("player").orderBy("season"))).filter("before <> team").select("player", "season", "before", "team")


@query("d23_registry_status", f"WITH {FIXTURES_SQL}, h AS (SELECT season, rnd, bit_xor(fixture) AS sum, max(day) AS last FROM x WHERE (season + rnd) % 7 <> 0 GROUP BY 1, 2), e AS (SELECT 1996 + user_id % 6 AS season, count(*) AS runs FROM events GROUP BY 1) SELECT h.season, list_sort(list(rnd)) AS available, list_sort(list_filter(range(1, 13), lambda k: NOT list_contains(list(rnd), k))) AS missing, round(count(*) / 12.0 * 100, 2) AS coverage, CASE WHEN bool_and(sum = CASE WHEN rnd = 5 AND h.season = 1998 THEN 0 ELSE sum END) THEN 'ok' ELSE 'fail' END AS checksum, date_diff('hour', date_trunc('hour', max(last)), TIMESTAMP '2002-06-01') AS stale_hours, coalesce(any_value(runs), 0) AS runs FROM h LEFT JOIN e ON e.season = h.season GROUP BY h.season")
def d23(spark, sf_dir):
    """Rounds that are there and missing, coverage, whether checksums hold, hours since the last fixture, and runs of the season."""
    have = fixtures(spark, sf_dir).filter("(season + rnd) % 7 <> 0").groupBy("season", "rnd").agg(F.bit_xor("fixture").alias("sum"), F.max("day").alias("last"))
    stated = have.select("season", "rnd", F.when((F.col("season") == 1998) & (F.col("rnd") == 5), F.lit(0)).otherwise(F.col("sum")).alias("stated"))
    ran = table(spark, sf_dir, "events").groupBy((1996 + F.col("user_id") % 6).cast("int").alias("season")).agg(F.count("*").alias("runs"))
    return P.season_status(have, stated, ran, 12, "2002-06-01 00:00:00")


@query("d24_regression_diff", f"{PAIR_SQL}, j AS (SELECT player, x, x * 1.02 + CASE WHEN player % 9 = 0 THEN 0.2 ELSE 0 END AS n FROM z), k AS (SELECT *, rank() OVER (ORDER BY x) AS r, rank() OVER (ORDER BY n) AS s, row_number() OVER (ORDER BY x DESC, player) AS i, row_number() OVER (ORDER BY n DESC, player) AS h FROM j), g AS (SELECT corr(r, s) AS rho, count(*) FILTER (WHERE i <= 10 AND h <= 10) AS top10, count(*) FILTER (WHERE i <= 20 AND h <= 20) AS top20, avg(CASE WHEN abs(n - x) >= 0.15 THEN 1.0 ELSE 0 END) AS large_share, max(abs(n - x)) FILTER (WHERE i = 1) AS top_delta, abs(avg(n) - avg(x)) / abs(avg(x)) AS mean_shift, abs(stddev_pop(n) - stddev_pop(x)) / stddev_pop(x) AS sd_shift, abs(quantile_cont(n, 0.95) - quantile_cont(x, 0.95)) / abs(quantile_cont(x, 0.95)) AS p95_shift FROM k) SELECT round(rho, 6) AS rho, top10, top20, round(large_share, 6) AS large_share, round(top_delta, 6) AS top_delta, round(mean_shift, 6) AS mean_shift, round(sd_shift, 6) AS sd_shift, round(p95_shift, 6) AS p95_shift, CASE WHEN rho < 0.95 OR top10 < 8 OR top20 < 16 OR large_share > 0.10 OR top_delta > 0.05 OR mean_shift > 0.10 OR sd_shift > 0.15 OR p95_shift > 0.15 THEN 'CRITICAL' WHEN rho < 0.97 OR top10 < 9 OR top20 < 18 OR large_share > 0.05 OR top_delta > 0.03 OR mean_shift > 0.05 OR sd_shift > 0.08 OR p95_shift > 0.08 THEN 'WARNING' ELSE 'SAFE' END AS verdict FROM g")
def d24(spark, sf_dir):
    from touchline.operators.monitoring import regression_diff

    old = cut(pairs(spark, sf_dir).select("player", F.col("x").alias("v")))
    new = old.withColumn("v", F.col("v") * 1.02 + F.when(F.col("player") % 9 == 0, 0.2).otherwise(0.0))
    found = rounded(regression_diff(old, new, "player", "v"), "rho", "large_share", "top_delta", "mean_shift", "sd_shift", "p95_shift")
    return found.select("rho", "top10", "top20", "large_share", "top_delta", "mean_shift", "sd_shift", "p95_shift", "verdict")


@query("d25_failure_burst", f"WITH {RUNS_SQL}, d AS (SELECT day, count(*) FILTER (WHERE failed) AS n FROM r GROUP BY 1), b AS (SELECT avg(n) AS mu, stddev_pop(n) AS sd FROM d WHERE day < DATE '2024-01-30') SELECT round((n - mu) / sd, 6) AS z FROM d CROSS JOIN b WHERE day = DATE '2024-01-30'")
def d25(spark, sf_dir):
    d = runs(spark, sf_dir).groupBy("day").agg(F.count_if("failed").alias("n")).filter("day <= date '2024-01-30'").withColumn("all", F.lit(0))
    return P.last_against_rest(d, "all", ["day"], "n").select(F.round("z", 6).alias("z"))


@query("d27_lineage_reads", f"WITH {RUNS_SQL} SELECT a.run, count(b.run) AS children FROM r a LEFT JOIN r b ON b.run // 10 = a.run AND b.run <> a.run WHERE a.stage = 'error' GROUP BY 1")
def d27_all(spark, sf_dir):
    r = runs(spark, sf_dir).select("run", "stage")
    kids = r.select(F.floor(F.col("run") / 10).cast("long").alias("parent"), F.col("run").alias("child")).filter("parent <> child")
    return r.filter("stage = 'error'").join(kids, F.col("run") == F.col("parent"), "left").groupBy("run").agg(F.count("child").alias("children"))


@query("d27_consumers", "WITH o AS (SELECT event_id AS run, 'p' || event_id % 50 AS path FROM events WHERE event_type = 'purchase'), i AS (SELECT event_id AS run, 'p' || event_id % 77 AS path FROM events WHERE event_type = 'view'), c AS (SELECT o.path, count(DISTINCT o.run) AS producers, count(DISTINCT i.run) AS consumers FROM o LEFT JOIN i USING (path) GROUP BY 1) SELECT path, producers, consumers, path LIKE 'p1%' AS like_p1, consumers = 0 AS orphan FROM c")
def d27_consumers(spark, sf_dir):
    """Who made and who reads each artifact, which match a pattern, and which nobody reads."""
    e = table(spark, sf_dir, "events")
    path = lambda n: F.concat(F.lit("p"), F.col("event_id") % n).alias("path")
    made = e.filter("event_type = 'purchase'").groupBy(path(50)).agg(F.countDistinct("event_id").alias("producers"))
    used = e.filter("event_type = 'view'").groupBy(path(77)).agg(F.countDistinct("event_id").alias("consumers"))
    both = made.join(used, "path", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))
    return both.select("path", "producers", "consumers", F.col("path").like("p1%").alias("like_p1"), (F.col("consumers") == 0).alias("orphan"))


@query("d28_lineage_closure", "WITH RECURSIVE e AS (SELECT event_id // 10 AS a, event_id AS b FROM events UNION SELECT event_id, event_id // 7 FROM events WHERE event_id % 3 = 0), c AS (SELECT CAST(7 AS BIGINT) AS node UNION SELECT e.b FROM e JOIN c ON e.a = c.node) SELECT node FROM c")
def d28(spark, sf_dir):
    """All that follows from run 7, where run r comes from run r / 10 and every third run leads back to run r / 7: a graph with cycles and diamonds."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("b"))
    edges = e.select(F.floor(F.col("b") / 10).cast("long").alias("a"), "b").union(e.filter("b % 3 = 0").select("b", F.floor(F.col("b") / 7).cast("long"))).distinct()
    return P.closure(edges, spark.createDataFrame([(7,)], "node long"))


@query("d28_run_tree", "WITH RECURSIVE e AS (SELECT event_id AS node, event_id - 37 AS parent FROM events WHERE event_id >= 37), u AS (SELECT max(event_id) AS node FROM events UNION SELECT parent FROM e JOIN u USING (node)), d AS (SELECT CAST(5 AS BIGINT) AS node UNION SELECT e.node FROM e JOIN d ON e.parent = d.node) SELECT 'above' AS side, node FROM u UNION ALL SELECT 'below', node FROM d")
def d28_tree(spark, sf_dir):
    """All runs above the last one and all below run 5, where a run comes from the one 37 before it: chains as long as the log allows."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"))
    parents = e.filter("node >= 37").select("node", (F.col("node") - 37).alias("parent"))
    above = P.ancestors(parents, e.agg(F.max("node").alias("node"))).select(F.lit("above").alias("side"), "node")
    return above.union(P.descendants(parents, spark.createDataFrame([(5,)], "node long")).select(F.lit("below"), "node"))


@query("d29_lineage_edges", "WITH e AS (SELECT event_type AS a, 'user ' || user_id AS b, 'stage' AS kind FROM events UNION SELECT 'user ' || user_id, 'day ' || day(ts), 'made' FROM events UNION SELECT 'day ' || day(ts), 'user ' || (user_id + 1), 'read' FROM events WHERE event_id % 3 = 0) SELECT kind, a, b, replace(a, ' ', '_') || ' -->|' || kind || '| ' || replace(b, ' ', '_') AS line FROM e")
def d29(spark, sf_dir):
    """Edges of three kinds without repeats, each with its line of a flow chart."""
    e = table(spark, sf_dir, "events")
    user, day = F.concat(F.lit("user "), F.col("user_id")), F.concat(F.lit("day "), F.dayofmonth("ts"))
    three = [e.select(F.col("event_type").alias("a"), user.alias("b"), F.lit("stage").alias("kind")), e.select(user.alias("a"), day.alias("b"), F.lit("made").alias("kind")), e.filter("event_id % 3 = 0").select(day.alias("a"), F.concat(F.lit("user "), F.col("user_id") + 1).alias("b"), F.lit("read").alias("kind"))]
    return P.flow_chart(Q.report(three).distinct())


@query("d30_retention", "SELECT kind, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-02-01' - keep * INTERVAL 1 DAY) AS kept, count(*) FILTER (WHERE ts < TIMESTAMP '2024-02-01' - keep * INTERVAL 1 DAY) AS dropped, min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-02-01' - keep * INTERVAL 1 DAY) AS oldest FROM events JOIN (VALUES ('view', 'lineage', 20), ('click', 'metrics', 10), ('error', 'quarantine', 5)) AS k(event_type, kind, keep) USING (event_type) GROUP BY 1")
def d30(spark, sf_dir):
    """Each kind of record keeps for its own number of days; nothing is written, the rest is looked at."""
    from .lineage import retain

    e, parts = table(spark, sf_dir, "events"), []
    for stage, kind, days in (("view", "lineage", 20), ("click", "metrics", 10), ("error", "quarantine", 5)):
        kept, dropped = retain(e.filter(F.col("event_type") == stage), "ts", "2024-02-01 00:00:00", days)
        parts.append(kept.select(F.lit(kind).alias("kind"), "ts", F.lit(True).alias("stays")).union(dropped.select(F.lit(kind), "ts", F.lit(False))))
    return Q.report(parts).groupBy("kind").agg(F.count_if("stays").alias("kept"), F.count_if(~F.col("stays")).alias("dropped"), F.min(F.when(F.col("stays"), F.col("ts"))).alias("oldest"))


@query("d34_stale_values", "SELECT count(*) FILTER (WHERE p_size = p_size % 25) AS same, count(*) AS comparable FROM part WHERE p_size IS NOT NULL")
def d34(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size is not null").agg(F.count_if(F.col("p_size") == F.col("p_size") % 25).alias("same"), F.count("*").alias("comparable"))


POOL_SQL = f"{LEADERBOARD_SQL}, c AS (SELECT p.player AS id, role, round(g * 90 / m, 4) AS score, CAST(balance / 1000 AS DECIMAL(9,2)) AS cost FROM p JOIN a ON p.player = a.player WHERE balance > 0), t AS (SELECT a.id AS a, b.id AS b, d.id AS c, CAST(CAST(a.score AS DECIMAL(9,4)) + CAST(b.score AS DECIMAL(9,4)) + CAST(d.score AS DECIMAL(9,4)) AS DOUBLE) AS score, CAST(a.cost + b.cost + d.cost AS DOUBLE) AS cost FROM c a JOIN c b ON a.id < b.id JOIN c d ON b.id < d.id WHERE NOT (a.role = b.role AND b.role = d.role))"


def whole_pool(spark, sf_dir):
    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player").filter("balance > 0")
    return t.select(F.col("player").alias("id"), "role", F.round(F.col("xg") * 90 / F.col("mins"), 4).cast("decimal(9,4)").alias("score"), (F.col("balance") / 1000).cast("decimal(9,2)").alias("cost"))


@query("q1_best_trio", f"{POOL_SQL} SELECT a, b, c, score, cost FROM t WHERE cost <= 12 ORDER BY score DESC, a, b, c LIMIT 1")
def q1_all(spark, sf_dir):
    """The best three of the whole registry within a budget and of two roles at least (also j15); joined in rank order by a bound."""
    return best_trio(whole_pool(spark, sf_dir), budget=12).select("a", "b", "c", F.col("score").cast("double").alias("score"), F.col("cost").cast("double").alias("cost"))


@query("q2_cheapest_trio", f"{POOL_SQL} SELECT a, b, c, cost FROM t ORDER BY cost, a, b, c LIMIT 1")
def q2_all(spark, sf_dir):
    return cheapest_trio(whole_pool(spark, sf_dir)).select("a", "b", "c", F.col("cost").cast("double").alias("cost"))


@query("q3_target_trio", f"{POOL_SQL} SELECT a, b, c, cost FROM t WHERE score >= 29 ORDER BY cost, a, b, c LIMIT 1")
def q3_all(spark, sf_dir):
    return cheapest_trio(whole_pool(spark, sf_dir), target=29).select("a", "b", "c", F.col("cost").cast("double").alias("cost"))


ADMITTED_SQL = POOL_SQL.replace("WHERE balance > 0)", "WHERE balance > 0 AND 16 + p.player % 20 <= 25 AND m >= 12000 AND p.player % 10 >= 2 AND p.player % 8 <> 5)")


def admitted_pool(spark, sf_dir):
    """The pool of players up to 25 years that no rule of admission turns away: minutes, confidence, a loan."""
    mins = player_totals(spark, sf_dir).select(F.col("player").alias("id"), "mins")
    k = F.col("id")
    rules = {"minutes": F.col("mins") < 12000, "confidence": k % 10 < 2, "loan": k % 8 == 5}
    young = whole_pool(spark, sf_dir).join(mins, "id").filter(16 + k % 20 <= 25)
    return young.filter(F.size(J.reasons(rules)) == 0).drop("mins")


@query("q2_cheapest_young_trio", f"{ADMITTED_SQL} SELECT a, b, c, cost FROM t ORDER BY cost, a, b, c LIMIT 1")
def q2_young(spark, sf_dir):
    """The cheapest three admitted players up to 25 years, of two roles at least."""
    return cheapest_trio(admitted_pool(spark, sf_dir)).select("a", "b", "c", F.col("cost").cast("double").alias("cost"))


@query("q3_target_young_trio", f"{ADMITTED_SQL}, g AS (SELECT max(score) AS best FROM t WHERE cost <= 12) SELECT a, b, c, cost, round(best, 4) AS target FROM t CROSS JOIN g WHERE score >= best ORDER BY cost, a, b, c LIMIT 1")
def q3_young(spark, sf_dir):
    """The cheapest such three that reach what the best three within the budget reach."""
    pool = cut(admitted_pool(spark, sf_dir))
    rich = best_trio(pool, budget=12)
    reached = rich.first()
    found = rich if reached is None else cheapest_trio(pool, target=reached["score"])
    target = F.lit(None if reached is None else float(reached["score"])).cast("double")
    return found.select("a", "b", "c", F.col("cost").cast("double").alias("cost"), F.round(target, 4).alias("target"))


@query("q5_team_page", f"{LEADERBOARD_SQL}, t AS (SELECT p.team, p.player, coalesce(m, 0) AS m, g / m AS v FROM p LEFT JOIN a ON p.player = a.player), q AS (SELECT team, player, 'ranked' AS part, row_number() OVER (PARTITION BY team ORDER BY v DESC, player) AS place FROM t WHERE m >= 15000), r AS (SELECT team, player, 'roster' AS part, row_number() OVER (PARTITION BY team ORDER BY m DESC, player) AS place FROM t WHERE m < 15000) SELECT * FROM q UNION ALL SELECT * FROM r WHERE place <= 24")
def q5(spark, sf_dir):
    """A team's qualified players by rank, and the rest of its roster, at most 24, by minutes."""
    t = players(spark, sf_dir).select("player", "team").join(player_totals(spark, sf_dir), "player", "left").withColumn("mins", F.coalesce("mins", F.lit(0))).withColumn("v", F.col("xg") / F.col("mins"))
    return V.team_page(t, F.col("mins") >= 15000, "v", "mins", 24)


@query("q7_best_dimensions", f"{LEADERBOARD_SQL}, r AS (SELECT player, rank() OVER (ORDER BY g / m DESC) AS xg, rank() OVER (ORDER BY h / m DESC) AS xa, rank() OVER (ORDER BY m DESC) AS mins FROM a), u AS (UNPIVOT r ON xg, xa, mins INTO NAME dim VALUE rank), k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rank, dim) AS place FROM u) SELECT player, dim, rank, place FROM k WHERE place <= 2")
def q7(spark, sf_dir):
    from touchline.operators.windows import rank_min

    r = player_totals(spark, sf_dir).withColumns({"v1": F.col("xg") / F.col("mins"), "v2": F.col("xa") / F.col("mins"), "v3": F.col("mins")}).select("player", "v1", "v2", "v3")
    for value, name in (("v1", "xg"), ("v2", "xa"), ("v3", "mins")):
        r = rank_min(r, value, name)
    return V.best_dimensions(r, "player", ["xg", "xa", "mins"], 2)


@query("q8_notify_once", f"WITH {RUNS_SQL}, d AS (SELECT stage, day, bool_and(NOT failed) AS complete, max(started) AS closing FROM r GROUP BY 1, 2), st AS (SELECT DISTINCT stage, day FROM r WHERE owner = 7 AND day < DATE '2024-01-10') SELECT stage, day, closing + INTERVAL 2 HOUR AS due FROM d WHERE complete AND closing + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM st WHERE st.stage = d.stage AND st.day = d.day)")
def q8(spark, sf_dir):
    """Closed rounds whose closing time has passed, less those that the state table says were told already."""
    r = runs(spark, sf_dir)
    rounds = r.groupBy("stage", "day").agg(F.bool_and(~F.col("failed")).alias("complete"), F.max("started").alias("closing"))
    told = r.filter((F.col("owner") == 7) & (F.col("day") < F.lit("2024-01-10").cast("date"))).select("stage", "day")
    return P.due_notices(rounds, told, ["stage", "day"], "2024-01-20 00:00:00", 2)


@query("q9_season_views", f"WITH {FIXTURES_SQL}, n AS (SELECT season, count(DISTINCT rnd) AS rounds, count(*) AS games FROM x GROUP BY 1) SELECT season, rounds, games, season = (SELECT max(season) FROM n WHERE rounds = 12) AS shown, CAST(season AS VARCHAR) || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS label FROM n")
def q9(spark, sf_dir):
    """Seasons that there are, how far each is, and which is shown: the last whole one."""
    n = fixtures(spark, sf_dir).groupBy("season").agg(F.countDistinct("rnd").alias("rounds"), F.count("*").alias("games"))
    last = n.filter("rounds = 12").agg(F.max("season").alias("_last"))
    return n.join(last).select("season", "rounds", "games", (F.col("season") == F.col("_last")).alias("shown"), T.season_label(F.col("season")).alias("label"))


