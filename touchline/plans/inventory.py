"""The remaining operators of the inventory: plain scans, joins, adjustments, text rules, checks and composed tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import monitoring as M
from touchline.operators import quality as Q
from touchline.operators import rating as R
from touchline.operators import statistics as S
from touchline.operators.measures import round_exact, total
from touchline.operators.windows import place, spearman, top_n
from touchline.sources import providers, sinks

from .binding import FACTS_SQL, FIXTURES_SQL, RUNS_SQL, facts, fixtures, players, runs, table
from .registry import query
from .scans import LEADERBOARD_SQL, player_totals
from .monitoring import moved_sql
from .statistics import PAIR_SQL, pairs, rounded, uniform_sql

TEAM_SQL = f"{FACTS_SQL}, g AS (SELECT team, fixture, season, rnd, CAST(sum(goal) AS BIGINT) AS goals FROM f GROUP BY ALL)"


@query("s2_schema_guard", "SELECT * FROM (VALUES ('as it is', true, ''), ('without a column', false, 'players has no role'), ('without a table', false, 'missing table: fixtures'), ('a season of ' || (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1890) || ' rows', false, 'fixtures has no rows of 1890')) AS t(checked, ok, complaint)")
def s2(spark, sf_dir):
    """What the guard says to the tables as they are, and to tables that lack something."""
    tables = {"fixtures": fixtures(spark, sf_dir), "players": players(spark, sf_dir)}
    needs = {"fixtures": ["season", "rnd"], "players": ["player", "role"]}
    cases = [("as it is", tables, None), ("without a column", {**tables, "players": tables["players"].drop("role")}, None), ("without a table", {"players": tables["players"]}, None), ("a season of 0 rows", tables, 1890)]
    made = []
    for name, given, season in cases:
        try:
            providers.guard(given, needs, season)
            made.append((name, True, ""))
        except providers.SchemaViolation as e:
            made.append((name, False, str(e)))
    return spark.createDataFrame(made, "checked string, ok boolean, complaint string")


@query("s3_column_sniffing", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def s3(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = providers.first_column(o, ["customer_id", "O_CUSTKEY", "cust"])
    return o.agg(F.count("*").alias("n"), F.sum(key).alias("total"))


@query("s7_team_log", f"WITH {TEAM_SQL} SELECT team, season, rnd, count(*) AS games, CAST(sum(goals) AS BIGINT) AS goals FROM g GROUP BY 1, 2, 3")
def s7(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("team", "fixture", "season", "rnd").agg(F.sum("goal").alias("goals"))
    return g.groupBy("team", "season", "rnd").agg(F.count("*").alias("games"), F.sum("goals").alias("goals"))


@query("s15_light_list", f"{LEADERBOARD_SQL} SELECT p.player, name, role, team, CAST(m AS BIGINT) AS mins, n AS games, round(g, 2) AS xg, round(h, 2) AS xa, round(g * 90 / m, 3) AS xg90, row_number() OVER (ORDER BY g DESC, p.player) AS rank, true AS light FROM p JOIN a ON p.player = a.player")
def s15(spark, sf_dir):
    """All players as light nested records, flattened."""
    t = place(players(spark, sf_dir).join(player_totals(spark, sf_dir), "player"), "xg", ["player"], "rank")
    kpi = F.struct(F.round("xg", 2).alias("xg"), F.round("xa", 2).alias("xa"), F.round(F.col("xg") * 90 / F.col("mins"), 3).alias("xg90"))
    record = t.select(F.struct("player", "name", "role", "team", "mins", "games", "rank", kpi.alias("kpi"), F.lit(True).alias("light")).alias("r"))
    return record.select("r.player", "r.name", "r.role", "r.team", "r.mins", "r.games", "r.rank", "r.kpi.xg", "r.kpi.xa", "r.kpi.xg90", "r.light")


@query("p2_appeared", f"WITH {FACTS_SQL} SELECT player, count(*) AS n FROM f WHERE mins > 25 GROUP BY 1")
def p2(spark, sf_dir):
    return facts(spark, sf_dir).filter("mins > 25").groupBy("player").agg(F.count("*").alias("n"))


@query("p16_head", f"{LEADERBOARD_SQL} SELECT player, CAST(m AS BIGINT) AS mins FROM a ORDER BY m DESC, player LIMIT 7")
def p16(spark, sf_dir):
    return player_totals(spark, sf_dir).select("player", "mins").orderBy(F.col("mins").desc(), "player").limit(7)


@query("j1_star", "SELECT r_name AS region, c_mktsegment AS segment, count(*) AS n, round(CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j1(spark, sf_dir):
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(total(F.col("l_extendedprice").cast("decimal(18,2)")), 2).alias("amount"))


@query("j2_left_outer", "SELECT c_custkey AS id, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def j2(spark, sf_dir):
    """The condition on the right side belongs to the join, so that all on the left stay."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("id")).agg(F.count("o_orderkey").alias("orders"))


@query("j4_composite_key", f"WITH {FACTS_SQL}, a AS (SELECT season, rnd, team, sum(goal) AS g FROM f GROUP BY 1, 2, 3), b AS (SELECT season, rnd, opp AS team, count(*) AS faced FROM f GROUP BY 1, 2, 3) SELECT season, rnd, team, CAST(g AS BIGINT) AS goals, faced FROM a JOIN b USING (season, rnd, team)")
def j4(spark, sf_dir):
    rows = facts(spark, sf_dir)
    a = rows.groupBy("season", "rnd", "team").agg(F.sum("goal").alias("goals"))
    return a.join(rows.groupBy("season", "rnd", F.col("opp").alias("team")).agg(F.count("*").alias("faced")), ["season", "rnd", "team"])


@query("j9_left_merge", f"{LEADERBOARD_SQL}, l AS (SELECT player, max(rnd) AS last_rnd FROM f WHERE season = 2001 GROUP BY 1) SELECT p.player, round(g, 5) AS xg, last_rnd FROM p LEFT JOIN a ON p.player = a.player LEFT JOIN l ON p.player = l.player")
def j9(spark, sf_dir):
    last = facts(spark, sf_dir).filter("season = 2001").groupBy("player").agg(F.max("rnd").alias("last_rnd"))
    return players(spark, sf_dir).join(player_totals(spark, sf_dir).select("player", F.round("xg", 5).alias("xg")), "player", "left").join(last, "player", "left").select("player", "xg", "last_rnd")


@query("j14_exact_as_of", f"WITH {FIXTURES_SQL}, v AS (SELECT unnest([3, 7, 13]) AS rnd) SELECT v.rnd, count(x.fixture) AS fixtures FROM v LEFT JOIN x ON x.rnd = v.rnd AND x.season = 1999 GROUP BY 1")
def j14(spark, sf_dir):
    """Only an equal round counts; nothing is carried over from the nearest."""
    v = spark.createDataFrame([(3,), (7,), (13,)], "rnd int")
    return v.join(fixtures(spark, sf_dir).filter("season = 1999"), "rnd", "left").groupBy("rnd").agg(F.count("fixture").alias("fixtures"))


@query("j15_theta_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey AND a.n_nationkey + b.n_nationkey <= 12")
def j15(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"r{k}")) for k in "ab")
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.col("a") + F.col("b") <= 12)).select("a", "b")


@query("t1_final_sort", f"{LEADERBOARD_SQL} SELECT player, row_number() OVER (ORDER BY g DESC, player) AS place FROM a")
def t1(spark, sf_dir):
    return place(player_totals(spark, sf_dir), "xg", ["player"], "place").select("player", "place")


@query("t6_nulls_last", "SELECT s_suppkey AS player, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal END DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def t6(spark, sf_dir):
    p = players(spark, sf_dir).withColumn("v", F.when(F.col("player") % 6 != 0, F.col("balance")))
    return place(p, "v", ["player"], "place").select("player", "place")


@query("m24_role_quotas", f"{PAIR_SQL}, rw AS (SELECT * FROM (VALUES ('FWD', 1.0::DOUBLE), ('MID', 0.85), ('DEF', 0.55), ('GK', 0.20)) AS t(role, w)), dr AS (SELECT unnest(range(1, 101)) AS d), mv AS (SELECT d, player, role, x * w AS s, x * w / w * w * (1 + 0.2 * (2 * {uniform_sql(chr(39) + '42' + chr(39), 'CAST(d AS VARCHAR)', 'role')} - 1)) AS t FROM z JOIN rw USING (role) CROSS JOIN dr), q AS (SELECT d, role, row_number() OVER (PARTITION BY d ORDER BY s DESC, player) AS a, row_number() OVER (PARTITION BY d ORDER BY t DESC, player) AS b FROM mv), qd AS (SELECT d, role, count(*) FILTER (WHERE a <= 20) AS q, count(*) FILTER (WHERE b <= 20) AS m FROM q GROUP BY 1, 2), {moved_sql('s', 't', 'count(*) FILTER (WHERE a <= 20 AND b <= 20) / 20.0 AS t20')}, al AS (SELECT round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(t20, 0.5), 6) AS overlap FROM pd) SELECT role, max(q) AS quota, min(m) AS quota_least, max(m) AS quota_most, any_value(median) AS median, any_value(overlap) AS overlap FROM qd CROSS JOIN al GROUP BY 1")
def m24(spark, sf_dir):
    """Quotas of the roles among the best twenty, and their range under moved role weights."""
    w = F.try_element_at(F.create_map(*[F.lit(v) for kv in R.RULES.role_weights.items() for v in kv]), F.col("role"))
    rows = pairs(spark, sf_dir).withColumn("v", F.col("x") * w)
    return rounded(S.role_weight_sensitivity(rows, "player", "v", "role", R.RULES.role_weights, 100), "median", "overlap")


@query("m26_rank_agreement", f"{PAIR_SQL}, k AS (SELECT rank() OVER (ORDER BY x) AS u, rank() OVER (ORDER BY y) AS v FROM z) SELECT round(corr(u, v), 6) AS rho, count(*) AS n FROM k")
def m26(spark, sf_dir):
    return spearman(pairs(spark, sf_dir).withColumn("all", F.lit(0)), "x", "y", ["all"]).select(F.round("rho", 6).alias("rho"), "n")


@query("m31_prospects", f"{PAIR_SQL}, b AS (SELECT player, CASE WHEN player % 5 = 0 THEN NULL ELSE 16 + CAST(player % 12 AS DOUBLE) END AS age, CASE WHEN player % 7 = 0 THEN 0 ELSE x END AS x, 16 + CAST(player % 12 AS DOUBLE) AS a0 FROM z) SELECT player, round(CASE WHEN x <> 0 THEN x * CASE WHEN player % 5 <> 0 THEN 0.55 * exp(-0.5 * pow((age - 23) / 3.5, 2)) + 0.25 * greatest(0, least(1, (23 - age) / 5)) + 0.20 * CASE WHEN age <= 27 THEN 1 ELSE greatest(0, 1 - (age - 27) * 0.06) END ELSE exp(-0.5 * pow((a0 - 27) / 4.5, 2)) END END, 5) AS score FROM b WHERE a0 <= 24")
def m31(spark, sf_dir):
    """The index times the age index, or times a bell around 27 where that is missing; no score without an index."""
    k = F.col("player")
    age = 16 + (k % 12).cast("double")
    x = F.when(k % 7 == 0, 0.0).otherwise(F.col("x"))
    index = R.age_index(F.when(k % 5 != 0, age))
    return pairs(spark, sf_dir).filter(age <= 24).select("player", F.round(R.prospect(x, index, age), 5).alias("score"))


@query("m33_rounding", "SELECT event_id AS run, CAST(printf('%.3f', value / 8) AS DOUBLE) AS v FROM events")
def m33_all(spark, sf_dir):
    """All events, rounded by the exact binary value; a quarter are ties in decimal form."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), round_exact(F.col("value") / 8, 3).alias("v"))


@query("f5_doubled_surname", "SELECT p_partkey AS part, p_name AS name FROM part")
def f5(spark, sf_dir):
    """Names whose last word is said twice lose the second."""
    last = F.element_at(F.split("p_name", " "), -1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), T.without_double_surname(F.concat_ws(" ", F.col("p_name"), last)).alias("name"))


@query("f9_write_normalisation", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def f9(spark, sf_dir):
    dirty = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ​")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.nullif(T.clean_name(dirty), F.lit("")).alias("name"))


@query("f14_fine_role", f"WITH {FACTS_SQL}, q AS (SELECT player, opp % 10 AS box, CAST(sum(mins) AS BIGINT) AS m FROM f GROUP BY 1, 2), t AS (SELECT player, sum(m) AS total, coalesce(max(m) FILTER (WHERE box = 7), 0) AS second FROM q GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY m DESC, box) AS k FROM q) SELECT player, CASE WHEN box = 9 AND second >= 0.08 * total THEN 8 ELSE CAST(box AS INT) END AS box, round(CAST(m + CASE WHEN box = 9 AND second >= 0.08 * total THEN second ELSE 0 END AS DOUBLE) / total, 6) AS share FROM k JOIN t USING (player) WHERE k = 1")
def f14(spark, sf_dir):
    """The box with most minutes; a forward with a share of minutes behind the attack is a second forward, with both shares (here from 8 %)."""
    q = facts(spark, sf_dir).groupBy("player", (F.col("opp") % 10).cast("int").alias("box")).agg(F.sum("mins").alias("m"))
    return R.fine_role(q, forward=9, behind=7, second=8, least=0.08).select("player", "box", F.round("share", 6).alias("share"))


@query("f16_first_token_role", "SELECT p_partkey AS part, CASE WHEN p_name IN ('small box', 'red box') THEN 'GK' ELSE CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 'DEF' WHEN 'red' THEN 'MID' WHEN 'large' THEN 'FWD' END END AS role FROM part")
def f16(spark, sf_dir):
    """Role by the whole position, else by its first word."""
    whole = F.create_map(*map(F.lit, ("small box", "GK", "red box", "GK", "small", "DEF", "red", "MID", "large", "FWD")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.coalesce(F.try_element_at(whole, F.col("p_name")), F.try_element_at(whole, F.split("p_name", " ")[0])).alias("role"))


@query("f19_json_path", "SELECT event_id AS run, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.nothing') AS missing FROM events")
def f19(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.nothing").alias("missing"))


@query("f20_label_escape", r"""SELECT DISTINCT p_brand || '"\' AS raw, p_brand || '\"\\' AS label, '''' || p_brand || '''''"\' || '''' AS sql, '"' || p_brand || '''""\' || '"' AS csv FROM part""")
def f20(spark, sf_dir):
    """One text as a label value, as an SQL literal and as a CSV cell."""
    raw = F.concat(F.col("p_brand"), F.lit('"\\'))
    both = F.concat(F.col("p_brand"), F.lit("'\"\\"))
    return table(spark, sf_dir, "part").select(raw.alias("raw"), both.alias("both")).distinct().select("raw", sinks.escaped(F.col("raw")).alias("label"), sinks.sql_text(F.col("both")).alias("sql"), sinks.csv_text(F.col("both")).alias("csv"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("d1_overview", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, (SELECT count(*) FROM (DESCRIBE {t})) AS columns FROM {t}" for t in TABLES))
def d1(spark, sf_dir):
    """Rows and columns of every table."""
    parts = []
    for t in TABLES:
        df = table(spark, sf_dir, t)
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(len(df.columns)).cast("long").alias("columns")))
    return Q.report(parts)


@query("d5_duplicate_ids", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def d5(spark, sf_dir):
    return Q.repeated_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query("d6_names", f"{LEADERBOARD_SQL} SELECT 'NAM-001' AS code, count(*) FILTER (WHERE player % 6 = 0 OR player % 10 = 1) AS n FROM p UNION ALL SELECT 'NAM-002', count(*) FILTER (WHERE p.player % 7 = 2 AND m >= 500) FROM p JOIN a USING (player) UNION ALL SELECT 'NAM-003', count(*) FILTER (WHERE p.player % 9 = 4 AND m >= 500) FROM p JOIN a USING (player)")
def d6(spark, sf_dir):
    """Names with invisible characters, and players with 500 minutes but no birth date or no role."""
    k = F.col("player")
    dirty = F.concat("name", F.when(k % 6 == 0, "\u200b").when(k % 10 == 1, "\u00a0").otherwise(""))
    rows = players(spark, sf_dir).join(player_totals(spark, sf_dir).select("player", "mins"), "player", "left").select(dirty.alias("name"), "mins", F.when(k % 7 != 2, "1990-01-01").alias("born"), F.when(k % 9 != 4, F.col("role")).alias("role"))
    return Q.count_broken(rows, {"NAM-001": F.size(T.invisible(F.col("name"))) > 0, "NAM-002": F.col("born").isNull() & (F.col("mins") >= 500), "NAM-003": F.col("role").isNull() & (F.col("mins") >= 500)})


@query("d11_residual_players", f"WITH {FACTS_SQL}, i AS (SELECT p.player, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.team = p.team AND f.season = 2001 AND f.rnd = 12) THEN 'UNU-003' ELSE 'UNU-002' END AS code FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.player = p.player AND f.season = 2001 AND f.rnd = 12)), t AS (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders) SELECT 'UNU-001' AS code, name AS what, n FROM t WHERE n < 10 UNION ALL SELECT code, '', count(*) FROM i GROUP BY 1")
def d11(spark, sf_dir):
    """Tables with next to no rows, players without minutes whose team was not active, and those whose team was."""
    late = facts(spark, sf_dir).filter("season = 2001 and rnd = 12")
    active = late.select("team").distinct().withColumn("active", F.lit(True))
    idle = players(spark, sf_dir).join(late.select("player"), "player", "left_anti").join(active, "team", "left")
    idle = idle.groupBy(F.when(F.col("active"), "UNU-003").otherwise("UNU-002").alias("code")).agg(F.count("*").alias("n")).select("code", F.lit("").alias("what"), "n")
    thin = Q.report([table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit("UNU-001").alias("code"), F.lit(t).alias("what"), "n") for t in ("region", "nation", "orders")]).filter("n < 10")
    return thin.union(idle)


@query("d12_source_ids", "SELECT o_orderkey // 3 AS source_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 2")
def d12_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 3).cast("long").alias("source_id"))
    return o.groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 2")


@query("d15_recomputed", f"WITH {FACTS_SQL}, s AS (SELECT player, CAST(sum(mins) AS BIGINT) AS m, count(DISTINCT fixture) AS g, CAST(sum(xg) AS DOUBLE) AS x, arg_max(CASE WHEN opp % 3 = 0 THEN 'DEF' WHEN opp % 3 = 1 THEN 'MID' ELSE 'FWD' END, mins * 1000000 + fixture) AS seen FROM f GROUP BY 1), o AS (SELECT player, name, CASE WHEN player % 3 <> 0 THEN role END AS role, player * 150 AS m0, player % 700 AS g0, CAST(player AS DOUBLE) AS x0, CASE WHEN player % 4 = 0 THEN chr(8203) ELSE '' END AS dirt FROM p WHERE player % 20 <> 19) SELECT o.player, coalesce(m, 0) AS mins, coalesce(g, 0) AS games, round(coalesce(x, 0), 4) AS xg, o.name, coalesce(role, seen) AS role, list_filter([CASE WHEN abs(coalesce(m, 0) - m0) > 30 THEN 'CON-001' END, CASE WHEN coalesce(g, 0) <> g0 THEN 'CON-002' END, CASE WHEN abs(coalesce(x, 0) - x0) > 0.5 THEN 'CON-003' END, CASE WHEN dirt <> '' THEN 'NAM-001' END, CASE WHEN role IS NULL AND seen IS NOT NULL THEN 'NAM-003' END], lambda c: c IS NOT NULL) AS fixes FROM o LEFT JOIN s USING (player)")
def d15(spark, sf_dir):
    """The corrected registry beside what each row's correction was for; rows without a registry entry are left out (REF-003), nothing is written."""
    side = F.when(F.col("opp") % 3 == 0, "DEF").when(F.col("opp") % 3 == 1, "MID").otherwise("FWD")
    k = F.col("player")
    stated = players(spark, sf_dir).filter("player % 20 <> 19").select("player", F.concat("name", F.when(k % 4 == 0, "\u200b").otherwise("")).alias("name"), F.when(k % 3 != 0, F.col("role")).alias("role"), (k * 150).alias("mins"), (k % 700).alias("games"), k.cast("double").alias("xg"))
    found = facts(spark, sf_dir).groupBy("player").agg(F.sum("mins").alias("mins"), F.countDistinct("fixture").alias("games"), total("xg").alias("xg"), F.max_by(side, F.col("mins") * 1000000 + F.col("fixture")).alias("role"))
    return rounded(Q.corrected(stated, found, T.clean_name), "xg", digits=4)


@query("d16_constraints", "SELECT 'minutes 0..130' AS code, count(*) FILTER (WHERE NOT l_quantity * 3 BETWEEN 0 AND 130) AS n FROM lineitem UNION ALL SELECT 'ends after it begins', count(*) FILTER (WHERE l_shipdate < o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'unique line', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))")
def d16(spark, sf_dir):
    """What constraints would refuse: minutes, dates, and keys that repeat."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ranges = Q.count_broken(li, {"minutes 0..130": ~(F.col("l_quantity") * 3).between(0, 130)})
    dates = Q.count_broken(li.join(o, li["l_orderkey"] == o["o_orderkey"]), {"ends after it begins": F.col("l_shipdate") < F.col("o_orderdate")})
    twice = Q.repeated_keys(li, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n")).select(F.lit("unique line").alias("code"), "n")
    return ranges.union(dates).union(twice)


@query("d26_latest_status", f"WITH {RUNS_SQL}, k AS (SELECT owner, stage, run, row_number() OVER (PARTITION BY owner ORDER BY started DESC, run DESC) AS k FROM r) SELECT owner, stage AS status, run FROM k WHERE k = 1")
def d26(spark, sf_dir):
    """The latest event of each owner is its state."""
    return top_n(runs(spark, sf_dir), ["owner"], [F.col("started").desc(), F.col("run").desc()], 1).select("owner", F.col("stage").alias("status"), "run")


@query("d32_metric_families", f"{PAIR_SQL}, gk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS u, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS v FROM z) SELECT 'runs_total{{stage=\"' || event_type || '\",status=\"' || CASE WHEN value > 100 THEN 'fail' ELSE 'ok' END || '\"}} ' || count(*) AS line FROM events GROUP BY event_type, value > 100 UNION ALL SELECT 'regression_rank_agreement ' || CAST(CAST((SELECT corr(u, v) FROM gk) AS DECIMAL(9,6)) AS VARCHAR) UNION ALL SELECT 'anomalies{{severity=\"critical\"}} ' || count(*) FILTER (WHERE value > 150) FROM events UNION ALL SELECT unnest(['# TYPE runs_total counter', '# TYPE regression_rank_agreement gauge', '# TYPE anomalies gauge'])")
def d32(spark, sf_dir):
    """Lines of the three families: runs, the regression gate, and anomalies."""
    e = table(spark, sf_dir, "events")
    ran = e.groupBy(F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "fail").otherwise("ok").alias("status")).agg(F.count("*").alias("value"))
    change = M.regression_diff(pairs(spark, sf_dir).select("player", F.col("x").alias("v")), pairs(spark, sf_dir).select("player", F.col("y").alias("v")), "player", "v")
    gate = change.select(F.col("rho").cast("decimal(9,6)").alias("value"))
    odd = e.agg(F.count_if(F.col("value") > 150).alias("value")).withColumn("severity", F.lit("critical"))
    parts = [sinks.metric_lines(ran, "runs_total", "counter", ["stage", "status"]), sinks.metric_lines(gate, "regression_rank_agreement", "gauge", []), sinks.metric_lines(odd, "anomalies", "gauge", ["severity"])]
    return Q.report(parts)


@query("d33_site_consistency", "WITH g AS (SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS brand, CASE WHEN page_id % 40 = 1 THEN 1998 ELSE 1997 END AS season, page_id % 30 AS team FROM pages WHERE html IS NOT NULL) SELECT count(DISTINCT season) AS seasons, count(DISTINCT brand) AS brands, count(DISTINCT team) >= 16 AS enough, count(DISTINCT team) FILTER (WHERE team NOT IN (SELECT n_nationkey FROM nation)) AS orphan_pages, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT team FROM g)) AS teams_without_page FROM g")
def d33(spark, sf_dir):
    """Whether all pages are of one season and brand, whether there are enough team pages, and pages and teams without the other."""
    k = F.col("page_id")
    g = table(spark, sf_dir, "pages").filter("html is not null").select(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("brand"), F.when(k % 40 == 1, 1998).otherwise(1997).alias("season"), (k % 30).alias("team"))
    return Q.site_report(g, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team")), 16)


@query("vd_extremes", f"{PAIR_SQL}, d AS (SELECT player, y - x AS d FROM z) (SELECT player, round(d, 6) AS d, 'top' AS kind FROM d ORDER BY d DESC, player LIMIT 5) UNION ALL (SELECT player, round(d, 6), 'bottom' FROM d ORDER BY d, player LIMIT 5)")
def vd(spark, sf_dir):
    d = pairs(spark, sf_dir).select("player", (F.col("y") - F.col("x")).alias("v"))
    top = d.orderBy(F.col("v").desc(), "player").limit(5).withColumn("kind", F.lit("top"))
    return top.union(d.orderBy("v", "player").limit(5).withColumn("kind", F.lit("bottom"))).select("player", F.round("v", 6).alias("d"), "kind")


@query("q4_rejected", f"{LEADERBOARD_SQL} SELECT p.player, concat_ws(';', CASE WHEN m < 15500 THEN 'minutes' END, CASE WHEN balance < 1000 THEN 'balance' END) AS reasons FROM p JOIN a ON p.player = a.player WHERE m < 15500 OR balance < 1000 ORDER BY g / m DESC, p.player LIMIT 3")
def q4(spark, sf_dir):
    from touchline.operators.joins import reasons

    t = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player")
    t = t.withColumn("reasons", F.array_join(reasons({"minutes": F.col("mins") < 15500, "balance": F.col("balance") < 1000}), ";")).filter("reasons <> ''")
    return t.orderBy((F.col("xg") / F.col("mins")).desc(), "player").limit(3).select("player", "reasons")


@query("q6_showcase", f"{PAIR_SQL}, k AS (SELECT role, player, row_number() OVER (PARTITION BY role ORDER BY x + y DESC, player) AS place, rank() OVER (ORDER BY x DESC) - rank() OVER (ORDER BY x + y DESC) AS delta FROM z) SELECT role, player, place, delta FROM k WHERE place <= 2")
def q6(spark, sf_dir):
    from touchline.operators.windows import rank_min

    z = rank_min(rank_min(pairs(spark, sf_dir).withColumn("s", F.col("x") + F.col("y")), "x", "_i"), "s", "_j").withColumn("delta", F.col("_i") - F.col("_j"))
    return top_n(z, ["role"], [F.col("s").desc(), F.col("player")], 2).select("role", "player", F.col("place").cast("long").alias("place"), "delta")


