"""Scans, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import joins as J
from touchline.operators.measures import mean, per90, total
from touchline.operators.windows import place, top_n

from .binding import FACTS_SQL, FIXTURES_SQL, PLAYERS_SQL, facts, fixtures, players, table
from .registry import query

LEADERBOARD_SQL = f"""WITH {FACTS_SQL}, a AS (SELECT player, sum(mins) AS m, CAST(count(DISTINCT fixture) AS BIGINT) AS n, CAST(sum(xg) AS DOUBLE) AS g, CAST(sum(xa) AS DOUBLE) AS h FROM f WHERE mins > 0 GROUP BY player)"""


def player_totals(spark: SparkSession, sf_dir: str, season: int | None = None) -> DataFrame:
    rows = facts(spark, sf_dir).filter("mins > 0")
    if season is not None:
        rows = rows.filter(F.col("season") == season)
    return rows.groupBy("player").agg(F.sum("mins").alias("mins"), F.countDistinct("fixture").alias("games"), total("xg").alias("xg"), total("xa").alias("xa"), F.sum("goal").alias("goals"))


@query("s1_season_scan", f"WITH {FACTS_SQL} SELECT season, count(*) AS n, CAST(sum(mins) AS BIGINT) AS mins, round(CAST(sum(xg) AS DOUBLE), 6) AS xg FROM f WHERE season = 1996 GROUP BY season")
def s1(spark, sf_dir):
    return facts(spark, sf_dir).filter("season = 1996").groupBy("season").agg(F.count("*").alias("n"), F.sum("mins").alias("mins"), F.round(total("xg"), 6).alias("xg"))


@query("s4_team_log", f"""WITH {FIXTURES_SQL}, t AS (SELECT l_orderkey AS fixture, s_nationkey AS team, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS scored FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 n AS (SELECT fixture, team, scored, 1 AS version FROM t UNION ALL SELECT fixture, team, 0.0, 2 FROM t WHERE fixture % 97 = 0)
 SELECT fixture, team, CASE WHEN team = opp THEN NULL ELSE opp END AS opponent, season, rnd, round(scored, 2) AS scored FROM (SELECT *, row_number() OVER (PARTITION BY fixture, team ORDER BY version DESC) AS k FROM n) JOIN x USING (fixture) WHERE k = 1""")
def s4(spark, sf_dir):
    """The team log with its opponent, where rows of a later version replace earlier ones."""
    lines, teams = table(spark, sf_dir, "lineitem"), players(spark, sf_dir)
    log = lines.join(teams, lines["l_suppkey"] == teams["player"]).groupBy(F.col("l_orderkey").alias("fixture"), "team").agg(total(F.col("l_extendedprice").cast("decimal(18,2)")).alias("scored"))
    fixes = log.filter("fixture % 97 = 0").withColumn("scored", F.lit(0.0))
    newest = J.upsert(log, fixes, ["fixture", "team"])
    return newest.join(fixtures(spark, sf_dir), "fixture").select("fixture", "team", F.when(F.col("team") != F.col("opp"), F.col("opp")).alias("opponent"), "season", "rnd", F.round("scored", 2).alias("scored"))


@query("s5_player_season", f"{LEADERBOARD_SQL} SELECT p.player, name, team, role, CAST(coalesce(m, 0) AS BIGINT) AS mins, coalesce(n, 0) AS games, round(g, 6) AS xg, round(h, 6) AS xa FROM p LEFT JOIN a ON p.player = a.player")
def s5(spark, sf_dir):
    t = player_totals(spark, sf_dir)
    return players(spark, sf_dir).join(t, "player", "left").select("player", "name", "team", "role", F.coalesce("mins", F.lit(0)).alias("mins"), F.coalesce("games", F.lit(0)).alias("games"), F.round("xg", 6).alias("xg"), F.round("xa", 6).alias("xa"))


@query("s6_player_match", f"WITH {FACTS_SQL} SELECT player, team, opp, season, rnd, venue, count(*) AS n, CAST(sum(goal) AS BIGINT) AS goals, CAST(sum(xg) AS DOUBLE) AS xg FROM f GROUP BY ALL")
def s6(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("player", "team", "opp", "season", "rnd", "venue").agg(F.count("*").alias("n"), F.sum("goal").alias("goals"), total("xg").alias("xg"))


@query("s8_roster", f"{LEADERBOARD_SQL} SELECT p.player, team, role, CAST(m AS BIGINT) AS mins, row_number() OVER (ORDER BY team, role, m DESC NULLS LAST, p.player) AS place FROM p LEFT JOIN a ON p.player = a.player")
def s8_all(spark, sf_dir):
    """Places of all players: those in their team and role, after the sizes of the teams and roles before."""
    rows = players(spark, sf_dir).join(player_totals(spark, sf_dir).select("player", "mins"), "player", "left")
    # one row a team and role
    before = Window.partitionBy(F.lit(1)).orderBy("team", "role").rowsBetween(Window.unboundedPreceding, -1)
    above = rows.groupBy("team", "role").agg(F.count("*").alias("n")).select("team", "role", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    order = Window.partitionBy("team", "role").orderBy(F.col("mins").desc_nulls_last(), "player")
    return rows.join(above, ["team", "role"]).select("player", "team", "role", "mins", (F.row_number().over(order) + F.col("above")).cast("long").alias("place"))


@query("s9_json_positions", "WITH m AS (SELECT DISTINCT user_id * 7 AS match FROM events WHERE user_id % 2 = 0), e AS (SELECT event_id, user_id * 7 AS match, event_type AS position, CAST(json_extract_string(props, '$.k') AS INT) AS mins, 'name ' || user_id % 40 AS name FROM events WHERE user_id % 5 <> 0) SELECT name, position, CAST(sum(mins) AS BIGINT) AS mins, (SELECT 2 * count(DISTINCT match) FROM e WHERE match IN (SELECT match FROM m)) < (SELECT count(*) FROM m) AS thin FROM e WHERE match IN (SELECT match FROM m) AND position <> 'Sub' AND mins > 0 GROUP BY 1, 2")
def s9(spark, sf_dir):
    """Minutes by name and position from JSON properties over the league's matches, without substitutes and zero minutes."""
    from touchline.functions.text import fold_unicode
    from touchline.sources.providers import position_minutes

    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    rows = e.filter("user_id % 5 <> 0").select((F.col("user_id") * 7).alias("match"), F.concat(F.lit("NAMÉ "), F.col("user_id") % 40).alias("name"), F.col("event_type").alias("position"), F.col("p.k").alias("mins"))
    return position_minutes(rows, e.filter("user_id % 2 = 0").select((F.col("user_id") * 7).alias("match")), fold_unicode)


@query("s11_ambiguous_names", "SELECT p_name AS name, count(DISTINCT p_partkey) AS ids, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def s11(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_partkey").alias("ids"), F.min("p_partkey").alias("first_id")).filter("ids > 1")


@query("s12_enrichment", f"WITH {PLAYERS_SQL} SELECT player, name, p_retailprice AS worth, p_brand AS brand FROM p LEFT JOIN (SELECT * FROM part WHERE 1990 + p_size % 9 = 1997) ON player = p_partkey")
def s12(spark, sf_dir):
    """Outside columns of exactly this season; of another season's file nothing is taken."""
    from touchline.sources.providers import enrich

    worth = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), (1990 + F.col("p_size") % 9).alias("season"), F.col("p_retailprice").alias("worth"), F.col("p_brand").alias("brand"))
    return enrich(players(spark, sf_dir).select("player", "name"), worth, 1997)


@query("s13_source_choice", f"WITH {FACTS_SQL}, own AS (SELECT opp AS team, CAST(sum(xg) AS DOUBLE) / count(xg) AS xg FROM f GROUP BY 1), ext AS (SELECT n_nationkey AS team, 1.0 + n_regionkey AS xg FROM nation WHERE n_regionkey < 4), k AS (SELECT count(*) AS n FROM ext JOIN own USING (team)) SELECT own.team, round(CAST(CASE WHEN k.n >= 20 THEN coalesce(ext.xg, own.xg) ELSE own.xg END AS DOUBLE), 6) AS xg FROM own LEFT JOIN ext USING (team) CROSS JOIN k")
def s13(spark, sf_dir):
    """External figures where at least 20 teams have one, else the computed ones."""
    own = facts(spark, sf_dir).groupBy(F.col("opp").alias("team")).agg(mean("xg").alias("own_xg"))
    given = table(spark, sf_dir, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("team"), (F.lit(1.0) + F.col("n_regionkey")).alias("given_xg"))
    enough = own.join(given, "team").agg((F.count("*") >= 20).alias("enough"))
    return own.join(given, "team", "left").join(enough).select("team", F.round(F.when(F.col("enough"), F.coalesce("given_xg", "own_xg")).otherwise(F.col("own_xg")), 6).alias("xg"))


@query("s25_metric_lines", """SELECT 'runs_total{stage="' || event_type || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type UNION ALL SELECT '# TYPE runs_total counter'""")
def s25(spark, sf_dir):
    from touchline.sources.sinks import metric_lines

    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("value"))
    return metric_lines(e, "runs_total", "counter", ["stage"])


@query("p1_as_of", f"WITH {FACTS_SQL}, c AS (SELECT * FROM f WHERE season = 1997 AND rnd <= 6) SELECT player, CAST(sum(mins) AS BIGINT) AS mins, round(CAST(sum(xg) AS DOUBLE) * 90 / sum(mins), 6) AS xg90 FROM c WHERE mins > 0 GROUP BY player")
def p1(spark, sf_dir):
    rows = J.as_of(facts(spark, sf_dir).filter("season = 1997"), "rnd", 6)
    return rows.filter("mins > 0").groupBy("player").agg(F.sum("mins").alias("mins"), F.round(per90("xg", "mins"), 6).alias("xg90"))


@query("p4_thresholds", f"WITH {FACTS_SQL}, g AS (SELECT max(n) AS g FROM (SELECT team, count(DISTINCT rnd) AS n FROM f WHERE season = 1997 GROUP BY team)), m AS (SELECT player, sum(mins) AS mins FROM f WHERE season = 1997 GROUP BY player) SELECT CAST(floor(g * 90 * 0.20) AS BIGINT) AS base, CAST(floor(g * 90 * 0.12) AS BIGINT) AS winter, greatest(CAST(floor(g * 90 * 0.20) AS BIGINT), CASE WHEN (SELECT count(*) FROM m) > 10 THEN CAST(floor((SELECT quantile_cont(mins, 0.3) FROM m)) AS BIGINT) ELSE 0 END) AS full_season FROM g")
def p4(spark, sf_dir):
    """Minutes to qualify: a share of the season, lifted to the 30th percentile where there are enough players."""
    return J.thresholds(facts(spark, sf_dir).filter("season = 1997"))


@query("p3_qualified", f"WITH {FACTS_SQL}, m AS (SELECT player, sum(mins) AS mins, min(rnd) AS first FROM f WHERE season = 1997 GROUP BY player) SELECT player, CAST(mins AS BIGINT) AS mins, first >= 2 AS winter FROM m WHERE mins >= CASE WHEN first >= 2 THEN 129 ELSE 216 END")
def p3(spark, sf_dir):
    m = facts(spark, sf_dir).filter("season = 1997").groupBy("player").agg(F.sum("mins").alias("mins"), (F.min("rnd") >= 2).alias("winter"))
    return m.filter(F.col("mins") >= F.when(F.col("winter"), 129).otherwise(216))


@query("p5_winter", f"WITH {FIXTURES_SQL} SELECT l_suppkey AS player, season, CAST(min(day) AS DATE) AS first_day, month(min(day)) = 1 OR (month(min(day)) = 2 AND day(min(day)) <= 5) AS winter FROM lineitem JOIN x ON l_orderkey = fixture WHERE l_quantity > 0 GROUP BY 1, 2")
def p5(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").join(fixtures(spark, sf_dir), F.col("l_orderkey") == F.col("fixture"))
    return rows.groupBy(F.col("l_suppkey").alias("player"), "season").agg(F.to_date(F.min("day")).alias("first_day")).withColumn("winter", (F.month("first_day") == 1) | ((F.month("first_day") == 2) & (F.dayofmonth("first_day") <= 5)))


@query("p6_rounds", f"WITH {FACTS_SQL}, t AS (SELECT season, team, count(DISTINCT rnd) AS n FROM f GROUP BY 1, 2) SELECT season, max(n) AS rounds, 2 * (count(*) - 1) AS total, max(n) < 2 * (count(*) - 1) AS in_progress FROM t GROUP BY season")
def p6(spark, sf_dir):
    t = facts(spark, sf_dir).groupBy("season", "team").agg(F.countDistinct("rnd").alias("n"))
    return t.groupBy("season").agg(F.max("n").alias("rounds"), (2 * (F.count("*") - 1)).alias("total")).withColumn("in_progress", F.col("rounds") < F.col("total"))


@query("p7_exclusion", f"WITH {FACTS_SQL} SELECT role, count(DISTINCT player) AS n_players, count(*) AS n FROM f WHERE role <> 'GK' GROUP BY role")
def p7(spark, sf_dir):
    """Excluded players leave the registry and their facts too."""
    kept, rows = J.exclude(players(spark, sf_dir), facts(spark, sf_dir), F.col("role") == "GK")
    return rows.groupBy("role").agg(F.countDistinct("player").alias("n_players"), F.count("*").alias("n"))


@query("p8_declared_exclusions", f"WITH {PLAYERS_SQL}, d(name) AS (VALUES ('Supplier#000000003'), ('SUPPLIER#000000005'), ('Nobody')) SELECT d.name AS declared, min(p.player) AS player FROM d LEFT JOIN p ON lower(d.name) = lower(p.name) GROUP BY 1")
def p8(spark, sf_dir):
    """Declared names by exact match or else without case; a name that matches nobody is reported with a null."""
    names = spark.createDataFrame([("Supplier#000000003",), ("SUPPLIER#000000005",), ("Nobody",)], "declared string")
    return J.match_names(names, players(spark, sf_dir))


@query("p9_leaderboard_filter", f"{LEADERBOARD_SQL} SELECT p.player, role, round(g * 90 / m, 6) AS xg90 FROM p JOIN a ON p.player = a.player WHERE team IN (1, 2, 3, 5, 8, 13, 21) AND role <> 'GK' AND g > 0 AND m > 0 AND CASE WHEN g / h > 1.26 THEN 'hot' WHEN g / h < 1.2 THEN 'cold' ELSE 'stable' END <> 'cold' AND p.player % 30 <= 12")
def p9(spark, sf_dir):
    """Team, role, form label and months of contract, where the metric is there and finite."""
    rows = players(spark, sf_dir).filter(F.col("team").isin(1, 2, 3, 5, 8, 13, 21) & (F.col("role") != "GK")).join(player_totals(spark, sf_dir), "player")
    form, months = F.col("xg") / F.col("xa"), F.col("player") % 30
    label = F.when(form > 1.26, "hot").when(form < 1.2, "cold").otherwise("stable")
    rows = rows.filter((F.col("xg") > 0) & (F.col("mins") > 0) & (label != "cold") & (months <= 12))
    value = F.col("xg") * 90 / F.col("mins")
    return rows.filter(value.isNotNull() & ~F.isnan(value)).select("player", "role", F.round(value, 6).alias("xg90"))


@query("p10_text_search", "SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'eleve') OR contains(strip_accents(lower(text)), 'cionar')")
def p10(spark, sf_dir):
    """Search that ignores accents and case, by collation."""
    folded = F.collate(F.col("text"), "UNICODE_CI_AI")
    return table(spark, sf_dir, "documents").filter(folded.contains(F.lit("eleve")) | folded.contains(F.lit("cionar"))).select("doc_id", "lang")


@query("p11_months", "SELECT o_orderkey AS fixture, CAST((2002 - year(o_orderdate)) * 12 + (6 - month(o_orderdate)) AS INT) AS months FROM orders WHERE (2002 - year(o_orderdate)) * 12 + (6 - month(o_orderdate)) <= 24")
def p11(spark, sf_dir):
    months = ((2002 - F.year("o_orderdate")) * 12 + (6 - F.month("o_orderdate"))).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture"), months.alias("months")).filter("months <= 24")


@query("p12_admissibility", f"{LEADERBOARD_SQL} SELECT p.player, concat_ws(';', CASE WHEN m < 15000 THEN 'minutes' END, CASE WHEN p.player % 10 / 10.0 < 0.7 THEN 'confidence' END, CASE WHEN n / 700.0 < 0.75 THEN 'availability' END, CASE WHEN p.player % 8 = 5 THEN 'loan' END) AS reasons FROM p JOIN a ON p.player = a.player")
def p12(spark, sf_dir):
    """Why a player is not admitted: minutes, confidence, availability, a loan."""
    rows = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player")
    rules = {"minutes": F.col("mins") < 15000, "confidence": F.col("player") % 10 / 10.0 < 0.7, "availability": F.col("games") / 700.0 < 0.75, "loan": F.col("player") % 8 == 5}
    return rows.select("player", F.array_join(J.reasons(rules), ";").alias("reasons"))


@query("p13_season_choice", f"WITH {FACTS_SQL}, m AS (SELECT season, player, sum(mins) AS mins FROM f GROUP BY 1, 2) SELECT max(season) AS season FROM (SELECT season FROM m GROUP BY season HAVING count(*) FILTER (WHERE mins > 1500) >= 40)")
def p13(spark, sf_dir):
    m = facts(spark, sf_dir).groupBy("season", "player").agg(F.sum("mins").alias("mins"))
    return m.groupBy("season").agg(F.count_if(F.col("mins") > 1500).alias("n")).filter("n >= 40").agg(F.max("season").alias("season"))


@query("p14_plausibility", "SELECT 'price' AS field, count(*) AS n FROM lineitem WHERE NOT l_extendedprice BETWEEN 2000 AND 90000 UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0.01 AND 0.09 UNION ALL SELECT 'quantity', count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 49")
def p14(spark, sf_dir):
    from touchline.operators.quality import out_of_range

    return out_of_range(table(spark, sf_dir, "lineitem"), {"price": ("l_extendedprice", 2000, 90000), "discount": ("l_discount", 0.01, 0.09), "quantity": ("l_quantity", 1, 49)})


@query("p15_case_map", f"WITH {PLAYERS_SQL} SELECT CASE WHEN balance < 0 THEN 'debt' WHEN balance < 3000 THEN 'low' WHEN balance < 7000 THEN 'middle' ELSE 'high' END AS class, role, count(*) AS n FROM p GROUP BY 1, 2")
def p15(spark, sf_dir):
    label = F.when(F.col("balance") < 0, "debt").when(F.col("balance") < 3000, "low").when(F.col("balance") < 7000, "middle").otherwise("high")
    return players(spark, sf_dir).groupBy(label.alias("class"), "role").agg(F.count("*").alias("n"))


@query("p17_season_consistency", "SELECT event_type AS file, count(DISTINCT 1997 + (user_id % 2) * CAST(event_type = 'error' AS INT)) AS seasons, bool_and(1997 + (user_id % 2) * CAST(event_type = 'error' AS INT) = 1997) AS usable FROM events GROUP BY 1")
def p17(spark, sf_dir):
    """Files may be used for a season only if all their records are of it; one of them mixes two."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), (1997 + F.col("user_id") % 2 * (F.col("event_type") == "error").cast("int")).alias("season"))
    return J.one_season(e, "file", "season", 1997)


@query("j3_opponent_self_join", "WITH t AS (SELECT l_orderkey AS fixture, s_nationkey AS team, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT a.team, count(*) AS n, round(CAST(sum(b.q) AS DOUBLE) / count(*), 6) AS faced FROM t a JOIN t b ON a.fixture = b.fixture AND a.team <> b.team GROUP BY a.team")
def j3(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(players(spark, sf_dir), F.col("l_suppkey") == F.col("player"))
    t = lines.groupBy(F.col("l_orderkey").alias("fixture"), "team").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    return J.opponents(t, "fixture", "team", ["q"]).groupBy("team").agg(F.count("*").alias("n"), F.round(mean("opp_q"), 6).alias("faced"))


@query("j5_computed_key", f"WITH {FACTS_SQL} SELECT n_name AS side, count(*) AS n FROM f JOIN nation ON n_nationkey = CASE WHEN venue = 'home' THEN team ELSE opp END GROUP BY 1")
def j5(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("host", F.when(F.col("venue") == "home", F.col("team")).otherwise(F.col("opp")))
    return rows.join(table(spark, sf_dir, "nation"), F.col("host") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("side")).agg(F.count("*").alias("n"))


@query("j6_anti_without", f"WITH {FACTS_SQL}, g AS (SELECT team, season, fixture, sum(xg) AS xg FROM f GROUP BY 1, 2, 3), k AS (SELECT DISTINCT player, fixture FROM f) SELECT p.player, season, count(*) AS n_without, CAST(sum(g.xg) AS DOUBLE) / count(*) AS xg_without FROM p JOIN g ON p.team = g.team WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.player = p.player AND k.fixture = g.fixture) GROUP BY 1, 2")
def j6(spark, sf_dir):
    """What each team made without each of its players, season by season."""
    rows = facts(spark, sf_dir)
    log = rows.groupBy("team", "season", "fixture").agg(F.sum("xg").alias("xg"))
    told = J.totals_without(players(spark, sf_dir), log, rows, "season", "xg")
    return told.select("player", "season", "n_without", (F.col("xg").cast("double") / F.col("n_without")).alias("xg_without"))


@query("j7_semi_join", f"{LEADERBOARD_SQL} SELECT p.player, name FROM p WHERE player IN (SELECT player FROM a WHERE m > 15000)")
def j7(spark, sf_dir):
    return players(spark, sf_dir).join(player_totals(spark, sf_dir).filter("mins > 15000"), "player", "left_semi").select("player", "name")


@query("j8_personal_top_n", f"WITH {FACTS_SQL}, d AS (SELECT opp AS rival, CAST(sum(xg) AS DOUBLE) / count(*) AS v FROM f GROUP BY 1), t AS (SELECT DISTINCT team FROM p) SELECT team, rival, k AS place FROM (SELECT team, rival, row_number() OVER (PARTITION BY team ORDER BY v, rival) AS k FROM t JOIN d ON team <> rival) WHERE k <= 6")
def j8(spark, sf_dir):
    d = facts(spark, sf_dir).groupBy(F.col("opp").alias("rival")).agg(mean("xg").alias("v"))
    return J.personal_top(players(spark, sf_dir).select("team").distinct(), d, 6)


@query("j10_one_to_one", f"{LEADERBOARD_SQL} SELECT p.player, round(g, 4) AS new, round(g * 1.01, 4) AS old FROM p JOIN a ON p.player = a.player")
def j10(spark, sf_dir):
    t = player_totals(spark, sf_dir).select("player", F.col("xg").alias("x"))
    return J.one_to_one(t.select("player", F.round("x", 4).alias("new")), t.select("player", F.round(F.col("x") * 1.01, 4).alias("old")), ["player"])


@query("j11_name_fallback", f"WITH {PLAYERS_SQL}, q AS (SELECT player + 100000 AS player, upper(name) AS name FROM p WHERE player % 2 = 0) SELECT p.player, q.player AS other FROM p JOIN q ON lower(p.name) = lower(q.name)")
def j11(spark, sf_dir):
    """By id where enough ids are common, else by normalised name."""
    p = players(spark, sf_dir).select("player", "name")
    other = p.filter("player % 2 = 0").select((F.col("player") + 100000).alias("player"), F.upper("name").alias("name"))
    return J.by_id_or_name(p, other, least=10)


@query("j12_orphans", "SELECT o_orderkey AS fixture FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture")).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fixture")), "fixture", "left_anti")


@query("j13_exists", "SELECT s_suppkey AS player, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '2001-12-01' AND l_returnflag = 'R') AS recent FROM supplier")
def j13(spark, sf_dir):
    recent = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz '2001-12-01' and l_returnflag = 'R'").select(F.col("l_suppkey").alias("player")).distinct().withColumn("hit", F.lit(True))
    return players(spark, sf_dir).select("player").join(recent, "player", "left").select("player", F.coalesce("hit", F.lit(False)).alias("recent"))


@query("j16_pairwise_compare", f"{LEADERBOARD_SQL} SELECT k AS dim, round(max(v) FILTER (WHERE player = 3), 6) AS one, round(max(v) FILTER (WHERE player = 8), 6) AS two, abs(max(v) FILTER (WHERE player = 3) - max(v) FILTER (WHERE player = 8)) >= 0.05 AS differs FROM (SELECT player, 'xg' AS k, g * 90 / m AS v FROM a UNION ALL SELECT player, 'xa', h * 90 / m FROM a) GROUP BY k")
def j16(spark, sf_dir):
    t = player_totals(spark, sf_dir).filter(F.col("player").isin(3, 8)).select("player", (F.col("xg") * 90 / F.col("mins")).alias("xg"), (F.col("xa") * 90 / F.col("mins")).alias("xa"))
    return J.compare(t, "player", 3, 8, ["xg", "xa"], 0.05)


@query("j17_reconcile", "WITH a AS (SELECT DISTINCT l_suppkey AS player, l_orderkey AS fixture FROM lineitem WHERE l_linenumber <= 5), b AS (SELECT DISTINCT l_suppkey AS player, l_orderkey AS fixture FROM lineitem WHERE l_linenumber >= 3) SELECT coalesce(a.player, b.player) AS player, count(*) FILTER (WHERE b.player IS NULL) AS only_left, count(*) FILTER (WHERE a.player IS NULL) AS only_right, count(*) FILTER (WHERE a.player IS NOT NULL AND b.player IS NOT NULL) AS both FROM a FULL JOIN b ON a.player = b.player AND a.fixture = b.fixture GROUP BY 1")
def j17(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("fixture"), "l_linenumber")
    return J.reconcile(rows.filter("l_linenumber <= 5"), rows.filter("l_linenumber >= 3"), "player", "fixture")


@query("u1_union_by_name", f"WITH {PLAYERS_SQL} SELECT player, name, team, NULL::VARCHAR AS brand FROM p UNION ALL SELECT p_partkey, NULL, NULL, p_brand FROM part WHERE p_size = 7")
def u1(spark, sf_dir):
    parts = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("player"), F.col("p_brand").alias("brand"))
    return players(spark, sf_dir).select("player", "name", "team").unionByName(parts, allowMissingColumns=True)


@query("u2_intersect", f"WITH {FACTS_SQL} SELECT DISTINCT player FROM f WHERE season = 1996 AND rnd = 1 INTERSECT SELECT DISTINCT player FROM f WHERE season = 1997 AND rnd = 1")
def u2(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return rows.filter("season = 1996 and rnd = 1").select("player").intersect(rows.filter("season = 1997 and rnd = 1").select("player"))


@query("u3_difference", f"WITH {FACTS_SQL} SELECT player, fixture FROM f WHERE venue = 'home' AND season = 1997 EXCEPT SELECT player, fixture FROM f WHERE venue = 'away'")
def u3(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return rows.filter("venue = 'home' and season = 1997").select("player", "fixture").subtract(rows.filter("venue = 'away'").select("player", "fixture"))


@query("u4_set_equality", "SELECT r_regionkey AS region, bool_and(n_nationkey IS NOT NULL) AS complete FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def u4(spark, sf_dir):
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_regionkey").alias("region")).agg(F.bool_and(F.col("n_nationkey").isNotNull()).alias("complete"))


@query("u5_distinct_edges", "SELECT min(event_id) AS first_run, event_type AS a, user_id AS b FROM events GROUP BY event_type, user_id")
def u5(spark, sf_dir):
    """Distinct edges, each with the first run that has it."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("a"), F.col("user_id").alias("b")).agg(F.min("event_id").alias("first_run"))


@query("u6_axis_union", f"WITH {FACTS_SQL} SELECT rnd FROM f WHERE team = 3 AND season = 1996 UNION SELECT rnd FROM f WHERE team = 8 AND season = 1999")
def u6(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return rows.filter("team = 3 and season = 1996").select("rnd").union(rows.filter("team = 8 and season = 1999").select("rnd")).distinct()


@query("t2_best_per_role", f"{LEADERBOARD_SQL} SELECT role, p.player, k AS place FROM (SELECT role, p.player, row_number() OVER (PARTITION BY role ORDER BY g / m DESC, p.player) AS k FROM p JOIN a ON p.player = a.player) AS p WHERE k <= 2")
def t2(spark, sf_dir):
    rows = players(spark, sf_dir).join(player_totals(spark, sf_dir), "player")
    return top_n(rows, ["role"], [(F.col("xg") / F.col("mins")).desc(), F.col("player")], 2).select("role", "player", F.col("place").cast("long").alias("place"))


@query("t3_top_overlap", f"{LEADERBOARD_SQL}, u AS (SELECT player FROM a ORDER BY g DESC, player LIMIT 20), v AS (SELECT player FROM a ORDER BY h DESC, player LIMIT 20) SELECT count(*) AS common FROM u JOIN v USING (player)")
def t3(spark, sf_dir):
    return J.top_overlap(player_totals(spark, sf_dir), "player", "xg", "xa", 20)


@query("t4_bottom_n", f"WITH {FACTS_SQL} SELECT opp AS team, round(CAST(sum(xg) AS DOUBLE) / count(*), 6) AS xg FROM f GROUP BY 1 ORDER BY CAST(sum(xg) AS DOUBLE) / count(*), opp LIMIT 6")
def t4(spark, sf_dir):
    d = facts(spark, sf_dir).groupBy(F.col("opp").alias("team")).agg(mean("xg").alias("x"))
    return d.orderBy("x", "team").limit(6).select("team", F.round("x", 6).alias("xg"))


@query("t5_leaderboard", f"{LEADERBOARD_SQL} SELECT player, round((g + h) * 90 / m, 6) AS score FROM a ORDER BY (g + h) * 90 / m DESC, player LIMIT 25")
def t5(spark, sf_dir):
    return flagship(spark, sf_dir).select("player", "score")


@query("t7_severity_sort", "SELECT event_id AS run, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, value DESC NULLS LAST, event_id) AS place FROM events")
def t7_all(spark, sf_dir):
    """Places of all events, each severity spread by value, after the sizes of those above it."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), "value", rank.alias("rank"))
    above = e.agg(*[F.count_if(F.col("rank") < k).alias(f"above{k}") for k in range(3)])
    parts = [place(e.filter(F.col("rank") == k), "value", ["run"], "place").join(above).select("run", (F.col("place") + F.col(f"above{k}")).alias("place")) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("t8_natural_sort", "SELECT p_brand AS label, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS number, count(*) AS n FROM part GROUP BY 1, 2")
def t8(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("number")).agg(F.count("*").alias("n")).orderBy("number")


def flagship(spark: SparkSession, sf_dir: str, n: int = 25) -> DataFrame:
    """Leaderboard: scan, season aggregate, rate for 90 minutes, top n."""
    t = player_totals(spark, sf_dir).withColumn("raw", (F.col("xg") + F.col("xa")) * 90 / F.col("mins"))
    return t.join(players(spark, sf_dir), "player").orderBy(F.col("raw").desc(), "player").limit(n).select("player", "name", "role", "team", F.round("raw", 6).alias("score"))
