"""Queries that write, and read back what they wrote: payloads, lists, snapshots, archives, logs and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.operators.cuts import cut
from touchline.sources import providers, seasons, settings, sinks, snapshots
from touchline.sources.factstore import FactStore
from touchline.sources.versions import VersionedTable

from .binding import FACTS_SQL, MATCHES_SQL, PLAYERS_SQL, RUNS_SQL, facts, matches, players, runs, table
from .lineage import LineageLog
from .monitoring import scratch
from .registry import query
from .scans import LEADERBOARD_SQL, player_totals


@query("s10_rosters", "SELECT l_orderkey AS match, l_suppkey AS player_id, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS mins, CAST(sum(greatest(0, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END - p.g)) AS BIGINT) AS npg FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS k FROM lineitem) l JOIN (SELECT l_orderkey AS m, l_suppkey AS s, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS g FROM lineitem GROUP BY 1, 2) p ON l_orderkey = p.m AND l_suppkey = p.s WHERE l_orderkey % 1000 <> 7 GROUP BY 1, 2")
def s10(spark, sf_dir):
    """Match files as text, some of them broken: rosters with goals less penalties."""
    line = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("player "), F.col("l_suppkey"))
    person = F.struct(F.col("l_suppkey").cast("string").alias("player_id"), name.alias("player"), F.lit("FW").alias("position"), F.col("l_quantity").cast("int").cast("string").alias("time"), F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("goals"), F.col("l_discount").cast("string").alias("xG"))
    shot = F.struct(name.alias("player"), F.when(F.col("l_linestatus") == "O", "Penalty").otherwise("OpenPlay").alias("situation"), F.when(F.col("l_returnflag") == "R", "Goal").otherwise("Saved").alias("result"), F.col("l_discount").cast("string").alias("xG"))
    sides = line.groupBy("l_orderkey").agg(F.collect_list(person).alias("people"), F.collect_list(shot).alias("kicks"))
    roster = F.map_from_entries(F.transform("people", lambda p, i: F.struct(i.cast("string").alias("key"), p.alias("value"))))
    text = F.to_json(F.struct(F.create_map(F.lit("h"), roster).alias("rosters"), F.create_map(F.lit("h"), F.col("kicks")).alias("shots")))
    files = sides.select(F.col("l_orderkey").alias("match"), F.when(F.col("l_orderkey") % 1000 == 7, F.lit("{ broken")).otherwise(text).alias("text"))
    rows = providers.roster_rows(providers.parsed_matches(files))
    return rows.groupBy("match", "player_id").agg(F.sum("mins").alias("mins"), F.sum("npg").alias("npg"))


@query("s14_payload", f"{LEADERBOARD_SQL} SELECT player, CASE WHEN player % 4 = 0 THEN NULL ELSE round(g, 4) END AS xg, '1997' AS season, 'r6' AS as_of, 'payload-1997-r6-full' AS name, 'payload-all-seasons' AS whole FROM a")
def s14(spark, sf_dir):
    """A payload written as strict JSON and read again, with the names that payloads have."""
    bad = F.when(F.col("player") % 8 == 0, F.lit(float("nan"))).when(F.col("player") % 4 == 0, F.lit(float("-inf"))).otherwise(F.round("xg", 4))
    df = player_totals(spark, sf_dir).select("player", bad.alias("xg"), F.lit("1997").alias("season"), F.lit("r6").alias("as_of"))
    name = sinks.payload_name("1997", 6, full=True)
    path = f"{scratch(spark)}/{name}"
    sinks.write_payload(df, path, ["season", "as_of"])
    return spark.read.schema("player long, xg double, season string, as_of string").json(path).select("player", "xg", "season", "as_of", F.lit(name).alias("name"), F.lit(sinks.payload_name(None)).alias("whole"))


@query("s16_table", f"{LEADERBOARD_SQL} SELECT player, CAST(m AS BIGINT) AS mins, round_even(h, 4) AS xa FROM a")
def s16(spark, sf_dir):
    """A CSV of the columns that exist, floating ones rounded, read again."""
    path = f"{scratch(spark)}/table"
    sinks.write_table(player_totals(spark, sf_dir), path, ["player", "mins", "nothing", "xa"])
    return spark.read.schema("player long, mins long, xa double").option("header", "true").csv(path)


@query("s17_client_lines", f"WITH {PLAYERS_SQL}, r AS (SELECT row_number() OVER (ORDER BY balance DESC, player) AS place, name || CASE WHEN player % 3 = 0 THEN ', \"Jr\"' ELSE '' END AS name, role FROM p WHERE role <> 'GK') SELECT place, CASE WHEN contains(name, ',') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END || ',' || role AS line FROM r UNION ALL SELECT 0, chr(65279) || 'name,role'")
def s17(spark, sf_dir):
    """The filtered and sorted list as a client takes it home."""
    rows = players(spark, sf_dir).filter("role <> 'GK'").withColumn("name", F.concat("name", F.when(F.col("player") % 3 == 0, ', "Jr"').otherwise("")))
    return sinks.client_lines(rows, ["name", "role"], [F.col("balance").desc(), F.col("player")])


@query("s18_snapshot", "SELECT 'nation' AS name, count(*) AS n, 0 AS errors, count(*) AS restored FROM nation UNION ALL SELECT 'orders', count(*), 0, count(*) FROM orders")
def s18(spark, sf_dir):
    """Two tables sealed, verified and restored (s18 to s20)."""
    folder = scratch(spark)
    tables = {"nation": (table(spark, sf_dir, "nation"), ["n_nationkey"]), "orders": (table(spark, sf_dir, "orders"), ["o_orderkey"])}
    snapshots.write_snapshot(tables, f"{folder}/sealed")
    errors = snapshots.verify_snapshot(spark, f"{folder}/sealed").count()
    made = []
    for name in tables:
        n = snapshots.restore_snapshot(spark, f"{folder}/sealed", name, f"{folder}/back-{name}")
        made.append((name, n, errors, snapshots.restore_snapshot(spark, f"{folder}/sealed", name, f"{folder}/back-{name}", dry_run=False)))
    return spark.createDataFrame(made, "name string, n long, errors int, restored long")


@query("s21_load_snapshot", f"{LEADERBOARD_SQL} SELECT player AS player_id, round(g, 6) AS value, CAST(m AS INT) AS mins, CAST(NULL AS VARCHAR) AS name FROM a")
def s21(spark, sf_dir):
    """A table of a snapshot with the types that a comparison wants."""
    folder = f"{scratch(spark)}/sealed"
    snapshots.write_snapshot({"ratings": (player_totals(spark, sf_dir).select(F.col("player").alias("player_id"), F.round("xg", 6).alias("value"), "mins"), ["player_id"])}, folder)
    return snapshots.load_snapshot(spark, folder, "ratings", "player_id long, value double, mins int, name string", "player_id")


@query("s22_provider", f"WITH {PLAYERS_SQL} SELECT CAST(player AS BIGINT) AS player_id, 'fixed' AS provider, '1997' AS season, name FROM p WHERE player % 3 = 1")
def s22(spark, sf_dir):
    """A provider's players of one season in canonical columns."""
    season = F.when(F.col("player") % 3 == 1, "1997").otherwise("1998")
    given = players(spark, sf_dir).select(F.col("player").alias("player_id"), season.alias("season"), "name", F.col("team").cast("string").alias("team"), F.col("role").alias("position"), F.lit(None).cast("string").alias("birth_date"), F.lit(None).cast("string").alias("nationality"), "balance")
    return providers.FixedProvider("fixed", {"players": given}).fetch(spark, "players", "1997").select("player_id", "provider", "season", "name")


@query("s22_provider_source", f"WITH {PLAYERS_SQL} SELECT CAST(player AS BIGINT) AS player_id, 'files' AS provider, CASE player % 3 WHEN 1 THEN '1997' ELSE '1999' END AS season, name, CAST(team AS VARCHAR) AS team, role AS position, CAST(NULL AS VARCHAR) AS birth_date FROM p WHERE player % 3 <> 0 AND role <> 'GK'")
def s22_source(spark, sf_dir):
    """A provider's files of three seasons, of which two are read, as a data source that takes the filter on the season and leaves the other."""
    season = F.element_at(F.array(F.lit("1998"), F.lit("1997"), F.lit("1999")), (F.col("player") % 3 + 1).cast("int"))
    given = players(spark, sf_dir).select(F.col("player").alias("player_id"), season.alias("season"), "name", F.col("team").cast("string").alias("team"), F.col("role").alias("position"))
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    given.write.partitionBy("season").parquet(folder)
    held = seasons.read_seasons(spark, folder, "players", "files")
    return held.filter("season in ('1997', '1999') and position <> 'GK'").select("player_id", "provider", "season", "name", "team", "position", "birth_date")


@query("s23_archive", "SELECT '1997' AS season, true AS first, false AS again, count(*) AS kept FROM orders WHERE year(o_orderdate) = 1997")
def s23(spark, sf_dir):
    """A finished season is archived once; a second attempt with other rows changes nothing."""
    folder = scratch(spark)
    done = table(spark, sf_dir, "orders").filter("year(o_orderdate) = 1997")
    first, again = sinks.archive_season(done, folder, "1997"), sinks.archive_season(done.limit(1), folder, "1997")
    return spark.createDataFrame([("1997", first, again, spark.read.parquet(f"{folder}/season=1997").count())], "season string, first boolean, again boolean, kept long")


@query("s24_log", f"WITH {RUNS_SQL} SELECT run, stage FROM r ORDER BY run DESC LIMIT 12")
def s24(spark, sf_dir):
    """A log appended to twice, and its last lines."""
    path, r = f"{scratch(spark)}/log", runs(spark, sf_dir).select("run", "stage")
    sinks.append_log(r.filter("run % 2 = 0"), path)
    sinks.append_log(r.filter("run % 2 = 1"), path)
    return sinks.tail_log(spark, path, "run long, stage string", "run", 12)


@query("s26_settings", "SELECT event_type AS stage, count(*) FILTER (WHERE value > 120.5) AS high, count(*) FILTER (WHERE value > 150) AS critical FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def s26(spark, sf_dir):
    """Limits from a settings file over defaults, used in a query."""
    given = "# limits\nlevels:\n  high: 120.5  # was 100\nstages: [error, view]\n"
    limits = settings.over({"levels": {"high": 100.0, "critical": 150.0}, "stages": []}, settings.read(given))
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(limits["stages"]))
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count_if(F.col("value") > limits["levels"]["high"]).alias("high"), F.count_if(F.col("value") > limits["levels"]["critical"]).alias("critical"))


@query("d26_run_log", "SELECT 'load' AS stage, 'ok' AS status, CAST(0 AS INT) AS exit_code, (SELECT count(*) FROM nation) AS rows_out, 1 AS outputs, 0 AS inputs UNION ALL SELECT 'rate', 'fail', 1, NULL, 0, 1 UNION ALL SELECT 'outer', 'ok', 0, NULL, 0, 0")
def d26_log(spark, sf_dir):
    """Nested runs with an artifact that one makes and another reads; the second fails (d26, d31)."""
    log = LineageLog(spark, scratch(spark))
    with log.scope("outer") as outer:
        load_ = log.start("load", outer)
        log.artifact(load_, "out", "table", "/nation")
        log.finish(load_, rows_out=table(spark, sf_dir, "nation").count())
        log.finish(load_, "fail")  # closed: stays as it is
        try:
            with log.scope("rate", outer) as rate:
                log.artifact(rate, "in", "table", "/nation")
                raise ValueError("no players")
        except ValueError:
            pass
    art = log.artifacts().groupBy("run_id").agg(F.count_if(F.col("direction") == "out").cast("int").alias("outputs"), F.count_if(F.col("direction") == "in").cast("int").alias("inputs"))
    return log.runs().join(art, "run_id", "left").select("stage", "status", "exit_code", "rows_out", F.coalesce("outputs", F.lit(0)).alias("outputs"), F.coalesce("inputs", F.lit(0)).alias("inputs"))


@query("s4_fact_store", f"""WITH {FACTS_SQL}, {MATCHES_SQL}, c AS (SELECT season, fixture, player, goal + 1 AS goal, mins FROM m WHERE season = 1997 AND fixture % 10 = 3 UNION ALL SELECT season, fixture + 100000000, player, goal, mins FROM m WHERE season = 1998 AND rnd = 1 AND player % 10 = 3),
 n AS (SELECT season, fixture, player, goal, mins FROM m WHERE NOT (season = 1997 AND fixture % 10 = 3) UNION ALL SELECT * FROM c) SELECT season, count(*) AS n, count(DISTINCT fixture) AS fixtures, CAST(sum(goal) AS BIGINT) AS goals, CAST(sum(mins) AS BIGINT) AS mins FROM n GROUP BY 1""")
def s4_store(spark, sf_dir):
    """All seasons in a partitioned and bucketed table, with corrections of one season and additions to another, made twice."""
    rows = matches(facts(spark, sf_dir)).select("fixture", "player", "team", "rnd", "opp", "goal", "mins", "season")
    fixed = rows.filter("season = 1997 and fixture % 10 = 3").withColumn("goal", F.col("goal") + 1)
    added = rows.filter("season = 1998 and rnd = 1 and player % 10 = 3").withColumn("fixture", F.col("fixture") + 100_000_000)
    store = FactStore(spark, f"facts_{uuid.uuid4().hex}", "season", "player", ["fixture", "player"], 8)
    store.upsert(rows)
    for _ in range(2):
        store.upsert(fixed.unionByName(added))
    found = cut(store.table().groupBy("season").agg(F.count("*").alias("n"), F.countDistinct("fixture").alias("fixtures"), F.sum("goal").alias("goals"), F.sum("mins").alias("mins")))
    store.drop()
    return found


@query("d15_guarded_repair", f"""{LEADERBOARD_SQL}, r AS (SELECT player FROM p WHERE player % 20 <> 19), o AS (SELECT player, player IN (SELECT player FROM r) AS known, player % 7 = 3 AS off FROM a),
 c AS (SELECT count(*) AS n, count(*) FILTER (WHERE known) AS k, count(*) FILTER (WHERE known AND off) AS c FROM o)
 SELECT 'dry run' AS step, n AS rows_in, k AS rows_out, CAST(0 AS BIGINT) AS added, n - k AS removed, c AS changed, CAST(0 AS BIGINT) AS broken, CAST(NULL AS BIGINT) AS version, n AS rows_now FROM c UNION ALL SELECT 'refused', n, n, 0, 0, 0, n - k, NULL, n FROM c UNION ALL SELECT 'done', n, k, 0, n - k, c, 0, 2, k FROM c UNION ALL SELECT 'taken back', k, n, n - k, 0, c, 0, 3, n FROM c""")
def d15_guarded(spark, sf_dir):
    """Figures of players that are not in the registry go, and others are corrected: tried, refused where a guard does not hold, done, and taken back."""
    stated = player_totals(spark, sf_dir).select("player", (F.col("mins") + F.when(F.col("player") % 7 == 3, 1).otherwise(0)).alias("mins"), "games")
    registry = players(spark, sf_dir).filter("player % 20 <> 19").select("player")
    right = player_totals(spark, sf_dir).select("player", "mins", "games")
    mended = right.join(registry, "player", "left_semi")
    guards = {"has a place in the registry": F.col("known"), "minutes": F.col("mins") >= 0}
    known = lambda df: df.join(registry.withColumn("known", F.lit(True)), "player", "left")
    made = VersionedTable(spark, f"{scratch(spark)}/{uuid.uuid4().hex}", ["player"])
    made.create(known(stated))
    told = lambda step, r: (step, r.rows_in, r.rows_out, r.added, r.removed, r.changed, sum(r.broken.values()), r.version, made.read().count())
    rows = [told("dry run", made.repair(known(mended), guards)), told("refused", made.repair(known(stated), guards, dry_run=False)), told("done", made.repair(known(mended), guards, dry_run=False))]
    before = made.read()
    gap = made.difference(before, made.read(1))
    version = made.back_to(1)
    rows.append(("taken back", before.count(), made.read().count(), *gap, 0, version, made.read().count()))
    return spark.createDataFrame(rows, "step string, rows_in long, rows_out long, added long, removed long, changed long, broken long, version long, rows_now long")
