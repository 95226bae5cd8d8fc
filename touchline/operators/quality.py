"""Data-quality checks as findings, and guarded repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def out_of_range(df: DataFrame, rules: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(field, n): rows whose value lies outside its range, in one pass."""
    counts = [F.struct(F.lit(name).alias("field"), F.count_if(~F.col(c).between(low, high)).alias("n")) for name, (c, low, high) in rules.items()]
    return df.agg(F.array(*counts).alias("_counts")).select(F.inline("_counts"))


def count_broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(code, n): rows for which a rule is broken, all rules in one pass; a rule about nulls breaks nothing."""
    counts = [F.struct(F.lit(code).alias("code"), F.count_if(broken).alias("n")) for code, broken in rules.items()]
    return df.agg(F.array(*counts).alias("_counts")).select(F.inline("_counts"))


def same_names(people: DataFrame, normal) -> DataFrame:
    """(kind, name, team, ids) of normalised names, and of names with surnames, that one team has under several ids.

    people: (id, name, surname, team).
    """
    keys = F.array(F.struct(F.lit("name").alias("kind"), F.col("_n").alias("name")), F.struct(F.lit("full").alias("kind"), F.concat_ws(" ", "_n", "_s").alias("name")))
    long = people.select("id", "team", normal(F.col("name")).alias("_n"), normal(F.col("surname")).alias("_s")).select("id", "team", F.inline(keys))
    return long.groupBy("kind", "name", "team").agg(F.countDistinct("id").alias("ids")).filter("ids > 1")


def merge_text(frames: DataFrame, key: list[str], column: str, precedence: list[str]) -> DataFrame:
    """key, the text of the first provider that has one, `conflict`: whether others differ beyond case and space, and `seen`: providers with a text."""
    place = F.array_position(F.array(*map(F.lit, precedence)), F.col("provider"))
    rows = frames.filter(F.col(column).isNotNull()).withColumn("_place", F.when(place == 0, len(precedence) + 1).otherwise(place))
    found = rows.groupBy(*key).agg(F.min_by(column, F.struct("_place", "provider")).alias(column), F.countDistinct(F.lower(F.trim(column))).alias("_kinds"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("seen"))
    return found.select(*key, column, (F.col("_kinds") > 1).alias("conflict"), "seen")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of the keys that stand on several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key no parent has."""
    known = parent.select(F.col(parent_key).alias("_known"))
    return df.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_known"), "left_anti")


def finding(df: DataFrame, code: str, severity: str) -> DataFrame:
    """(code, severity, n): a finding with the number of offending rows; none if there are none."""
    return df.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")


def report(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def health(findings: DataFrame, deductions: dict[str, int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., score): 100 less the deduction of each finding, between 0 and 100."""
    loss = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), list(deductions.items())[1:], F.when(F.col("severity") == next(iter(deductions)), next(iter(deductions.values())))).otherwise(0)
    return findings.groupBy(*by).agg(F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce(F.sum(loss), F.lit(0)))).cast("long").alias("score"))


def aggregate_mismatch(registry: DataFrame, facts: DataFrame, key: str, stated: str, value: Column, condition: Column, tolerance: float) -> DataFrame:
    """(key, stated, summed): registry figures that differ from the sum of the facts that meet the condition.

    The condition belongs to the join, so entities without such facts are compared with 0.
    """
    sums = facts.filter(condition).groupBy(key).agg(F.sum(value).alias("summed"))
    joined = registry.join(sums, key, "left").withColumn("summed", F.coalesce("summed", F.lit(0)))
    return joined.filter(F.abs(F.col(stated) - F.col("summed")) > tolerance).select(key, stated, "summed")


def remove_homonym_rows(facts: DataFrame, source: DataFrame, key: tuple[str, str] = ("player", "fixture"), mins: str = "mins", same: tuple[str, ...] = ("mins", "goals", "xg", "xa")) -> tuple[DataFrame, DataFrame]:
    """facts without rows that are somebody else's, and the players (player, unexplained) that are left as they were.

    A row is somebody else's if the source does not credit its player in that
    fixture at those minutes, credits another one there at the same minutes, and
    that other player's row here is equal in all of `same`. A player is repaired
    only if then every row that stays is one that the source confirms.
    """
    player, fixture = key
    credit = source.select(player, fixture, F.col(mins).alias("_m")).distinct()
    match = [facts[k] == credit[k] for k in key]
    loose = facts.join(credit, [*match, facts[mins] == credit["_m"]], "left_anti")
    other = credit.select(F.col(player).alias("_other"), F.col(fixture).alias("_f"), "_m")
    twin = facts.select(F.col(player).alias("_other"), F.col(fixture).alias("_f"), *[F.col(c).alias(f"_t_{c}") for c in same])
    twin = other.join(twin, ["_other", "_f"])
    alike = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in same]
    theirs = loose.join(twin, [F.col(fixture) == F.col("_f"), F.col(mins) == F.col("_m"), F.col(player) != F.col("_other"), *alike], "left_semi")
    wrong = theirs.select(player, fixture, mins).distinct()
    unexplained = loose.join(wrong, [player, fixture, mins], "left_anti").groupBy(player).agg(F.count("*").alias("unexplained"))
    refused = unexplained.join(wrong.select(player).distinct(), player, "left_semi")
    accepted = wrong.join(refused, player, "left_anti")
    return facts.join(accepted, [player, fixture, mins], "left_anti"), refused


def import_missing(rows: DataFrame, source: DataFrame, names: DataFrame, penalties: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to add so that players have all their games of the source, and (player, reason) of those that are left alone.

    rows: (player, fixture); source: (player, fixture, goals, xg); names:
    (player, name); penalties: (player, fixture, pen_goals, pen_xg); calendar:
    (fixture). Nothing at all is added while two players of one name have games
    (they have to be merged first). A player without games here or in the source
    stays as it is; one with a missing game outside the calendar, or with a game
    that the source does not have, is left alone. Goals and expected goals
    without penalties are not below zero.
    """
    have = rows.select("player", "fixture").distinct()
    given = source.select("player", "fixture").distinct()
    active = have.select("player").distinct()
    split = names.join(active, "player", "left_semi").groupBy("name").agg(F.countDistinct("player").alias("n")).filter("n > 1")
    blocked = split.agg((F.count("*") > 0).alias("_blocked"))
    known = active.join(given.select("player").distinct(), "player", "left_semi")
    missing = given.join(known, "player", "left_semi").join(have, ["player", "fixture"], "left_anti")
    lost = missing.join(calendar.select("fixture"), "fixture", "left_anti").groupBy("player").agg(F.lit("outside the calendar").alias("reason"))
    beyond = have.join(known, "player", "left_semi").join(given, ["player", "fixture"], "left_anti").select("player").distinct().select("player", F.lit("more games than the source").alias("reason"))
    refused = lost.union(beyond).groupBy("player").agg(F.min("reason").alias("reason"))
    added = missing.join(refused, "player", "left_anti").join(source, ["player", "fixture"]).join(penalties, ["player", "fixture"], "left").join(blocked).filter("not _blocked")
    npg = F.greatest(F.lit(0), F.col("goals") - F.coalesce("pen_goals", F.lit(0)))
    npxg = F.round(F.greatest(F.lit(0.0), F.col("xg") - F.coalesce("pen_xg", F.lit(0.0))), 3)
    return added.select("player", "fixture", "goals", "xg", npg.alias("npg"), npxg.alias("npxg")), refused


def remove_orphan_games(rows: DataFrame, source: DataFrame, owner: str, item: str) -> DataFrame:
    """rows without items the source does not have, for owners whose remaining items are then exactly the source's."""
    own, given = rows.select(owner, item).distinct(), source.select(owner, item).distinct()
    missing = given.join(own, [owner, item], "left_anti").select(owner).distinct()
    accepted = own.join(given.select(owner).distinct(), owner, "left_semi").join(missing, owner, "left_anti").select(owner).distinct()
    gone = own.join(given, [owner, item], "left_anti").join(accepted, owner, "left_semi")
    return rows.join(gone, [owner, item], "left_anti")


def merge_split(games: DataFrame, names: DataFrame, source: DataFrame) -> DataFrame:
    """(name, keep, drop): two records of one name whose games are disjoint and together inside the source's.

    games: (id, game); names: (id, name); source: (name, game).
    """
    sets = games.groupBy("id").agg(F.collect_set("game").alias("games")).join(names, "id")
    pairs = sets.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "games"))).alias("r")).filter("n = 2")
    given = source.groupBy("name").agg(F.collect_set("game").alias("given"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    fits = (F.size(F.array_intersect(first["games"], second["games"])) == 0) & (F.size(F.array_except(F.array_union(first["games"], second["games"]), F.col("given"))) == 0)
    return pairs.join(given, "name").filter(fits).select("name", first["id"].alias("keep"), second["id"].alias("drop"))


def provider_merge(frames: DataFrame, key: list[str], columns: list[str], precedence: list[str], spread: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """One row a key with the value of the first provider that has one, and the columns on which providers disagree.

    NaN and infinities count as missing. Numbers conflict where their range is
    more than `spread` of the absolute mean.
    """
    place = F.array_position(F.array(*map(F.lit, precedence)), F.col("provider"))
    ranked = frames.withColumn("_place", F.when(place == 0, len(precedence) + 1).otherwise(place))
    long = ranked.unpivot([*key, "provider", "_place"], columns, "column", "value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    chosen = long.groupBy(*key).pivot("column", columns).agg(F.min_by("value", F.struct("_place", "provider")))
    width = F.max("value") - F.min("value")
    conflicts = long.groupBy(*key, "column").agg(F.countDistinct("provider").alias("providers"), width.alias("width"), F.abs(F.avg("value")).alias("level"))
    conflicts = conflicts.filter((F.col("providers") > 1) & (F.col("width") > spread * F.col("level")) & (F.col("width") > 0)).select(*key, "column", "providers")
    return chosen, conflicts


def resolve_entities(names: DataFrame, registry: DataFrame, normal) -> DataFrame:
    """names (name, team) with id, status, confidence and up to five candidates by a cascade of exact and unique matches.

    registry: (id, name, team, at); of rows with one name and team the last at
    counts. Name and team: 1.0. A name that one entity has, whose team is another
    spelling of the one asked for: 0.95; without a team: 0.6. A name that several
    have, or one of another team, is ambiguous; what is not OK goes to quarantine
    with its candidates.
    """
    newest = Window.partitionBy("_key", "team").orderBy(F.col("at").desc())
    known = registry.withColumn("_key", normal(F.col("name"))).withColumn("_k", F.row_number().over(newest)).filter("_k = 1")
    exact = known.select("_key", F.col("team"), F.col("id").alias("exact_id"))
    listed = F.slice(F.array_sort(F.collect_set("id")), 1, 5)
    by_name = known.groupBy("_key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("only_id"), F.min("team").alias("only_team"), listed.alias("candidates"))
    rows = names.withColumn("_key", normal(F.col("name"))).join(exact, ["_key", "team"], "left").join(by_name, "_key", "left")
    same = normal(F.col("team").cast("string")) == normal(F.col("only_team").cast("string"))
    tier = F.when(F.col("exact_id").isNotNull(), 1.0).when((F.col("n") == 1) & F.col("team").isNull(), 0.6).when((F.col("n") == 1) & same, 0.95).otherwise(0.0)
    rows = rows.withColumn("confidence", tier)
    status = F.when(F.col("confidence") > 0, "OK").when(F.col("n").isNull(), "NOT_FOUND").otherwise("AMBIGUOUS")
    found = F.when(F.col("confidence") > 0, F.coalesce("exact_id", "only_id"))
    return rows.select("name", "team", found.alias("id"), status.alias("status"), "confidence", F.when(status != "OK", F.coalesce("candidates", F.array().cast(rows.schema["candidates"].dataType))).alias("candidates"))


def corrected(stated: DataFrame, found: DataFrame, clean) -> DataFrame:
    """player, mins, games, xg, name, role as they should be, and the codes of what each row's correction is for.

    stated: what a registry says; found: (player, mins, games, xg, role) from the
    facts. Entities of the facts that the registry lacks are left out.
    """
    f = found.select("player", *[F.col(c).alias(f"_{c}") for c in ("mins", "games", "xg", "role")])
    rows = stated.join(f, "player", "left").withColumn("_name", clean(F.col("name")))
    now = {c: F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in ("mins", "games", "xg")}
    codes = {
        "CON-001": F.abs(now["mins"] - F.col("mins")) > 30, "CON-002": now["games"] != F.col("games"), "CON-003": F.abs(now["xg"] - F.col("xg")) > 0.5,
        "NAM-001": F.col("_name") != F.col("name"), "NAM-003": F.col("role").isNull() & F.col("_role").isNotNull(),
    }
    fixes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in codes.items()]))
    return rows.select("player", *[v.alias(c) for c, v in now.items()], F.col("_name").alias("name"), F.coalesce("role", "_role").alias("role"), fixes.alias("fixes"))


def site_report(pages: DataFrame, teams: DataFrame, least: int) -> DataFrame:
    """seasons, brands, enough, orphan_pages and teams_without_page of (brand, season, team) pages."""
    shown = pages.select("team").distinct()
    whole = pages.agg(F.countDistinct("season").alias("seasons"), F.countDistinct("brand").alias("brands"), (F.countDistinct("team") >= least).alias("enough"))
    return whole.join(shown.join(teams, "team", "left_anti").agg(F.count("*").alias("orphan_pages"))).join(teams.join(shown, "team", "left_anti").agg(F.count("*").alias("teams_without_page")))
