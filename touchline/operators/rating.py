"""The composite index: strength of schedule, dimensions in five contexts, shrinkage, scores, weights and ranks.

Everything stays long, (player, context, dimension), until the index is put
together, so one shuffle serves all contexts and one window all scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .measures import boost, clip, consistency, mean, per90, shrink, total
from .ordered import quantiles, recursive_mean, with_groups, with_means
from .windows import rank_average, robust_scores, robust_z, top_n


@dataclass(frozen=True)
class Rules:
    """Constants of the index."""

    least_games: int = 4
    prior_minutes: float = 600.0
    top: int = 6
    k_base: float = 12.0
    k_winter: float = 1.8
    k_most: float = 8.0
    default_prior: float = 0.15
    boost_least: int = 6
    boost_prior: float = 8.0
    confidence_floor: float = 0.35
    role_weights: dict = field(default_factory=lambda: {"FWD": 1.0, "MID": 0.85, "DEF": 0.55, "GK": 0.20})
    # fixed values: weights of the dimensions
    weights: dict = field(default_factory=lambda: {"output": 0.32, "buildup": 0.10, "centrality": 0.18, "boost": 0.05, "consistency": 0.07, "finishing": 0.20, "form": 0.11})
    # fixed values: weights of the index and its five modulators, by age
    pro_weights: dict = field(
        default_factory=lambda: {
            "young": {"index": 0.55, "age": 0.15, "reliability": 0.05, "stability": 0.07, "trend": 0.05, "momentum": 0.13},
            "prime": {"index": 0.65, "age": 0.10, "reliability": 0.07, "stability": 0.07, "trend": 0.05, "momentum": 0.06},
            "veteran": {"index": 0.60, "age": 0.04, "reliability": 0.18, "stability": 0.08, "trend": 0.05, "momentum": 0.05},
        }
    )
    prime_from: float = 23.0
    veteran_from: float = 29.0
    age_peak: float = 23.0


RULES = Rules()


def strength_of_schedule(facts: DataFrame, team: str = "opp", value: str = "xg") -> DataFrame:
    """(team, sos): what each team concedes on average, over the mean of all teams; 1 where that is not defined."""
    means = facts.groupBy(F.col(team).alias("team")).agg(mean(value).alias("m"))
    level = means.agg(F.round(F.avg("m"), 12).alias("level"))
    return means.join(level).select("team", F.coalesce(F.try_divide("m", "level"), F.lit(1.0)).alias("sos"))


def standings(facts: DataFrame, points: str = "goal") -> DataFrame:
    """(team, points, place): teams by points, of equals the lower key first."""
    t = facts.groupBy("team").agg(F.sum(points).alias("points"))
    # one row a team: the window's single partition is as small as the league
    return t.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("points").desc(), "team")).cast("long"))


def tight_ranks(sos: DataFrame, n: int) -> DataFrame:
    """(team, place): the n + 1 teams that concede least, enough for everybody to leave its own out."""
    best = sos.orderBy("sos", "team").limit(n + 1)
    # at most n + 1 rows
    return best.select("team", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("sos", "team")).alias("place"))


def contexts(rows: DataFrame, strong: DataFrame, tight: DataFrame, top: int = RULES.top) -> DataFrame:
    """rows once for each context they belong to: total, home, away, against strong and against tight teams.

    `strong` is a set that the own team is taken out of; `tight` is ranked, one
    longer than needed, and a team's own set are the first `top` without itself.
    """
    s = strong.select(F.col("team").alias("opp"), F.lit(True).alias("_strong"))
    t = tight.select(F.col("team").alias("opp"), F.col("place").alias("_place"))
    own = tight.select("team", F.col("place").alias("_own"))
    faced = rows.join(s, "opp", "left").join(t, "opp", "left").join(own, "team", "left")
    other = F.col("opp") != F.col("team")
    ahead = F.col("_place") - F.coalesce((F.col("_own") < F.col("_place")).cast("int"), F.lit(0))
    names = F.array_compact(F.array(F.lit("total"), F.col("venue"), F.when(F.col("_strong") & other, "vs_strong"), F.when((ahead <= top) & other, "vs_tight")))
    return faced.withColumn("ctx", F.explode(names)).drop("_strong", "_place", "_own")


def dimensions(rows: DataFrame, sos: DataFrame, rules: Rules = RULES) -> DataFrame:
    """output, output_adj, consistency, finishing, goals and minutes for each (player, role, ctx) with enough games."""
    faced = rows.join(sos.withColumnRenamed("team", "opp"), "opp", "left").withColumn("sos", F.coalesce("sos", F.lit(1.0)))
    value = (F.col("xg") + F.col("xa")).cast("double") * 90 / F.col("mins")
    found = faced.filter("mins > 0").groupBy("player", "role", "ctx").agg(
        F.count("*").alias("n"),
        F.sum("mins").alias("mins"),
        per90(F.col("xg") + F.col("xa"), "mins").alias("output"),
        F.avg("sos").alias("sos"),
        consistency(value).alias("consistency"),
        total("xg").alias("xg"),
        F.sum("goal").alias("goals"),
    )
    found = found.filter(F.col("n") >= rules.least_games)
    return found.withColumn("output_adj", F.col("output") / F.col("sos")).withColumn("finishing", F.when(F.col("xg") > 0, (F.col("goals") - F.col("xg")) / F.sqrt("xg")))


def minutes_shrinkage(rows: DataFrame, value: str, out: str, rules: Rules = RULES) -> DataFrame:
    """Draws a value towards the mean of its (role, ctx), the more the fewer minutes and games stand behind it."""
    per_game = clip(F.coalesce(F.col("mins") / F.col("n"), F.lit(45.0)), 30, 90)
    strength = clip(clip(75 / per_game, 1, 2.5) * clip(30 / F.coalesce(F.col("n"), F.lit(8)), 1, 3), 1, 3) * rules.prior_minutes
    return with_means(rows, ["role", "ctx"], {"_prior": value}).withColumn(out, shrink(F.col(value), F.col("mins").cast("double"), F.col("_prior"), strength)).drop("_prior")


def scores(rows: DataFrame, values: list[str], scope: tuple = ()) -> DataFrame:
    """(scope..., player, role, ctx, metric, z): robust scores of all metrics at once; thin contexts are scored by the whole season's peers."""
    long = rows.unpivot([*scope, "player", "role", "ctx"], values, "metric", "value")
    return robust_z(long, "value", [*scope, "ctx", "role", "metric"], "z", fallback=("ctx", "total")).drop("value")


def composite(z: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that are there."""
    top = reduce(Column.__add__, [F.coalesce(z[k], F.lit(0.0)) * w for k, w in weights.items() if k in z])
    low = reduce(Column.__add__, [F.when(z[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items() if k in z])
    return F.try_divide(top, low)


def confidence(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Fourth root of the product of minutes, games, minutes a game, and the share of dimensions."""
    level = quantiles(rows, [], "mins", [0.95]).select(F.col("q")[0].alias("_p95"))
    have = reduce(Column.__add__, [F.col(d).isNotNull().cast("double") for d in dims]) / len(dims)
    parts = clip(F.col("mins") / F.col("_p95"), 0, 1) * clip(F.col("n") / 30.0, 0.3, 1) * clip(F.col("mins") / F.col("n") / 90.0, 0.4, 1) * have
    return rows.join(level).withColumn("confidence", F.round(F.pow(parts, 0.25), 3)).drop("_p95")


def role_weighted(value: Column, peers_mean: Column, trust: Column, role: Column, rules: Rules = RULES) -> Column:
    """Drawn to the role's mean where trust is low, then by the role's weight."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.role_weights.items() for x in kv]), role), F.lit(0.5))
    return weight * (peers_mean + (rules.confidence_floor + (1 - rules.confidence_floor) * trust) * (value - peers_mean))


def availability_penalty(played: Column, available: Column) -> Column:
    share = clip(F.coalesce(F.try_divide(played, available), F.lit(1.0)), 0, 1)
    return (clip(share, 0.3, 0.7) - 0.3) / 0.4 * 0.15 + 0.85


def prospect(index: Column, by_age: Column, age: Column) -> Column:
    """The index times the age index, or a bell around 27 years where that is missing; null without an index."""
    return F.when(index != 0, index * F.coalesce(by_age, F.exp(-0.5 * F.pow((age - 27) / 4.5, 2))))


def fine_role(minutes: DataFrame, forward: int, behind: int, second: int, least: float = 0.25) -> DataFrame:
    """(player, box, share) of (player, box, m) rows: the box with most minutes, of equals the first.

    A forward with at least such a share of minutes behind the attack is a second
    forward, and both shares count.
    """
    whole = Window.partitionBy("player")
    back = F.coalesce(F.max(F.when(F.col("box") == behind, F.col("m"))).over(whole), F.lit(0))
    q = minutes.withColumn("total", F.sum("m").over(whole)).withColumn("_back", back)
    q = top_n(q, ["player"], [F.col("m").desc(), F.col("box")], 1)
    both = (F.col("box") == forward) & (F.col("_back") >= least * F.col("total"))
    return q.select("player", F.when(both, second).otherwise(F.col("box")).alias("box"), ((F.col("m") + F.when(both, F.col("_back")).otherwise(0)) / F.col("total")).alias("share"))


def role_by_precedence(override: Column, seen: Column, mins: Column, registry: Column, least: int) -> Column:
    """An override, else what was seen over enough minutes, else for a blank registry what was seen at all, else the registry's."""
    return F.coalesce(override, F.when(mins >= least, seen), F.when(registry.isNull() & (mins >= 1), seen), registry)


def age_index(age: Column, peak: float = 23.0, width: float = 3.5) -> Column:
    """Peak, youth and freshness; null outside 15 to 45."""
    bell = F.exp(-0.5 * F.pow((age - peak) / width, 2))
    fresh = F.when(age <= 27, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (age - 27) * 0.06))
    return F.when(age.between(15, 45), 0.55 * bell + 0.25 * clip((23 - age) / 5, 0, 1) + 0.20 * fresh)


def reliability(played: Column, available: Column, injuries: Column, days: Column) -> Column:
    """Null where fewer than eight matches were available."""
    value = 0.5 * F.least(F.lit(1.0), played / available) + 0.3 * F.greatest(F.lit(0.0), 1 - F.least(injuries, F.lit(6)) * 0.15) + 0.2 * F.greatest(F.lit(0.0), 1 - days / 90)
    return F.when(available >= 8, value)


def form(facts: DataFrame, keys: list[str], alpha: float = 0.3, least: int = 5) -> DataFrame:
    """(player, ewma, trend): recursive mean of the rate in match order, and its distance to the plain mean."""
    value = ((F.col("xg") + F.col("xa")).cast("double") * 90 / F.col("mins"))
    rows = facts.filter("mins > 0").select("player", *keys, value.alias("_v"))
    series = recursive_mean(rows, ["player"], [F.col(k) for k in keys], "_v", "_s", alpha).groupBy("player").agg(F.max_by("_s", "pos").alias("ewma"), F.avg("_v").alias("_mean"), F.count("*").alias("_n"))
    return series.select("player", "ewma", F.when(F.col("_n") >= least, F.try_divide("ewma", "_mean") - 1).alias("trend"))


def team_log(matches: DataFrame) -> DataFrame:
    """(team, fixture, rnd, opp, venue, team_xg): one row for each side of a fixture."""
    return matches.groupBy("team", "fixture", "rnd", "opp", "venue").agg(F.sum("xg").alias("team_xg"))


def context_dimensions(matches: DataFrame, rules: Rules = RULES) -> DataFrame:
    """player, role, ctx with n, mins, output, buildup, centrality, boost and consistency of each context with enough games.

    matches: one row a player and fixture. What a team did without a player is
    the team's total less what it did with the player, so no pair of player and
    missed fixture is ever made.
    """
    log = team_log(matches)
    conceded = strength_of_schedule(log, "opp", "team_xg")
    tight, strong = tight_ranks(conceded, rules.top), standings(matches).filter(F.col("place") <= rules.top)
    sos = conceded.withColumnRenamed("team", "opp")
    weight = F.coalesce(F.least(F.try_divide(F.lit(1.0), F.col("sos")), F.lit(10.0)), F.lit(1.0))
    faced = contexts(log, strong, tight, rules.top).join(sos, "opp", "left").withColumn("sos", F.coalesce("sos", F.lit(1.0)))
    faced = faced.withColumn("w", weight).withColumn("wx", F.col("w") * F.col("team_xg"))
    teams = faced.groupBy("team", "ctx").agg(F.count("*").alias("team_n"), F.sum("w").alias("team_w"), F.sum("wx").alias("team_wx"))
    rows = matches.join(faced.select("team", "fixture", "ctx", "team_xg", "sos", "w", "wx"), ["team", "fixture"])
    value = (F.col("xg") + F.col("xa")).cast("double") * 90 / F.col("mins")
    found = rows.groupBy("player", "team", "role", "ctx").agg(
        F.count("*").alias("n"), F.sum("mins").alias("mins"), total(F.col("xg") + F.col("xa")).alias("own"), total("bu").alias("bu"), total("team_xg").alias("team_xg"),
        F.avg("sos").alias("sos"), F.sum("w").alias("w"), F.sum("wx").alias("wx"), consistency(value).alias("consistency"),
    )
    whole = matches.groupBy("player").agg(F.count("*").alias("games"), F.sum("mins").alias("season_mins"), (F.min("rnd") >= 2).alias("winter"))
    return dimensions_of(found, whole, teams, rules)


def dimensions_of(found: DataFrame, whole: DataFrame, teams: DataFrame, rules: Rules = RULES, scope: tuple = ()) -> DataFrame:
    """The five dimensions from the sums of players, of players' seasons and of teams, in each scope.

    found: (scope..., player, team, role, ctx) with n, mins, own, bu, team_xg, sos, w, wx and consistency; whole: (scope...,
    player) with games, season_mins and winter; teams: (scope..., team, ctx) with team_n, team_w and team_wx.
    """
    found = found.filter(F.col("n") >= rules.least_games).join(whole, [*scope, "player"]).join(teams, [*scope, "team", "ctx"])
    missed = F.col("team_n") - F.col("n")
    left = F.col("team_wx") - F.col("wx")
    left = F.when(F.abs(left) >= 1e-9, left).otherwise(0.0)  # nothing but rounding is left where the team had nothing without the player
    with_, without = F.col("wx") / F.col("w"), F.try_divide(left, F.when(missed > 0, F.col("team_w") - F.col("w")))
    k = rules.k_base * F.when(F.col("winter"), rules.k_winter).otherwise(1.0) * F.least(F.col("games") / F.col("n"), F.lit(rules.k_most))
    front = F.col("role").isin("FWD", "MID")
    priors = found.groupBy(*scope, "ctx").agg(F.coalesce(F.try_divide(F.sum(F.when(front, F.col("own"))), F.sum(F.when(front, F.col("team_xg")))), F.lit(rules.default_prior)).alias("prior"))
    found = found.join(priors, [*scope, "ctx"])
    return found.select(
        *scope, "player", "role", "ctx", "n", "mins", "games", "season_mins", "winter",
        (F.col("own") / F.col("mins") * 90 / F.col("sos")).alias("output"),
        (F.col("bu") / F.col("mins") * 90 / F.col("sos")).alias("buildup"),
        F.when(F.col("team_xg") > 0, (F.col("own") + F.col("prior") * k) / (F.col("team_xg") + k) * 100).alias("centrality"),
        boost(with_, without, missed, rules.boost_least, rules.boost_prior).alias("boost"),
        "consistency",
    )


def season_skills(matches: DataFrame, rules: Rules = RULES) -> DataFrame:
    """player with finishing, form (the recursive mean of its rate) and trend, over the whole season."""
    finishing = matches.groupBy("player").agg(total("xg").alias("_xg"), F.sum("goal").alias("_g"))
    finishing = finishing.select("player", F.when(F.col("_xg") > 0, (F.col("_g") - F.col("_xg")) / F.sqrt("_xg")).alias("finishing"))
    return finishing.join(form(matches, ["rnd", "fixture"]).select("player", F.col("ewma").alias("form"), "trend"), "player", "left")


DIMENSIONS = ("output", "buildup", "centrality", "boost", "consistency")


def context_scores(dims: DataFrame, rules: Rules = RULES, scope: tuple = ()) -> DataFrame:
    """scope, player, role, ctx and the scores of the five dimensions of a context, after the minutes' shrinkage."""
    per_game = clip(F.col("season_mins") / F.col("games"), 30, 90)
    strength = clip(F.greatest(clip(75 / per_game, 1, 2.5), clip(30 / F.col("games"), 1, 3)), 1, 3) * rules.prior_minutes
    dims = with_means(cut(dims), [*scope, "role", "ctx"], {"_output": "output", "_buildup": "buildup"})
    for name in ("output", "buildup"):
        dims = dims.withColumn(name, shrink(F.col(name), F.col("mins").cast("double"), F.col(f"_{name}"), strength)).drop(f"_{name}")
    dims = cut(dims)
    return robust_scores(dims, list(DIMENSIONS), [*scope, "role"], ("ctx", "total")).select(*scope, "player", "role", "ctx", *DIMENSIONS)


def prepared(matches: DataFrame, bodies: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row for each player with enough games: season figures, skills, availability, age index and reliability."""
    whole = matches.groupBy("player", "role").agg(F.count("*").alias("games"), F.sum("mins").alias("season_mins"), F.min("rnd").alias("first"), F.countDistinct("rnd").alias("played"))
    return available(whole.join(season_skills(matches, rules), "player"), matches.agg(F.countDistinct("rnd").alias("rounds")), bodies, rules)


def available(whole: DataFrame, rounds: DataFrame, bodies: DataFrame, rules: Rules = RULES, scope: tuple = ()) -> DataFrame:
    """whole, of players with enough games, beside the rounds they could have played, their age index and reliability."""
    whole = with_groups(whole.filter(F.col("games") >= rules.least_games).join(bodies, "player", "left"), rounds, list(scope))
    whole = whole.withColumn("available", F.when(F.col("first") >= 2, F.col("rounds") - F.col("first") + 1).otherwise(F.col("rounds")))
    return whole.withColumn("age_index", age_index(F.col("age"))).withColumn("reliability", reliability(F.col("played"), F.col("available"), F.col("injuries"), F.col("days")))


def raw_scores(z: DataFrame, whole: DataFrame, rules: Rules = RULES, scope: tuple = ()) -> DataFrame:
    """The scores of contexts beside those of the season, and their weighted mean `raw`."""
    names = ["finishing", "form", "trend", "age_index", "reliability"]
    skills = robust_scores(whole, names, [*scope, "role"]).select(*scope, "player", *names)
    return z.join(skills, [*scope, "player"]).withColumn("raw", composite({d: F.col(d) for d in (*DIMENSIONS, "finishing", "form")}, rules.weights))


def scored(matches: DataFrame, bodies: DataFrame, rules: Rules = RULES) -> DataFrame:
    """player, role, ctx with raw_ and pro_: the index and the index with its modulators, weighted, shrunk and penalised."""
    from .vintages import season_vintages

    return season_vintages(matches, bodies, None, [], rules, contexts=True).drop("as_of")


def scored_from(dims: DataFrame, whole: DataFrame, rules: Rules = RULES, scope: tuple = ()) -> DataFrame:
    """scored, from the dimensions of contexts and the seasons of players, in each scope on its own."""
    person_keys, whole = [*scope, "player"], cut(whole)
    rows = cut(raw_scores(context_scores(dims, rules, scope), whole, rules, scope))
    have = reduce(Column.__add__, [F.col(d).isNotNull().cast("double") for d in DIMENSIONS]) / len(DIMENSIONS)
    level = quantiles(whole, list(scope), "season_mins", [0.95]).select(*scope, F.col("q")[0].alias("p95"))
    total_ = rows.filter("ctx = 'total'").select(*person_keys, "role", F.col("raw").alias("total_raw"), have.alias("have"))
    person = total_.join(whole.select(*person_keys, "games", "season_mins", "played", "available", "age"), person_keys).join(stability(rows, scope), person_keys)
    person = with_groups(person, level, list(scope))
    trust = clip(F.col("season_mins") / F.col("p95"), 0, 1) * clip(F.col("games") / 30.0, 0.3, 1) * clip(F.col("season_mins") / F.col("games") / 90.0, 0.4, 1) * F.col("have")
    person = cut(person.withColumn("confidence", F.round(F.pow(trust, 0.25), 3)))
    fit = F.when(F.col("age") <= rules.age_peak + 5, F.col("total_raw"))
    line = person.groupBy(*scope).agg(F.regr_slope(fit, F.col("age")).alias("b"), F.regr_intercept(fit, F.col("age")).alias("c"), F.count(fit).alias("fitted"))
    momentum = F.when((F.col("fitted") >= 8) & (F.col("age") < rules.age_peak + 1), F.col("total_raw") - (F.col("b") * F.col("age") + F.col("c")))
    person = cut(with_groups(person, line, list(scope)).withColumn("momentum", momentum))
    names = ["stability", "momentum"]
    modest = robust_scores(person, names, [*scope, "role"]).select(*person_keys, *names)
    rows = rows.join(person.select(*person_keys, "games", "season_mins", "confidence", "played", "available", "age"), person_keys).join(modest, person_keys, "left")
    kind = F.when(F.col("age") < rules.prime_from, "young").when(F.col("age") >= rules.veteran_from, "veteran").otherwise("prime")
    parts = {"index": F.col("raw"), "age": F.col("age_index"), "reliability": F.col("reliability"), "stability": F.col("stability"), "trend": F.col("trend"), "momentum": F.col("momentum")}
    rows = rows.withColumn("pro", F.when(kind == "young", composite(parts, rules.pro_weights["young"])).when(kind == "veteran", composite(parts, rules.pro_weights["veteran"])).otherwise(composite(parts, rules.pro_weights["prime"])))
    return finished(finished(cut(rows), "raw", [*scope, "role", "ctx"], rules), "pro", [*scope, "role", "ctx"], rules)


def signed_round(value: Column, digits: int) -> Column:
    """value rounded as SQL does: by its product with a power of ten, halves away from zero; what is rounded to zero keeps its sign.

    F.round goes by the shortest decimal that tells a double, which is a half in other cases than that product.
    """
    scale = F.lit(10.0**digits)
    rounded = F.round(value * scale) / scale
    return F.when(rounded == 0, value * F.lit(0.0)).otherwise(rounded)


def finished(rows: DataFrame, name: str, peers: list[str], rules: Rules = RULES) -> DataFrame:
    """rows with `<name>_`: drawn to the peers' mean by confidence, weighted by role, and less by missed games."""
    drawn = role_weighted(F.col(name), F.col("_peers"), F.col("confidence"), F.col("role"), rules)
    return with_means(rows, peers, {"_peers": name}).withColumn("_drawn", drawn).withColumn(f"{name}_", signed_round(signed_round(F.col("_drawn"), 4) * availability_penalty(F.col("played"), F.col("available")), 4)).drop("_peers", "_drawn")


def season_index(matches: DataFrame, bodies: DataFrame, rules: Rules = RULES) -> DataFrame:
    """player, role, n, mins, confidence, the index of five contexts, pro, and both ranks, of a season or its rounds up to one.

    matches: one row a player and fixture; bodies: (player, age, injuries, days).
    """
    return index_of(scored(matches, bodies, rules))


def index_of(rows: DataFrame, scope: tuple = ()) -> DataFrame:
    """What scored gives, one row a player and scope."""
    pick = lambda c, x: F.max(F.when(F.col("ctx") == x, F.col(c)))
    wide = rows.groupBy(*scope, "player", "role").agg(
        F.first("games").alias("n"), F.first("season_mins").alias("mins"), F.first("confidence").alias("confidence"),
        *[pick("raw_", x).alias("index" if x == "total" else f"index_{x}") for x in ("total", "home", "away", "vs_strong", "vs_tight")], pick("pro_", "total").alias("pro"),
    )
    return rank_average(rank_average(wide, "index", list(scope), "rank"), "pro", list(scope), "pro_rank")


def stability(rows: DataFrame, scope: tuple = ()) -> DataFrame:
    """(scope..., player, stability): less the deviation of its contexts' scores."""
    return rows.groupBy(*scope, "player").agg((-F.stddev_samp("raw")).alias("stability"))


def context_spread(matches: DataFrame, rules: Rules = RULES) -> DataFrame:
    matches = cut(matches)
    bare = matches.select("player").distinct().select("player", F.lit(None).cast("double").alias("age"), F.lit(0).alias("injuries"), F.lit(0).alias("days"))
    return stability(raw_scores(context_scores(context_dimensions(matches, rules), rules), cut(prepared(matches, bare, rules)), rules))


def key_figures(matches: DataFrame) -> DataFrame:
    """player, xa90, sos, and the team's mean output in fixtures with the player and without."""
    log = team_log(matches)
    sos = strength_of_schedule(log, "opp", "team_xg").withColumnRenamed("team", "opp")
    rows = matches.join(log.select("team", "fixture", "team_xg"), ["team", "fixture"]).join(sos, "opp", "left")
    own = rows.groupBy("player", "team").agg(per90("xa", "mins").alias("xa90"), F.avg(F.coalesce("sos", F.lit(1.0))).alias("sos"), F.count("*").alias("n"), total("team_xg").alias("x"))
    every = log.groupBy("team").agg(F.count("*").alias("team_n"), total("team_xg").alias("team_x"))
    return own.join(every, "team").select("player", "xa90", "sos", (F.col("x") / F.col("n")).alias("team_with"), F.try_divide(F.col("team_x") - F.col("x"), F.nullif(F.col("team_n") - F.col("n"), F.lit(0))).alias("team_without"))


def team_trend(matches: DataFrame, rules: Rules = RULES) -> DataFrame:
    """player, rnd and the team's mean output: with the player, against tight and weak teams, and without, on the union of rounds.

    Fixtures without the player are the round's total less those with it.
    """
    log = team_log(matches)
    sos = strength_of_schedule(log, "opp", "team_xg")
    turned = sos.select("team", (-F.col("sos")).alias("sos"))
    tight, weak = (contexts(log.withColumn("venue", F.lit(None).cast("string")), sos.select("team").limit(0), tight_ranks(x, rules.top), rules.top).filter("ctx = 'vs_tight'").select("team", "fixture", F.lit(True).alias(n)) for x, n in ((sos, "tight"), (turned, "weak")))
    # sums stay decimals until they are divided, so that they do not depend on their order
    faced = log.join(tight, ["team", "fixture"], "left").join(weak, ["team", "fixture"], "left").withColumn("x", F.col("team_xg"))
    rows = matches.select("player", "team", "fixture").join(faced, ["team", "fixture"])
    average = lambda c: F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
    own = rows.groupBy("player", "team", "rnd").agg(average(F.col("x")).alias("team_with"), average(F.when(F.col("tight"), F.col("x"))).alias("tight"), average(F.when(F.col("weak"), F.col("x"))).alias("weak"), F.sum("team_xg").alias("s"), F.count("*").alias("n"))
    every = log.groupBy("team", "rnd").agg(F.sum("team_xg").alias("team_s"), F.count("*").alias("team_n"))
    axis = matches.select("player", "team").distinct().join(every, "team")
    both = axis.join(own, ["player", "team", "rnd"], "left")
    left = F.col("team_n") - F.coalesce("n", F.lit(0))
    exact = lambda c: F.col(c).cast("decimal(28,7)")  # noqa: E731  the widest decimals lose a digit where they are subtracted
    missed = F.when(left > 0, (exact("team_s") - F.coalesce(exact("s"), F.lit(0).cast("decimal(28,7)"))).cast("double") / left)
    return both.select("player", "rnd", "team_with", "tight", "weak", missed.alias("team_without"))
