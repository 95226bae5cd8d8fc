import math
import statistics

import pytest
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import joins as J
from touchline.operators import measures as M
from touchline.operators import platform as P
from touchline.operators import quality as Q
from touchline.operators import rating as R
from touchline.operators import serving as V
from touchline.operators import statistics as S
from touchline.operators import windows as W
from touchline.sources import sinks


def one(df):
    return [tuple(r) for r in df.collect()]


def test_average_rank_truncates_ties_and_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, 9.0, 0), (2, 7.0, 0), (3, 7.0, 0), (4, 7.0, 0), (5, 2.0, 0), (6, 2.0, 0), (7, None, 0)], "k int, v double, g int")
    got = dict(one(W.rank_average(df, "v", ["g"], "rank").select("k", "rank")))
    assert got == {1: 1, 2: 3, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    exact = dict(one(W.rank_average(df, "v", ["g"], "rank", floor=False).select("k", "rank")))
    assert exact[5] == 5.5
    assert dict(one(W.rank_average(df, "v", [], "rank").select("k", "rank"))) == got
    assert W.rank_average(df.limit(0), "v", [], "rank").collect() == []
    many = spark.range(3000).select("id", ((F.col("id") * 7919) % 1000).alias("v"), F.lit(0).alias("g"))
    whole, parts = (sorted(one(W.rank_average(many, "v", by, "rank").select("id", "rank"))) for by in ([], ["g"]))
    assert whole == parts


def test_spearman_against_pearson_of_ranks(spark):
    rows = [(i, float((i * 7) % 11), float((i * 5) % 13)) for i in range(11)]
    df = spark.createDataFrame(rows, "k int, x double, y double").withColumn("g", F.lit(1))
    rho = W.spearman(df, "x", "y", ["g"]).first()["rho"]
    rank = lambda v: [sorted(v).index(x) for x in v]
    assert rho == pytest.approx(statistics.correlation(rank([r[1] for r in rows]), rank([r[2] for r in rows])))


def test_ewma_and_series(spark):
    df = spark.createDataFrame([(1, [4.0, 8.0, 2.0]), (2, [5.0]), (3, [])], "k int, v array<double>")
    got = {r.k: r.e for r in df.select("k", W.ewma(F.col("v")).alias("e")).collect()}
    a = 0.3 * 8 + 0.7 * 4
    b = 0.3 * 2 + 0.7 * a
    assert got == {1: pytest.approx(b), 2: 5.0, 3: None}
    rows = spark.createDataFrame([(1, 1, 4.0), (1, 2, 8.0), (1, 3, 2.0), (2, 1, 5.0)], "k int, at int, v double")
    series = {(r.k, r.pos): r.e for r in W.ewma_series(rows, ["k"], ["at"], "v", "e").collect()}
    assert series == {(1, 0): 4.0, (1, 1): pytest.approx(a), (1, 2): pytest.approx(b), (2, 0): 5.0}
    long = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("at"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    mean = 0.0
    for i in range(400):
        mean = float(i * 37 % 101) if i == 0 else 0.3 * (i * 37 % 101) + 0.7 * mean
    assert W.ewma_series(long, ["k"], ["at"], "v", "e").filter("pos = 399").first().e == pytest.approx(mean, rel=1e-12)


def test_robust_z_bounds_constants_and_small_groups(spark):
    rows = [("a", float(v)) for v in [*range(20), 1000]] + [("b", 1.0), ("b", 2.0)] + [("c", 5.0)] * 4 + [("a", None)]
    df = W.robust_z(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], "z")
    got = {(r.g, r.v): r.z for r in df.collect()}
    assert got["a", 1000.0] == 3.0 and got["a", None] is None
    assert got["b", 1.0] is None and got["c", 5.0] == 0.0


def test_measures(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0), (1, 20.0, 0.0), (2, 4.0, None), (3, None, 1.0)], "k int, v double, w double")
    got = dict(one(df.groupBy("k").agg(M.weighted_mean(F.col("v"), F.col("w")))))
    assert got == {1: 10.0, 2: 4.0, 3: None}
    b = df.select(M.boost(F.lit(4.0), F.lit(2.0), F.lit(8)).alias("a"), M.boost(F.lit(4.0), F.lit(2.0), F.lit(5)).alias("b")).first()
    assert b.a == pytest.approx(math.exp(math.log(2) / 2)) and b.b is None
    steady = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]], "v double").agg(M.consistency("v")).first()[0]
    assert steady == pytest.approx(3.5 / (3.5 + statistics.stdev(range(1, 7))))


def test_contexts_leave_the_own_team_out(spark):
    facts = spark.createDataFrame([(1, 1, 2, "home"), (1, 1, 3, "away"), (2, 2, 2, "home")], "player int, team int, opp int, venue string")
    strong = spark.createDataFrame([(2,)], "team int")
    tight = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "team int, place int")  # two are wanted, so one more is ranked
    got = sorted(one(R.contexts(facts, strong, tight, top=2).select("player", "opp", "ctx")))
    assert (1, 2, "vs_strong") in got and (2, 2, "vs_strong") not in got and (2, 2, "vs_tight") not in got
    assert (1, 2, "vs_tight") in got and (1, 3, "vs_tight") in got  # team 1 is tight itself and still faces two
    more = spark.createDataFrame([(4, 7, 3, "home"), (4, 7, 2, "home")], "player int, team int, opp int, venue string")
    assert {(o, c) for _, o, c in one(R.contexts(more, strong, tight, top=2).select("player", "opp", "ctx")) if c == "vs_tight"} == {(2, "vs_tight")}
    assert sum(c == "total" for *_, c in got) == 3


def test_composite_renormalises(spark):
    row = spark.createDataFrame([(1.0, None)], "a double, b double").select(R.composite({"a": F.col("a"), "b": F.col("b")}, {"a": 0.3, "b": 0.7})).first()
    assert row[0] == 1.0


def test_personal_top_drops_the_team_itself(spark):
    rivals = spark.createDataFrame([(k, float(k)) for k in range(10)], "rival int, v double")
    got = one(J.personal_top(spark.createDataFrame([(2,), (9,)], "team int"), rivals, 3))
    assert sorted(got) == [(2, 0, 1), (2, 1, 2), (2, 3, 3), (9, 0, 1), (9, 1, 2), (9, 2, 3)]


def test_one_to_one_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    with pytest.raises(Exception, match="repeat"):
        J.one_to_one(a, b, ["k"]).collect()


def test_upsert_and_reconcile(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(one(J.upsert(base, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"]))) == [(1, "a"), (2, "B"), (3, "c")]
    left = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5)], "o int, i int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "o int, i int")
    assert sorted(one(J.reconcile(left, right, "o", "i"))) == [(1, 1, 1, 1), (2, 1, 0, 0)]


def test_homonym_repair_needs_all_signs(spark):
    source = spark.createDataFrame([(1, 10, 90), (2, 11, 45), (2, 13, 20), (4, 12, 30)], "player int, fixture int, mins int")
    schema = "player int, fixture int, mins int, goals int, xg double, xa double"
    true = [(1, 10, 90, 1, 0.5, 0.1), (2, 11, 45, 0, 0.2, 0.0), (2, 13, 20, 0, 0.1, 0.1), (4, 12, 30, 1, 0.3, 0.0)]
    kept, refused = Q.remove_homonym_rows(spark.createDataFrame([*true, (1, 11, 45, 0, 0.2, 0.0)], schema), source)
    assert sorted(one(kept)) == sorted(true) and one(refused) == []
    # equal minutes alone are not enough: goals differ
    other = [*true, (1, 11, 45, 2, 0.2, 0.0)]
    kept, refused = Q.remove_homonym_rows(spark.createDataFrame(other, schema), source)
    assert sorted(one(kept)) == sorted(other)
    # one row is explained and one is not: the player is left alone
    mixed = [*true, (1, 11, 45, 0, 0.2, 0.0), (1, 14, 12, 0, 0.0, 0.0)]
    kept, refused = Q.remove_homonym_rows(spark.createDataFrame(mixed, schema), source)
    assert sorted(one(kept)) == sorted(mixed) and one(refused) == [(1, 1)]


def test_import_only_where_it_comes_out_exactly(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (2, 99), (3, 10)], "player int, fixture int")
    source = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 1, 0.9), (2, 10, 0, 0.0), (2, 11, 0, 0.1), (3, 10, 0, 0.1), (3, 55, 0, 0.2), (4, 10, 0, 0.1)], "player int, fixture int, goals int, xg double")
    penalties = spark.createDataFrame([(1, 11, 2, 0.76)], "player int, fixture int, pen_goals int, pen_xg double")
    calendar = spark.createDataFrame([(10,), (11,)], "fixture int")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c")], "player int, name string")
    added, refused = Q.import_missing(rows, source, names, penalties, calendar)
    assert one(added) == [(1, 11, 1, 0.9, 0, 0.14)]  # player 4 has no games here, so its name is not split
    assert sorted(one(refused)) == [(2, "more games than the source"), (3, "outside the calendar")]
    split = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "player int, name string")
    assert one(Q.import_missing(rows, source, split, penalties, calendar)[0]) == []


def test_orphan_repair_only_where_the_rest_fits(spark):
    source = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "o int, i int")
    rows = spark.createDataFrame([(1, 10), (1, 99), (2, 20), (2, 98), (3, 30)], "o int, i int")
    assert sorted(one(Q.remove_orphan_games(rows, source, "o", "i"))) == [(1, 10), (2, 20), (2, 98), (3, 30)]


def test_split_identities(spark):
    games = spark.createDataFrame([(1, 10), (2, 11), (3, 20), (4, 20), (5, 30)], "id int, game int")
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "id int, name string")
    source = spark.createDataFrame([("a", 10), ("a", 11), ("b", 20), ("c", 30)], "name string, game int")
    assert one(Q.merge_split(games, names, source)) == [("a", 1, 2)]


def test_provider_merge_precedence_and_conflicts(spark):
    rows = [(1, "x", 10.0), (1, "y", 12.0), (2, "x", float("nan")), (2, "y", 5.0), (3, "x", float("inf")), (4, "y", 10.0), (4, "x", 10.9)]
    merged, conflicts = Q.provider_merge(spark.createDataFrame(rows, "k int, provider string, v double"), ["k"], ["v"], ["x", "y"])
    assert dict(one(merged)) == {1: 10.0, 2: 5.0, 4: 10.9}
    assert [(r.k, r.column) for r in conflicts.collect()] == [(1, "v")]


def test_entity_cascade(spark):
    registry = spark.createDataFrame([(1, "José", 1, 0), (2, "Ana", 1, 0), (3, "Ana", 2, 0), (9, "José", 1, 5)], "id int, name string, team int, at int")
    names = spark.createDataFrame([("jose", 1), ("JOSÉ", None), ("ana", 2), ("ana", None), ("jose", 4), ("who", 1)], "name string, team int")
    got = {(r.name, r.team): (r.id, r.status) for r in Q.resolve_entities(names, registry, T.fold_unicode).collect()}
    assert got["jose", 1] == (9, "OK") and got["ana", 2] == (3, "OK")
    assert got["JOSÉ", None] == (9, "OK") and got["ana", None] == (None, "AMBIGUOUS")
    assert got["jose", 4] == (None, "AMBIGUOUS") and got["who", 1] == (None, "NOT_FOUND")
    rows = {(r.name, r.team): r for r in Q.resolve_entities(names, registry, T.fold_unicode).collect()}
    assert rows["ana", None].candidates == [2, 3] and rows["who", 1].candidates == [] and rows["jose", 1].candidates is None
    spelled = Q.resolve_entities(spark.createDataFrame([("Ana", "inter  FC")], "name string, team string"), spark.createDataFrame([(5, "ana", "Intér FC", 0)], "id int, name string, team string, at int"), T.fold_unicode).first()
    assert (spelled.id, spelled.confidence) == (5, 0.95)


def test_findings_and_health(spark):
    df = spark.createDataFrame([(1, 5), (2, 500)], "k int, v int")
    assert dict(one(Q.out_of_range(df, {"v": ("v", 0, 100)}))) == {"v": 1}
    found = Q.report([Q.finding(df.filter("v > 100"), "V", "critical"), Q.finding(df.filter("v < 0"), "W", "high")])
    assert one(found) == [("V", "critical", 1)]
    assert one(Q.health(found, {"critical": 20, "high": 5})) == [(80,)]


def test_closure_with_a_cycle_and_a_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (8, 9)], "a long, b long")
    got = one(P.closure(edges, spark.createDataFrame([(1,)], "node long")))
    assert sorted(got) == [(1,), (2,), (3,), (4,)]


def test_complete_rounds(spark):
    rows = [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False)]
    df = spark.createDataFrame(rows, "team string, at int, played boolean")
    assert one(P.complete_rounds(df, "team", ["at"], "played")) == [(1,)]
    assert one(P.complete_rounds(df.withColumn("played", F.lit(True)), "team", ["at"], "played")) == [(2,)]
    assert one(P.complete_rounds(df.withColumn("played", F.lit(False)), "team", ["at"], "played")) == [(0,)]


def test_severity_and_trust(spark):
    row = spark.range(1).select(P.severity(F.lit(-4.5)), P.severity(F.lit(2.6)), P.severity(F.lit(1.0)), P.trust(F.lit(4.0)), P.trust(F.lit(2.5))).first()
    assert tuple(row) == ("critical", "warn", "info", 1.0, 0.5)


def test_forest_closures_of_a_chain_of_five_thousand(spark):
    parents = spark.range(1, 5000).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    start = lambda k: spark.createDataFrame([(k,)], "node long")
    assert {q.node for q in P.ancestors(parents, start(4000)).collect()} == set(range(4001))
    assert {q.node for q in P.descendants(parents, start(4000)).collect()} == set(range(4000, 5000))
    ring = spark.createDataFrame([(k, (k + 1) % 7) for k in range(7)] + [(9, 3), (11, None)], "node long, parent long")
    assert {q.node for q in P.ancestors(ring, start(9)).collect()} == {*range(7), 9}
    assert {q.node for q in P.descendants(ring, start(3)).collect()} == {*range(7), 9}
    with pytest.raises(ValueError):
        P.ancestors(spark.createDataFrame([(1, 2), (1, 3)], "node long, parent long"), start(1))


def test_closure_deeper_than_a_hundred_levels(spark):
    edges = spark.range(0, 130).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert P.closure(edges, spark.createDataFrame([(0,)], "node long")).count() == 131


def test_trios_respect_budget_and_roles(spark):
    pool = spark.createDataFrame([(1, "A", 9.0, 9.0), (2, "A", 8.0, 2.0), (3, "A", 7.0, 2.0), (4, "B", 3.0, 2.0), (5, "B", 1.0, 1.0)], "id int, role string, score double, cost double")
    best = V.pick(V.trios(pool, budget=6), [F.col("score").desc()]).first()
    assert (best.a, best.b, best.c, best.score) == (2, 3, 4, 18.0)


def equal_draw(*parts):
    import hashlib

    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:12], 16) / (1 << 48)


def pearson(w, x, y):
    n, sx, sy = sum(w), sum(a * b for a, b in zip(w, x)), sum(a * b for a, b in zip(w, y))
    sxx, syy, sxy = (sum(a * b * c for a, b, c in zip(w, p, q)) for p, q in ((x, x), (y, y), (x, y)))
    return (n * sxy - sx * sy) / math.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))


def quantile(values, q):
    v = sorted(values)
    at = q * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def test_bootstrap_against_equal_draws(spark):
    rows = [(i, float(i), float(i) + (i * 37 % 11), i % 10) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, x double, y double, c int")
    for key, column in (("k", 0), ("c", 3)):
        got = S.bootstrap_correlation(df.repartition(3), "x", "y", key, 60).first()
        draws = [pearson([sum(equal_draw(42, d, r[column]) >= e for e in S.POISSON) for r in rows], [r[1] for r in rows], [r[2] for r in rows]) for d in range(1, 61)]
        assert (got.n, got.draws) == (40, 60) and got.low < got.estimate < got.high
        assert (got.low, got.high) == pytest.approx((quantile(draws, 0.025), quantile(draws, 0.975)))
    few = S.bootstrap_correlation(df.limit(4), "x", "y", "k", 20).first()
    assert (few.n, few.low, few.high) == (4, None, None)


def test_permutation_against_equal_draws(spark):
    rows = [(i, i * 7 % 12 + 0.1 * i * i, (i * i % 13) * 0.37 + i ** 0.5) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = S.permutation(df, "x", "y", "k", 30).first()
    null = []
    for d in range(1, 31):
        x = [r[1] for r in sorted(rows, key=lambda r: (equal_draw(42, "x", d, r[0]), r[0]))]
        y = [r[2] for r in sorted(rows, key=lambda r: (equal_draw(42, "y", d, r[0]), r[0]))]
        null.append(pearson([1] * 12, x, y))
    seen = pearson([1] * 12, [r[1] for r in rows], [r[2] for r in rows])
    assert got.observed == pytest.approx(seen) and got.null_mean == pytest.approx(sum(null) / 30) and got.p == pytest.approx((sum(abs(r) >= abs(seen) for r in null) + 1) / 31)
    assert S.permutation(df.limit(7), "x", "y", "k", 5).first().p is None


def test_kendall_counts_pairs_without_making_them(spark):
    rng = [((i * 7919) % 23, (i * 104729) % 17, i) for i in range(60)]
    df = spark.createDataFrame([(i, float(a), float(b)) for a, b, i in rng], "k int, x double, y double")
    s = nx = ny = 0
    for i in range(60):
        for j in range(i):
            a, b = rng[i][0] - rng[j][0], rng[i][1] - rng[j][1]
            s += (a > 0) * (b > 0) + (a < 0) * (b < 0) - (a * b < 0)
            nx, ny = nx + (a != 0), ny + (b != 0)
    got = S.kendall(df, "x", "y", "k").first()
    assert (got.n, got.tau) == (60, pytest.approx(s / math.sqrt(nx * ny)))


def test_poisson_weights_have_mean_one(spark):
    mean, var = spark.range(20_000).withColumn("u", F.rand(5)).select(S.poisson_one(F.col("u")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05)


def test_quantile_bins_with_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 8 + [2.0, 3.0]], "v double")
    assert {r.v: r.bin for r in S.quantile_bins(df, "v", 5).collect()} == {1.0: 1, 2.0: 5, 3.0: 5}


def test_principal_components(spark):
    rows = [(float(i), 2.0 * i + (i % 3), float(i * i % 7)) for i in range(30)]
    explained, parts = S.principal_components(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 2)
    assert explained[0] > explained[1] and len(parts) == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ján​  O'Brien-Smith ", "É.  D'Or")], "a string, b string")
    row = df.select(T.fold_unicode("a").alias("u"), T.fold_latin(F.col("b")).alias("l"), T.slug(F.col("b")).alias("s"), T.without_double_surname(F.lit("Ana Silva Silva")).alias("d")).first()
    assert (row.u, row.l, row.s, row.d) == ("jan o'brien-smith", "e dor", "e-d-or", "Ana Silva")
    shown = spark.range(1).select(T.display_name(F.lit("Ana Silva"), F.lit("silva")), T.display_name(F.lit("Ana"), F.lit("Silva")), T.season_label(F.lit(1999))).first()
    assert tuple(shown) == ("Ana Silva", "Ana Silva", "1999-00")


def test_names_decompose_before_anything_else(spark):
    marked = "Müller Čech Şahin Łukasz"
    apart = "Mu\u0308ller C\u030cech S\u0327ahin Łukasz"
    df = spark.createDataFrame([(marked,), (apart,), ("ﬁn ½ Ǆ Ⅷ ㎏",), ("e\u0301\u00a0-\u200b x \t y ",), ("",), (None,)], "n string")
    n = F.col("n")
    got = [tuple(q) for q in df.select(T.slug(n), T.market_name(n), T.clean_name(n)).collect()]
    composed = "Müller Čech Şahin Łukasz"
    assert got[0] == ("muller-cech-sahin-ukasz", "muller cech sahin lukasz", composed) == got[1]
    assert got[2][0] == "fin-12-dz-viii-kg"
    assert got[3] == ("e-x-y", "e   x \t y", "é- x y")
    assert got[4] == ("", "", "") and got[5] == (None, None, None)


def test_ascii_parts_equal_decomposition(spark):
    import unicodedata

    texts = ["".join(chr(k) for k in range(a, a + 400) if not 0xD800 <= k < 0xE000) for a in range(0x80, 0x20000, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {q.k: q.a for q in df.select("k", T.to_ascii(F.col("t")).alias("a")).collect()}
    assert got == {k: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for k, t in enumerate(texts)}


def test_role_keys_and_reasons(spark):
    row = spark.createDataFrame([("  D&#39;Ámico &amp; S\u00f8n\u6f22 ", "a\tb\x07 C\u200bd\u0301")], "a string, b string").select(T.role_key("a").alias("k"), T.fold_audit("b").alias("f")).first()
    assert (row.k, row.f) == ("d'amico & sn", "a b cd")
    names = spark.createDataFrame([(1, "plain name"), (2, "no\u00a0break"), (3, " ends"), (4, "so\u00adft\u200b"), (5, "bell\x07"), (6, None)], "k int, n string")
    got = {r.k: r.i for r in names.select("k", T.invisible(F.col("n")).alias("i")).collect()}
    assert got == {1: [], 2: ["nbsp"], 3: ["space"], 4: ["shy", "zero-width"], 5: ["control"], 6: []}
    shown = spark.range(1).select(T.market_name(F.lit("Łukasz Søn Søn"))).first()[0]
    assert shown == "lukasz son"


def test_fine_roles_and_prospects(spark):
    rows = spark.createDataFrame([(1, 9, 70), (1, 7, 30), (2, 9, 80), (2, 7, 10), (2, 3, 10), (3, 4, 5), (3, 2, 5)], "player int, box int, m int")
    got = {r.player: (r.box, r.share) for r in R.fine_role(rows, 9, 7, 8).collect()}
    assert got == {1: (8, 1.0), 2: (9, 0.8), 3: (2, 0.5)}
    row = spark.range(1).select(R.prospect(F.lit(2.0), F.lit(0.5), F.lit(20.0)), R.prospect(F.lit(2.0), F.lit(None).cast("double"), F.lit(27.0)), R.prospect(F.lit(0.0), F.lit(0.5), F.lit(20.0))).first()
    assert tuple(row) == (1.0, 2.0, None)


def test_settings():
    from touchline.sources import settings

    given = settings.read("# gate\nrho:\n  warn: 0.97  # low\n  critical: 0.95\nstages: [a, b]\nname: 'x y'\non: true\nnone:\n")
    assert given == {"rho": {"warn": 0.97, "critical": 0.95}, "stages": ["a", "b"], "name": "x y", "on": True, "none": {}}
    assert settings.over({"rho": {"warn": 1, "critical": 2}, "k": 3}, {"rho": {"warn": 0}}) == {"rho": {"warn": 0, "critical": 2}, "k": 3}
    with pytest.raises(KeyError):
        settings.over({"a": 1}, {"b": 2})
    with pytest.raises(ValueError):
        settings.read("no name here")


def test_scores_fall_back_where_peers_are_few(spark):
    rows = [("total", float(v)) for v in range(20)] + [("home", 3.0), ("home", 8.0)]
    df = spark.createDataFrame(rows, "ctx string, v double").withColumn("role", F.lit("DEF"))
    got = {(r.ctx, r.v): r.z for r in W.robust_z(df, "v", ["ctx", "role"], "z", fallback=("ctx", "total")).collect()}
    assert got["home", 3.0] == pytest.approx(got["total", 3.0]) and got["home", 8.0] == pytest.approx(got["total", 8.0])


def test_components_of_the_scores_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0.3], [0, 0, 1]])
    explained, _ = S.principal_components(spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double"), ["a", "b", "c"], 3)
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    assert explained == pytest.approx(list(values / values.sum()))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "1997"), (2, 2.5, "1998")], "k int, v double, season string")
    sinks.write_payload(df, str(tmp_path / "p"), ["season"])
    back = {r.k: r.v for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert back == {1: None, 2: 2.5}
    assert sinks.archive_season(df, str(tmp_path / "a"), "1997") and not sinks.archive_season(df, str(tmp_path / "a"), "1997")
    sinks.write_table(df, str(tmp_path / "c"), ["k", "v", "missing"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["k", "v"]
    lines = [r.line for r in sinks.metric_lines(spark.createDataFrame([('a"b', 3)], "l string, value int"), "m", "gauge", ["l"]).collect()]
    assert sorted(lines) == ["# TYPE m gauge", 'm{l="a\\"b"} 3']
    sinks.append_log(df.select("k"), str(tmp_path / "log"))
    sinks.append_log(df.select("k"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_season_index_is_whole_and_as_of(spark):
    rows = []
    for player in range(24):
        for rnd in range(1, 13):
            if (player + rnd) % 11:
                rows.append((player, player % 6, ["GK", "DEF", "MID", "FWD"][player % 4], rnd * 100 + player % 6, 1, rnd, (player + rnd) % 6 if (player + rnd) % 6 != player % 6 else 7, "home" if rnd % 2 else "away", 60 + rnd, (player * rnd) % 3 // 2, (player % 7 + rnd) / 10, 0.1 * (player % 5), 0.05 * (player % 3)))
    schema = "player int, team int, role string, fixture int, season int, rnd int, opp int, venue string, mins int, goal int, xg double, xa double, bu double"
    # the other side of a team's fixture is one
    matches = spark.createDataFrame(rows, schema).withColumn("opp", (F.col("team") + F.col("rnd")) % 8)
    bodies = matches.select("player").distinct().withColumn("age", (18 + F.col("player") % 15).cast("double")).withColumn("injuries", F.lit(1)).withColumn("days", F.lit(10))
    whole = R.season_index(matches, bodies).collect()
    assert len(whole) == 24 and all(r["index"] is not None and r["pro"] is not None for r in whole)
    part = R.season_index(J.as_of(matches, "rnd", 6), bodies).collect()
    assert max(r.n for r in part) <= 6
    dims = {(r.player, r.ctx): r for r in R.context_dimensions(matches).collect()}
    assert dims[1, "total"].boost is None  # too few games without
