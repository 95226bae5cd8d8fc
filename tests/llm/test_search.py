"""Vector codes, ranked search and exact search against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import exact_search, ranked_search, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n, dims, seed=1, far=1.0):
    r = random.Random(seed)
    return [(k, [round(r.gauss(0, far) + 3 * (k % 3), 3) for _ in range(dims)], None if k % 7 == 0 else k % 4) for k in range(n)]


def codes_by_hand(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    whole = [[math.floor(scale * float(np.float32(x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    step = width // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][1]))[:entries]
    books = [[cut(whole[k], p) for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    told = lambda v: [min((dist(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [told(v) for v in whole]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for v, f in zip(whole, found, strict=True) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [told(v) for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted((repr(i), "".join(f"{j:02x}" for _, j in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def coded(df, **how):
    return sorted((repr(q.vec_id), q.code, q.error, q.label_error, q.codebooks_sha256) for q in vector_codes.compress(df, **how).collect())


def test_codes_equal_a_plain_search(spark):
    rows = vectors(300, 8)
    rows += [(301, None, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [float("nan")] * 8, 2), (304, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None)]
    rows += [(5, rows[5][1], rows[5][2]), (9, [0.0] * 8, 3), (305, [1.0] * 5, 0), (306, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert coded(df, entries=40) == codes_by_hand(rows, entries=40)


def test_codes_with_equal_entries_go_to_the_lower_index(spark):
    rows = [(k, [float(k % 2)] * 4, k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    got = coded(df, entries=50)
    assert got == codes_by_hand(rows, entries=50) and {c for _, c, *_ in got} == {"00000000", "01010101"}


def test_tree_search_visits_boxes_at_equal_distance():
    r = np.random.default_rng(4)
    entries = r.integers(0, 4, (200, 3))
    points = r.integers(-1, 6, (500, 3))
    index, distance = vector_codes.nearest(vector_codes.kd_tree(entries), entries, points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], VECTORS)).collect() == []
    only = vector_codes.compress(spark.createDataFrame([(None, [1.0, 2.0], 2)], VECTORS)).collect()
    assert [(q.vec_id, q.code, q.error, q.label_error) for q in only] == [(None, None, None, None)]


def test_codes_keep_other_columns_out(spark):
    rows = [(k, [float(k)] * 4, k % 2, "x", 1) for k in range(9)]
    df = spark.createDataFrame(rows, VECTORS + ", code string, id int")
    assert vector_codes.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 0)], VECTORS)).collect()


def found_by_hand(rows, asks, k=5, scale=256):
    kept = [(n, i, [math.floor(scale * float(np.float32(x))) for x in v]) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in kept:
        if i is None or not asks(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is not None, j or 0) for m, j, v in kept if m != n)[:k]
        out += [(i, rank, j if there else None, -s) for rank, (s, there, j) in enumerate(scores, 1)]
    return sorted(out, key=repr)


SMALL = [{}, {"sample": 12, "pivots": 4, "queries": 3, "chunk": 16}, {"sample": 3, "pivots": 50, "queries": 1, "chunk": 1000}]


@pytest.mark.parametrize("how", SMALL)
def test_search_equals_a_plain_search(spark, how):
    rows = vectors(240, 6, seed=8)
    rows += [(500, None, 0), (510, [None] * 6, 0), (520, [float("nan")] * 6, 0), (None, rows[3][1], 0), (530, [2.0, 1.0], 0), (540, [0.0] * 6, 0), (550, [], 0)]
    rows += [rows[10], rows[10], (20, rows[11][1], 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = exact_search.search(df, F.col("vec_id") % 10 == 0, **how)
    assert sorted(((q.query_id, q["rank"], q.vec_id, q.score) for q in got.collect()), key=repr) == found_by_hand(rows, lambda i: i % 10 == 0)


def test_search_with_one_very_common_vector(spark):
    rows = [(k, [1.0, 0.5] if k % 3 else [k / 100, -1.0], 0) for k in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    got = exact_search.search(df, F.col("vec_id") % 50 == 0, **SMALL[1])
    assert sorted(((q.query_id, q["rank"], q.vec_id, q.score) for q in got.collect()), key=repr) == found_by_hand(rows, lambda i: i % 50 == 0)


def test_search_leaves_out_what_bounds_exclude(spark, monkeypatch):
    """Two far clusters: a group of one does not get the rows of the other."""
    rows = [(k, [10.0 + k / 500, 0.1] if k % 2 else [-10.0 - k / 500, 0.1], 0) for k in range(200)]
    df = spark.createDataFrame(rows, VECTORS)
    seen = spark.sparkContext.accumulator(0)
    solve = exact_search.best

    def counted(table, k, width):
        seen.add(table.num_rows)
        return solve(table, k, width)

    monkeypatch.setattr(exact_search, "best", counted)
    got = exact_search.search(df, F.col("vec_id") % 2 == 1, queries=200, chunk=1000).collect()
    assert len(got) == 500 and seen.value <= 2 * (100 + 100)
    assert sorted(((q.query_id, q["rank"], q.vec_id, q.score) for q in got), key=repr) == found_by_hand(rows, lambda i: i % 2 == 1)


def test_search_of_nothing_and_of_few(spark):
    asks = F.col("vec_id") % 2 == 0
    assert exact_search.search(spark.createDataFrame([], VECTORS), asks).collect() == []
    assert exact_search.search(spark.createDataFrame([(2, [1.0], 0)], VECTORS), asks).collect() == []
    assert exact_search.search(spark.createDataFrame([(1, [1.0], 0), (3, [2.0], 0)], VECTORS), asks).collect() == []
    few = exact_search.search(spark.createDataFrame([(2, [1.0], 0), (3, [-2.0], 0)], VECTORS), asks).collect()
    assert [tuple(q) for q in few] == [(2, 1, 3, -131072)]
    clash = spark.createDataFrame([(2, [1.0], 0, 7, "x"), (3, [-2.0], 0, 8, "y")], VECTORS + ", row int, chunk string")
    assert exact_search.search(clash, asks).columns == ["query_id", "rank", "vec_id", "score"]


def test_large_products_stay_exact():
    a = np.array([[(1 << 27) - 1, 1 << 26]])
    assert exact_search.products(a, a)[0, 0] == ((1 << 27) - 1) ** 2 + (1 << 52)
    with pytest.raises(ValueError):
        exact_search.products(np.array([[1 << 32]]), np.array([[1 << 32]]))


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(docs, items, k=50):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    texts = [(n, i, split(t)) for n, (i, t, *_) in enumerate(docs)]
    texts = [x for x in texts if x[2]]
    n_docs, total = len(texts), sum(len(t) for *_, t in texts)
    df = {}
    for *_, t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for n, i, t in texts:
            m = 100 - 50 + (50 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in set(split(text)) if w in df and w in t)
            if score > 0:
                found.append((-score, i is not None, i or 0, n))
        out += [(item, rank, i if there else None, -s) for rank, (s, there, i, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(((q.item_id, q["rank"], q.doc_id, q.score) for q in ranked_search.rank(d, i, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"most_terms": 5}, {"bucket": 4, "shard": 7, "k": 3}])
def test_ranks_equal_a_plain_scoring(spark, how):
    r = random.Random(2)
    words = ["the", "The", "école", "Ünder", "naïve", "x1", "42", "漢字", "a", "b", "c", "d-e", "f_g", "rare"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, " ,;- "), (203, "the " * 3000), docs[4], docs[4], (None, "rare école"), (204, "a\x00b the")]
    items = [(1, "the rare école"), (2, "RARE x1 42 漢字 rare"), (3, None), (4, "!!"), (5, "absent"), (1, "d-e f_g"), (7, "ÜNDER Ünder")]
    assert ranked(spark, docs, items, **how) == ranked_by_hand(docs, items, how.get("k", 50))


def test_ranks_without_documents_or_items(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == []
    assert ranked(spark, [(1, None), (2, "")], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, "b", "y", 6)], "doc_id bigint, text string, term string, row int")
    items = spark.createDataFrame([(1, "a", 3)], "item_id bigint, text string, w int")
    assert [tuple(q) for q in ranked_search.rank(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
