import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from touchline.llm import jaccard_join as jj
from touchline.llm import repeats
from touchline.llm import substring_dedup as words
from touchline.llm import suffix_dedup as strings
from touchline.llm.components import components

SCHEMA = "doc_id long, text string, n_removed string, slice string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def corpus(seed=5, n=60):
    """Random texts with shared passages, repeats inside a text, copies, nulls and odd bytes."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))))
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t  "]).join(parts)))
    return rows + [(500, None), (501, ""), (502, rows[3][1]), (503, rows[3][1]), (504, "a " * 300), (505, "=" * 3000), (506, "=" * 1500), (507, "one")]


def brute_words(rows, window):
    seen, out = set(), {}
    for i, text in sorted((i, t or "") for i, t in rows):
        w = text.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(a for a, b in zip(w, gone) if not b).decode())
    return out


def test_word_windows_against_brute_force(spark):
    rows = corpus()
    for window, gram in ((20, 6), (5, 2)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in words.remove_repeats(frame(spark, rows), window, gram).collect()}
        assert got == brute_words(rows, window)


def test_word_windows_carry_columns_and_ties(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(1, text), (1, text), (2, "short"), (None, text)]
    got = words.remove_repeats(frame(spark, rows), carry=("slice",)).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 25, 25] and all(r["slice"] == "y" for r in got)
    assert next(r for r in got if r.doc_id is None).n_removed == 0  # a null id comes first
    assert words.remove_repeats(frame(spark, rows).limit(0)).collect() == []


def brute_strings(rows, window):
    count = Counter(t[s : s + window] for _, text in rows for t in [(text or "").encode()] for s in range(len(t) - window + 1))
    out = {}
    for i, text in rows:
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, dtype=bool)
        for s in range(len(t) - window + 1):
            if count[t[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_long_strings_against_brute_force(spark):
    rows = corpus(seed=8)
    for window, gram, note in ((400, 32, 256), (60, 8, 40), (60, 8, 60)):
        made = strings.remove_repeats(frame(spark, rows), window, gram, note).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in made}
        assert got == brute_strings(rows, window)
        assert {r.doc_id: r.n_repeated for r in made} == {i: v[1] for i, v in brute_strings(rows, note).items()}
    assert strings.remove_repeats(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("salt", [1 << 20, 8])
@pytest.mark.parametrize("most", [512, 2])
def test_hot_anchors_against_brute_force(spark, monkeypatch, salt, most):
    rng = random.Random(11)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(70))
    rows = corpus(seed=12, n=30) + [(1000 + k, f"{'x' * (k % 9)} q{k} {passage} {k * k} end") for k in range(25)]
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "PIECE", 700)
    for module in (strings, words):
        monkeypatch.setattr(module, "SALT", salt)
    monkeypatch.setattr(strings, "MOST", most)
    for window, gram, note in ((400, 32, 256), (60, 8, 40)):
        made = strings.remove_repeats(frame(spark, rows), window, gram, note).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in made} == brute_strings(rows, window)
        assert {r.doc_id: r.n_repeated for r in made} == {i: v[1] for i, v in brute_strings(rows, note).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in words.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_words(rows, 20)


def test_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab") for _ in range(5000))
    monkeypatch.setattr(repeats, "PIECE", 700)
    made = list(repeats.blocks([b"short", text, b"last"], strings.UNITS, 60))
    assert [(b.first, b.base) for b in made][1:3] == [(1, 0), (1, 700)] and made[-1].first == 2
    owned = sorted(b.base + s for b in made if b.own for f in [b.anchors(repeats.Prefix(b.values), 40, 8)] for low, high in zip(f.low, f.high) for s in range(low, high + 1))
    assert owned == list(range(5000 - 39))


def test_rows_without_or_with_the_same_id(spark):
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(None, text), (None, text), (None, "x " + text), (7, text), (7, "other words"), (7, None)]
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in strings.remove_repeats(frame(spark, rows)).collect())
    n = len(text)
    assert got == [(False, 0, 0), (False, 11, 0), (False, n, n), (True, n, n), (True, n, n), (True, n + 2, n)]
    got = [(r.doc_id is None, r.n_words, r.n_removed) for r in words.remove_repeats(frame(spark, rows)).collect()]
    assert len(got) == 6 and sorted(x[2] for x in got) == [0, 0, 0, 120, 120, 120] and (False, 120, 120) in got


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 4, 200)
    values = strings.BYTES[np.concatenate([rng.integers(0, 4, 300), passage, rng.integers(0, 4, 77), passage])]
    prefix = repeats.Prefix(values)
    found = repeats.anchors(prefix, np.array([0, 350, len(values)]), 50, 8)
    owner = {s: (int(h), int(p - s)) for p, h, low, high in zip(found.at, found.hash, found.low, found.high) for s in range(low, high + 1)}
    starts = [s for a, b in ((0, 350), (350, len(values))) for s in range(a, b - 50 + 1)]
    assert sorted(owner) == starts  # each window belongs to one anchor
    by = {}
    for s in starts:
        by.setdefault(values[s : s + 50].tobytes(), set()).add(owner[s])
    assert all(len(v) == 1 for v in by.values())


def test_suffix_order_sorts_like_python():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(600))
    buffer = np.frombuffer(data, dtype=np.uint8)
    order = strings.SuffixOrder(buffer, repeats.Prefix(strings.BYTES[buffer]), 20)
    starts = np.array([rng.randrange(580) for _ in range(150)])
    group = np.array([rng.randrange(4) for _ in range(150)])
    places, own, shared = order.sort(starts, group)
    heads = [(int(g), data[s : s + 20]) for g, s in zip(own, starts[places])]
    assert heads == sorted(heads)
    for k in range(1, len(heads)):
        same = heads[k][0] == heads[k - 1][0]
        common = next((j for j in range(20) if heads[k][1][j] != heads[k - 1][1][j]), 20)
        assert shared[k] == (common if same else 0)


def near_corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        text = [f"t{base}x{rng.randrange(10_000)}" for _ in range(120)]
        for copy in range(rng.choice([1, 2, 9])):
            edited = list(text)
            for _ in range(min(copy, 2)):
                edited[rng.randrange(120)] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows) + 10, " ".join(edited)))
    rows += [(900, rows[0][1]), (901, "a b"), (902, "a b"), (903, "a  b"), (904, None), (905, ""), (906, "a b c d e f"), (907, " ".join(["z"] * 90)), (908, " ".join(["z"] * 95))]
    return rows


def brute_links(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    nodes = {}
    for i in sorted(sets):
        nodes.setdefault(sets[i], []).append(i)
    links = Counter()
    keys = list(nodes)
    for s in keys:
        for i in nodes[s]:
            a, b = find(i), find(nodes[s][0])
            root[max(a, b)] = min(a, b)
    for x in range(len(keys)):
        for y in range(x):
            both = len(keys[x] & keys[y])
            if both and both >= threshold * (len(keys[x]) + len(keys[y]) - both) - 1e-9:
                links[x] += 1
                links[y] += 1
                a, b = find(nodes[keys[x]][0]), find(nodes[keys[y]][0])
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[k], len(nodes[s]) - 1) for k, s in enumerate(keys) for i in nodes[s]}


def test_links_against_brute_force(spark, monkeypatch):
    rows = near_corpus()
    want = brute_links(rows)
    assert max(v[1] for v in want.values()) >= 5
    for block in (256, 3):  # small blocks: groups are verified in pieces
        monkeypatch.setattr(jj, "BLOCK", block)
        got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jj.link(frame(spark, rows)).collect()}
        assert got == want
    assert jj.link(frame(spark, rows).limit(0)).collect() == []


def test_prefixes_are_shortened_until_the_recall(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for base in range(40):  # pairs close to the threshold
        text = [f"t{base}x{k}" for k in range(100)]
        rows.append((len(rows), " ".join(text)))
        for k in (20, 60):
            text[k] = f"e{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(text)))
    depths = []
    whole = jj.met
    monkeypatch.setattr(jj, "met", lambda sets, depth, levels: depths.append(depth) or whole(sets, depth, levels))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jj.link(frame(spark, rows)).collect()}
    assert got == brute_links(rows) and depths[0] == 8 and depths[-1] < 8  # 0.82: too few would be found at full length
    depths.clear()
    copies = [(k, f"{rows[k % 2 * 2][1]} {'end' * (k // 2)}") for k in range(6)]
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jj.link(frame(spark, copies)).collect()} == brute_links(copies)
    assert depths == [8] and jj.chance(0.8, 8, 32) > jj.LEAST_RECALL


def test_signatures_are_sorted_tries():
    forest = jj.Forest(4, 8)
    grams = jj.shingles("a b c d e f g h i j k l m n o p", 5)
    number = forest.signature(grams).view(np.uint64)
    shorter = forest.signature(grams[:-1]).view(np.uint64)
    assert number.shape == (4,) and (forest.signature(grams[::-1].copy()).view(np.uint64) == number).all()
    same = [next((d for d in range(8, 0, -1) if a >> np.uint64(64 - 8 * d) == b >> np.uint64(64 - 8 * d)), 0) for a, b in zip(number, shorter)]
    assert max(same) > 0


def test_links_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, long), (1, long), (2, long + " more"), (None, long), (3, None), (4, None), (5, "a b"), (5, "c d"), (6, "c d")]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jj.link(frame(spark, rows)).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 0), (3, 3, 0, 1), (4, 3, 0, 1), (5, 5, 0, 0), (5, 5, 0, 1), (6, 5, 0, 1)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 100)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 150, 200, 300)}
