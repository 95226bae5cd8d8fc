import base64
import gzip
import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import decontamination as dc
from touchline.llm import html_extraction as html
from touchline.llm import langid, syncmers, warc


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, anchors int")


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{x:y}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


ARTICLE = "<h1>A title</h1><p>The first paragraph of the story, with <a href='#'>a link</a> and enough words to count.</p><p>The second one &amp; more words&nbsp;to read, longer than any menu.</p>"
TEXT = "A title The first paragraph of the story, with a link and enough words to count. The second one & more words to read, longer than any menu."


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; somebody</footer>",
        f"<header><h1>Site</h1></header><div id=wrap><div class='post-content'>{ARTICLE}<div class=comments><p>A reader says that this is all wrong, at length, and more.</p></div></div><aside>Also read this</aside></div>",
        f"<div class='cookie-notice'>We use cookies and you agree to all of it by reading on and on</div><main>{ARTICLE}<form><p>Sign up here</p><input name=q></form></main><div class='ad'>Buy now</div>",
        f"<div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div><section>{ARTICLE}</section><div><a href=x>More</a> <a href=y>Still more</a></div>",
        f"<article>{ARTICLE.replace('</p>', '')}</article>",
        f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td>{ARTICLE}</td></tr></table>",
        f"<div class=content>{ARTICLE.replace('<p>', '').replace('</p>', '<br><br>')}</div><div class=links><a href=a>x</a> <a href=b>y</a></div>",
        f"<article><!-- <p>hidden</p> -->{ARTICLE}<div hidden>secret</div><noscript>turn it on</noscript></article>",
    ],
)
def test_main_text(body):
    assert html.main_text(page(body)) == TEXT


LONG = "Words of the story go on and on, with commas, full stops and all that prose has in it. " * 4
MORE = "Another part of the same story, which is told at the same length and in the same manner. " * 4
MENU = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(6))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<form id=aspnetForm><ul>{MENU}</ul><div><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></div><input name=q><button>Go</button></form>", f"Head {LONG}{MORE}"),
        (f"<form><fieldset><article><p>{LONG}</p></article></fieldset></form>", LONG),
        (f"<nav><ul>{MENU}</ul></nav><div class=a><p>{LONG}</p><p>{LONG}</p></div><div class=b><p>{MORE}</p><p>{MORE}</p></div>", f"{LONG}{LONG}{MORE}{MORE}"),
        (f"<div class=wrap><div class=one><p>{LONG}</p></div><div class=two><p>{MORE}</p></div></div><footer>Foot of the page</footer>", f"{LONG}{MORE}"),
        (f"<article><p>{LONG}</p><ol><li><a href=1>A long title of a work that the article refers to, 1999</a></li><li><a href=2>Another long title of a work that is referred to</a></li><li><a href=3>The third of the works, with a long title as well</a></li></ol></article>", f"{LONG}A long title of a work that the article refers to, 1999 Another long title of a work that is referred to The third of the works, with a long title as well"),
        (f"<article><p>{LONG}</p><ul>{MENU}</ul><p>{MORE}</p></article>", f"{LONG}{MORE}"),
        (f"<article><p>Press <button>the key</button> twice. {LONG}</p></article>", f"Press the key twice. {LONG}"),
        (f"<article><p>{LONG}</p><button>Subscribe now</button></article>", LONG),
        (f"<div><form action=/s><label>Search</label><input><button>Go</button></form></div><div id=main><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG}{MORE}"),
        (f"<aside><p>Short side</p></aside><div><p>{LONG}</p></div>", LONG),
        (f"<main><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p></section></main>", f"One {LONG}Two {MORE}"),
        (f"<div class='layout sidebar-left'><div><p>{LONG}</p></div></div>", LONG),
        (f"<div class=comments><p>{MORE}</p></div><article><p>{LONG}</p><p>{LONG}</p><p>{MORE}</p></article>", f"{LONG}{LONG}{MORE}"),
        (f"<table><tr><td><ul>{MENU}</ul></td><td><p>{LONG}</p></td></tr></table>", LONG),
        (f"<center><font>{LONG}<br><br>{MORE}</font></center>", f"{LONG}{MORE}"),
        (f"<article><h1>T</h1><blockquote><p>{LONG}</p></blockquote><pre>a  b\n c</pre></article>", f"T {LONG}a b c"),
        (f"<article><table><tr><th>k</th><td>v</td></tr></table><p>{LONG}</p></article>", f"k v {LONG}"),
        (f"<article><figure><img src=x><figcaption>What it shows</figcaption></figure><p>{LONG}</p></article>", f"What it shows {LONG}"),
        (f"<article><header><h1>Its title</h1></header><p>{LONG}</p><footer>Tags</footer></article>", f"Its title {LONG}"),
        (f"<div role=navigation><a href=a>One</a></div><div role=main><p>{LONG}</p></div><div role=contentinfo>Legal</div>", LONG),
        (f"<div class=advert><p>Buy now, only today</p></div><p>{LONG}</p><p>{MORE}</p>", f"{LONG}{MORE}"),
        (f"<article><p>caf&eacute; &lt;b&gt; &#x41; {LONG}</p></article>", f"café <b> A {LONG}"),
    ],
)
def test_page_shapes(body, want):
    assert html.main_text(page(body)) == want.strip()


def test_densities_against_brute_force():
    import math

    rng = random.Random(9)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return ("a" if rng.random() < 0.3 else "p", "w" * rng.randint(0, 30), [])
        return (rng.choice(["div", "section"]), "t" * rng.randint(0, 5), [tree(depth - 1) for _ in range(rng.randint(1, 4))])

    def source(t):
        return f"<{t[0]}>{t[1]}{''.join(map(source, t[2]))}</{t[0]}>"

    def count(t, within=False):
        within = within or t[0] == "a"
        got = [len(t[1]), 1, len(t[1]) * within, int(t[0] == "a")]
        for child in t[2]:
            got = [x + y for x, y in zip(got, count(child, within))]
        return got

    for _ in range(30):
        body = ("body", "", [tree(4) for _ in range(3)])
        made = html.Page(source(body))
        own = [0] * len(made.tag)
        for node, chars in made.order:
            own[node] += len(chars or "")
        d = html.Densities(made, own, [True] * len(made.tag), 1)
        whole = count(body)
        share = whole[2] / max(1, whole[0])

        def density(t):
            c, n, lc, ln = count(t)
            if not c:
                return 0.0
            inner = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            return c / n * math.log(max(1.0, c / max(1, lc) * n / max(1, ln)) + 1) / max(math.log(inner), 0.1)

        nodes = []

        def walk(t):
            nodes.append(t)
            for child in t[2]:
                walk(child)

        walk(body)
        assert made.tag[1:] == [t[0] for t in nodes]
        assert d.dense[1:] == pytest.approx([density(t) for t in nodes])
        for n, t in enumerate(nodes, 1):
            if t[2] and 2 * len(t[1]) <= count(t)[0]:
                assert d.total[n] == pytest.approx(sum(map(density, t[2])))


def test_main_text_of_odd_pages(spark):
    assert html.main_text("") == "" and html.main_text("<html><body></body></html>") == ""
    assert html.main_text("plain words") == "plain words"
    assert html.main_text("<p>a<b>b</b>c<br>d") == "abc d"
    assert html.main_text(page("<h1>Only</h1><p>one two three</p><p>four</p>")) == "Only one two three four"
    deep = "<div>" * 50_000 + "<p>deep text</p>"
    assert html.main_text(deep) == "deep text"
    assert html.main_text("<p class=\"broken>text " * 50 + "x" * 1000) is not None
    rows = spark.createDataFrame([(1, "u", page(f"<article>{ARTICLE}</article>"), "x"), (1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "n", "<p>words", "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html.extract(rows).collect())
    assert got == [(0, "n", "words", 5), (1, "u", "", 0), (1, "u", TEXT, len(TEXT)), (2, "", "", 0), (2, "", "", 0)]
    assert html.extract(rows.limit(0)).collect() == []


def test_archives_round_trip(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>{k % 4}</p>" if k % 3 else f"<p>own {k}</p>") for k in range(40)]
    rows += [(100, None, None), (101, "http://x/\r\nWARC-Type: bad", ""), (None, "n", "<p>1</p>"), (7, "again", f"<p>{7 % 4}</p>"), (102, "l", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.archive(pages, spark).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        revisit = i is None or i != first[h or ""]
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.archive(pages.limit(0), spark).collect() == []


def test_archives_are_plain_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100)
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, tmp_path.as_uri())
    stray = tmp_path / "lost-task.warc.gz"
    stray.write_bytes(b"never read")
    data = b"".join(gzip.decompress((tmp_path / r.path.rpartition("/")[2]).read_bytes()) for r in manifest.collect())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"<p>x</p>") == 1 and b"WARC-Type: revisit" in data
    records = warc.read_archives(manifest).collect()
    assert {r.page_id: r.payload for r in records} == {1: b"<p>x</p>", 2: None}


def brute_sketch(text, k=5, size=128):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def of(data):
        return signed(xxhash.xxh64_intdigest(data, 42))

    def chain(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    units = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    short = sorted({of(u.encode()) >> 32 for u in units})[:size]
    if len(units) < k:
        return short
    h = [of(u.encode()) for u in units]
    pairs = [chain(a, b) for a, b in zip(h, h[1:])]
    runs = [pairs[i : i + k - 1] for i in range(len(units) - k + 1)]
    return sorted({chain(*r) >> 32 for r in runs if min(r[0], r[-1]) <= min(r[1:-1])})[:size] or short


def brute_span(text, sketch, k=5):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    units = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    if not units:
        return 0.0
    h = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units]
    pairs = [chain(a, b) for a, b in zip(h, h[1:])]
    runs = [(i, pairs[i : i + k - 1]) for i in range(len(units) - k + 1)]
    found = [(i, chain(*r) >> 32) for i, r in runs if min(r[0], r[-1]) <= min(r[1:-1])] if len(units) >= k else []
    found = found or [(i, x >> 32) for i, x in enumerate(h)]
    places = [i for i, x in found if x in sketch]
    return min(max(places) - min(places) + k, len(units)) / len(units) if places else 0.0


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 4, 5, 6, 40, 400, 3000)] + [None, "x" * 5000, "漢字 " * 40, "same text here for two rows now", "same text here for two rows now"]
    rows = [(i * 7, t, "en", "x", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(frame(spark, rows)).collect()}
    digits = lambda s: "".join(f"{x & 0xFFFFFFFF:08X}" for x in s)

    def like(a, b):
        if not a or not b:
            return float(a == b)
        least = sorted(set(a) | set(b))[:128]
        return len(set(a) & set(b) & set(least)) / len(least)

    for n, text in enumerate(texts):
        text, following = text or "", texts[(n + 1) % len(texts)] or ""
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        r = got[n * 7]
        a, b, c = brute_sketch(text), brute_sketch(edited), brute_sketch(following)
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(text), edited, digits(a), digits(b))
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert r.span_edited == pytest.approx(brute_span(text, set(b)))
    assert syncmers.edited_fingerprints(frame(spark, rows).limit(0)).collect() == []
    one = syncmers.edited_fingerprints(frame(spark, [(5, "a b c d e f g h", "en", "x", 1)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_with_null_and_repeated_ids(spark):
    rows = [(None, "n n n n", "en", "x", 1), (3, "b b b b", "en", "x", 1), (3, "a a a a", "en", "x", 1)]
    got = syncmers.edited_fingerprints(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.edited) for r in got) == [(False, "a a a n"), (False, "b b b n"), (True, "n n n a")]


def test_fingerprint_plan_has_no_python(spark):
    df = syncmers.edited_fingerprints(frame(spark, [(1, "a", "en", "x", 1)]))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


WORDS = {"aa": "bab dab gab lab tab nab".split(), "oo": "bob dod gog lol tot non".split(), "uu": "büb düd güg lül tüt nün".split()}


def labelled(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "x", 1))
    return out


def test_language_of_held_out_documents(spark):
    rows = labelled(240) + [(1000, None, "aa", "x", 1), (1001, "", None, "x", 1), (1002, "12 ?! 3", "oo", "x", 1), (1003, "bab " * 5000, None, "x", 1)]
    df = frame(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(df, ~held, per_lang=60)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    truth = {r[0]: r[2] for r in rows[:240]}
    import zlib

    tested = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == truth[i] for i in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "aa"
    labels = langid.label_positions(df.filter("doc_id < 5"), model).collect()
    assert all(r.ends[-1] == len(rows[r.doc_id][1].encode()) for r in labels)
    assert {r.doc_id for r in langid.with_language(df, model).collect()} == set(range(240)) | {1003}


class Fixed:
    """Stands for a network: the share of a's and of b's among the bytes."""

    langs = ["aa", "bb"]

    def documents(self, data, offsets):
        parts = [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]
        return np.array([[(p.count(b"a") + 0.5) / (p.count(b"a") + p.count(b"b") + 1), (p.count(b"b") + 0.5) / (p.count(b"a") + p.count(b"b") + 1)] for p in parts])


def test_the_network_decides_what_stays(spark):
    rows = [(1, "aaaa", None, "x", 1), (2, "bbb", "kept", "x", 1), (3, "ab ab", None, "x", 1), (None, "bbbb", None, "x", 1), (4, None, "aa", "x", 1), (5, "1 2", "aa", "x", 1), (6, "", None, "x", 1), (2, "bbb", "kept", "x", 1)]
    df = frame(spark, rows)
    got = sorted(((r.doc_id or 0, r.lang, r.score) for r in langid.with_language(df, Fixed()).collect()))
    assert got == [(0, "bb", "x"), (1, "aa", "x"), (2, "kept", "x"), (2, "kept", "x")]  # 3 is an even guess
    assert langid.with_language(df, None).collect() == []
    assert langid.with_language(df.limit(0), Fixed()).collect() == []
    assert [tuple(r) for r in langid.predict(frame(spark, [(3, "ab", None, "x", 1), (3, "ab", None, "x", 1), (None, "bb", None, "x", 1)]), Fixed()).orderBy("doc_id").collect()][1:] == [(3, "aa", 0.5)] * 2
    assert langid.least_score(4) == pytest.approx(0.325, abs=1e-5) and langid.least_score(1) <= 1


def test_language_without_labels(spark):
    df = frame(spark, [(1, "words", None, "x", 1)])
    assert langid.train(df) is None
    assert [tuple(r) for r in langid.predict(df, None).collect()] == [(1, "und", 0.0)]
    assert langid.predict(df.limit(0), None).collect() == []


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = langid.ByteGru(["a", "b"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids = rng.integers(0, 256, (5, 2))
    states, kept = model._run("f", ids)
    upstream = rng.normal(size=states.shape)
    grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
    model._back("f", ids, kept, upstream, grads)
    for name in ("f_in", "f_state", "f_reset"):
        w = model.weights[name]
        place = (ids[2, 0], 1) if name == "f_in" else (1, 4) if name == "f_state" else (1,)
        w[place] += 1e-4
        up = (model._run("f", ids)[0].astype(np.float64) * upstream).sum()
        w[place] -= 2e-4
        down = (model._run("f", ids)[0].astype(np.float64) * upstream).sum()
        w[place] += 1e-4
        assert grads[name][place] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=0.02)


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1]))
        row = new
    return row[1:]


def test_myers_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        assert dc.myers(p, t) == brute_distance(p, t)


def test_items_within_the_budget(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))) for k in range(12)] + [(50, None), (51, ""), (None, "x"), (52, "tiny"), (53, "tiny")]
    docs = []
    for d in range(60):
        text = "".join(rng.choice("ijklm ") for _ in range(300))
        if d % 3 == 0:
            item = list(items[d % 12][1])
            for _ in range(rng.randint(0, 14)):
                place = rng.randrange(len(item))
                item[place] = rng.choice(["", "Z", item[place] + "q"])
            text = text[:150] + rng.choice([" ", "\n"]) + "".join(item).upper() + text[150:]
        docs.append((d, text, "en", "x", 1))
    docs += [(99, None, "en", "x", 1), (98, "so tiny a thing", "en", "x", 1)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.find_items(frame(spark, docs), table).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            p = dc.normal(item or "")
            if p and i is not None:
                least = min(brute_distance(p, dc.normal(text or "")), default=999)
                if least <= int(dc.ERROR_RATE * len(p)):
                    want[d, i] = least
    assert got == want and any(want.values())
    clean = {r.doc_id for r in dc.without_items(frame(spark, docs), table).collect()}
    assert clean == {d[0] for d in docs} - {d for d, _ in want}
    assert dc.find_items(frame(spark, docs), table.limit(0)).collect() == []
    monkeypatch.setattr(dc, "ITEM_BYTES", 400)  # several blocks, each fetched and written by itself
    assert len(dc.Items(table, "item_id", "text")) > 2
    assert {(r.doc_id, r.item_id): r.distance for r in dc.find_items(frame(spark, docs), table).collect()} == want
    assert {r.doc_id for r in dc.without_items(frame(spark, docs), table).collect()} == clean


def test_items_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    words = " ".join(f"w{k}" for k in range(40_000))
    docs = spark.createDataFrame([(1, f"{item} x {item}", 7, "s"), (1, f"{item} x {item}", 7, "s"), (None, f"{words} {item} {words}", 8, "t"), (2, words, 9, "u")], "doc_id long, text string, item_id long, start string")
    table = spark.createDataFrame([(5, item, "x"), (5, item, "x"), (6, item, "y")], "item_id long, text string, distance string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance, r.start) for r in dc.find_items(docs, table).collect())
    assert got == [(0, 5, 0, len(words) + 1), (0, 6, 0, len(words) + 1), *[(1, 5, 0, 0)] * 2, *[(1, 6, 0, 0)] * 2]
    assert [tuple(r) for r in dc.without_items(docs, table).collect()] == [(2, words, 9, "u")]
