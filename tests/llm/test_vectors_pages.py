"""Hard negatives, vector codes and page texts against plain versions, with odd rows."""

import hashlib
import html
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracadence.llm import hardneg, heaplloyd, queries, wrappers
from terracadence.llm.htmltree import parse

VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, part int, score int"


def vector_rows(n=400, dims=32, seed=3):
    """Clusters with ties, repeated rows, nulls, non-finite and short vectors."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.3, (8, dims))
    rows = []
    for k in range(n):
        v = np.round((centres[k % 8] + rnd.normal(0, 0.1, dims)) * 16) / 16
        rows.append((k, [float(np.float32(x)) for x in v], int(rnd.integers(0, 4)), 1, "x", 2, 3))
    rows += [rows[5], rows[5], (n, rows[7][1], rows[7][2], 1, "x", 2, 3), (n + 1, None, 1, 1, "x", 2, 3), (n + 2, [], 2, 1, "x", 2, 3), (n + 3, [0.5, None], 2, 1, "x", 2, 3)]
    rows += [(n + 4, [float("nan")] * dims, 2, 1, "x", 2, 3), (n + 5, [float("inf")] * dims, 2, 1, "x", 2, 3), (n + 6, rows[9][1][:5], None, 1, "x", 2, 3), (n + 7, rows[9][1][:5], 3, 1, "x", 2, 3)]
    return rows


def usable(rows, dims):
    out = []
    for r in rows:
        if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]):
            out.append((r[0], r[2], tuple(int(np.floor(256 * float(np.float32(x)))) for x in r[1]) + (0,) * (dims - len(r[1]))))
    return out


# --- hard negatives


def plain_negatives(rows, dims, every):
    rows = sorted({r for r in usable(rows, dims) if r[0] is not None and r[1] is not None})
    out = set()
    for a, label, v in rows:
        if a % every == 0:
            score = lambda r, v=v: sum(x * y for x, y in zip(v, r[2], strict=True))
            others = sorted({(-score(r), r[0], r[1]) for r in rows if r[0] != a})
            for s, p, _ in [o for o in others if o[2] == label][:5]:
                inside = [o for o in others if o[2] != label and 30 * -s <= 100 * -o[0] <= 90 * -s]
                out |= {(a, p, k + 1, o[1], -s, -o[0]) for k, o in enumerate(inside[:10])}
    return out


@pytest.mark.parametrize("block, tile", [(16_384, 2_048), (3, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(hardneg, "TILE_ROWS", tile)
    monkeypatch.setattr(hardneg, "TILE_ANCHORS", tile)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    out = hardneg.mine(df, df.where("vec_id % 25 = 0"), block_anchors=block).collect()
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows, 32, 25)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(vector_rows(30), VECTORS)
    assert hardneg.mine(none, none).count() == hardneg.mine(none, some).count() == hardneg.mine(some, none).count() == 0
    same = some.withColumn("label", F.lit(1))
    assert hardneg.mine(same, same.where("vec_id = 3")).count() == 0


def test_best_lists_merge_in_any_order():
    rnd = np.random.default_rng(1)
    pairs = [(int(a), float(s), int(i)) for a, s, i in zip(rnd.integers(0, 3, 200), rnd.integers(-5, 5, 200), rnd.integers(0, 30, 200), strict=True)]
    for parts in (1, 4, 50):
        best = hardneg.Best(3, 6)
        for k in range(parts):
            mine = pairs[k::parts]
            best.add(*(np.array(c) for c in zip(*mine, strict=True)))
        at, score, ids = best.rows()
        for a in range(3):
            assert list(zip(score[at == a], ids[at == a], strict=True)) == sorted({(s, i) for b, s, i in pairs if b == a}, key=lambda x: (-x[0], x[1]))[:6]


# --- vector codes


def plain_codes(rows, parts, entries, rounds):
    rows = usable(rows, 32)
    width = 32 // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0]))[:entries]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for r in rows:
                members[nearest(cut(r[2], p), books[p])[1]].append(cut(r[2], p))
            for e, xs in members.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out, by_label = [], defaultdict(int)
    for i, label, v in rows:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((i, code, error, by_label[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("entries, rounds, block", [(12, 2, 4_096), (12, 4, 7), (64, 2, 50), (1, 2, 64), (5, 0, 64)])
def test_codes_equal_brute_force(spark, monkeypatch, entries, rounds, block):
    monkeypatch.setattr(heaplloyd, "BLOCK_ROWS", block)
    rows = vector_rows(150)
    out = heaplloyd.compress(spark.createDataFrame(rows, VECTORS).repartition(3), parts=4, entries=entries, rounds=rounds).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out) == plain_codes(rows, 4, entries, rounds)


def test_few_vectors_and_none(spark):
    assert heaplloyd.compress(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(None, [0.25] * 32, None, 1, "x", 2, 3), (4, [0.5] * 32, 1, 1, "x", 2, 3), (4, [0.5] * 32, 1, 1, "x", 2, 3)]
    out = heaplloyd.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert [(r.vec_id, r.error, r.label_error) for r in sorted(out, key=lambda r: str(r.vec_id))] == [(4, 0, 0), (4, 0, 0), (None, 0, 0)]
    assert {r.code[:2] for r in out if r.vec_id == 4} == {"00"}


def test_heaps_pop_only_what_drift_may_have_changed():
    rnd = np.random.default_rng(2)
    centres = np.floor(rnd.normal(0, 120, (64, 4)))
    x = np.concatenate([centres, np.floor(centres[rnd.integers(0, 64, 4_000)] + rnd.normal(0, 9, (4_000, 4)))])
    books = x[:64].copy()
    code, slack = heaplloyd.nearest(x, books)
    key, used = slack, np.zeros((1, 64))
    for _ in range(6):
        sums = np.array([np.floor(x[code == e].mean(0)) if (code == e).any() else books[e] for e in range(64)])
        used, books = used + heaplloyd.drift(books[None], sums[None]), sums
        before = key - used[0][code]
        code, key, popped = heaplloyd.look_again(x, code, key, books, used[0])
        assert (code == heaplloyd.nearest(x, books)[0]).all()
        assert set(popped) == set(np.nonzero(before <= heaplloyd.MARGIN)[0])
    assert len(popped) < 0.5 * len(x)


# --- page texts


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style>{head}</head><body>{body}</body></html>"


def test_tags_are_tolerated():
    tree = parse("<div>one<p>two <b>three<p>four<br>five<li>x</div>six &amp; &lt;7&gt; a < b <!-- no --><script>if (a<b) '</p>'</script> seven<hr>eight")
    texts = []

    def gather(items):
        for i in items:
            texts.append(i[1]) if i[0] == "T" else gather(i[2])

    gather(tree)
    assert texts == ["one", "two three", "four five", "x", "six & <7> a < b", "seven", "eight"]


def test_depth_and_odd_markup_lose_no_text(spark):
    deep = "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "after"
    rows = [(1, "http://a.b/1", deep), (2, "http://a.b/2", "just words & more"), (3, None, "<p>open"), (4, "http://a.b/4", "<p title='x>broken"), (5, "x", None), (6, "x", ""), (7, "x", "<![CDATA[cell]]>"), (8, "y", "<" * 50_000)]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in range(1, 8)] == ["deep\nafter", "just words & more", "open", "<p title='x>broken", "", "", "cell"]
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got.values())


LAYOUTS = {
    "semantic": lambda t, ps, k: page(f"<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='cookie-notice'>We use cookies</div><main><article class='post'><header><h1>{t}</h1><span class='share'>Share!</span></header>{''.join(f'<p>{p}</p>' for p in ps)}<form><input><button>Send</button></form><section class='comments'><article class='comment'><p>First!</p></article></section></article><aside>Other news {k}</aside></main><footer>Imprint</footer>"),
    "classes": lambda t, ps, k: page(f"<div id=menu><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><div class='sidebar'><p>Weather {k}</div><div class='post-content'><h2>{t}</h2>{''.join(f'<p>{p}' for p in ps)}<div class='ad-slot'>Buy {k}</div></div><div class='site-footer'>Bye</div>"),
    "plain": lambda t, ps, k: page(f"<div><a href=/a>Alpha section</a> <a href=/b>Beta section</a></div><div>Welcome to the place of news, read on below</div><div><h1>{t}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</div><div>All rights reserved by the people of this site</div>"),
    "tables": lambda t, ps, k: page(f"<table><tr><td><a href=/x>One</a><br><a href=/y>Two</a></td><td><h3>{t}</h3>{''.join(f'<p>{p}</p>' for p in ps)}</td></tr></table>"),
}


def test_layouts_of_hosts(spark):
    """Every host has a layout; optional notices and repeated blocks differ from page to page."""
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(99)) for _ in range(n))
    rows, want = [], {}
    for k in range(80):
        name = list(LAYOUTS)[k % 4]
        title, paragraphs = words(4), [words(rnd.randrange(12, 40)) + " &amp; more" for _ in range(rnd.randrange(1, 6))]
        rows.append((k, f"https://{name}.example/{k}", LAYOUTS[name](title, paragraphs, k), "clash"))
        want[k] = "\n".join([title, *map(html.unescape, paragraphs)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(6)
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert got == want


def test_alignment_of_optional_and_repeated_groups(spark):
    def expression(body):
        texts, tree, _ = wrappers.page_form(body)
        return wrappers.filled(tree, (wrappers.counts_of(texts, s) for s in wrappers.slots(tree)))

    shown = lambda items: " ".join(map(wrappers.form, items))
    out = wrappers.aligned(expression("<h1>a</h1><ul><li>x<li>y</ul><p>z"), expression("<h1>b</h1><div class=ad>n</div><ul><li>x</ul><p>z"), wrappers.add_counts)
    assert shown(out) == "Eh1(T) E?div.ad(T) Eul(G+(Eli(T))) Ep(T)"
    pages, *_ = [s[2] for s in wrappers.slots(out)]
    assert pages[0] == 2 and pages[3] != pages[4]
    out = wrappers.aligned(expression("<h2>a</h2><pre>b</pre><h2>a</h2><pre>b</pre>"), expression("<h2>q</h2><pre>r</pre>"), wrappers.add_counts)
    assert shown(out) == "G+(Eh2(T) Epre(T))"


def test_many_forms_of_a_host_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 3)
    rows = [(k, "http://one.example/x", page(f"<nav>m</nav>{''.join(f'<div class=c{chr(97 + j)}>n</div>' for j in range(26) if k >> (j % 6) & 1)}<article><p>text {k}</p></article>")) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.infer(df).collect()
    assert len(found) == 1 and sum(s[2][0] for s in wrappers.slots(json.loads(found[0].wrapper)) if s[2][3] != s[2][4]) == 40
    again = wrappers.infer(df.repartition(7)).collect()
    assert again == found
    assert {r.page_id: r.text for r in wrappers.extract(df).collect()} == {k: f"text {k}" for k in range(40)}


def test_pages_of_the_table(spark):
    """Every article's blocks, cut by a plain pattern."""
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op12_html_wrappers(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_of_nothing(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id string, url string, html string")).count() == 0
