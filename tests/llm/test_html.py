"""The style tree by brute force, and pages on which class names say nothing or mislead."""

import math
import random
from collections import Counter, defaultdict

from lodestone.llm import html

WORDS = "river stone under bright morning field castle window paper garden silver engine market winter letter".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {x["page_id"]: x["text"] for x in html.extract(df).collect()}


def block(cls, text):
    return f"<div class='{cls}'>{text}</div>"


def site(n, part):
    return [(i, f"http://a.example/{i}", f"<html><body>{part(i)}</body></html>") for i in range(n)]


def brute(blocks):
    """blocks: for each page a list of (class, text); the text of each page, from the definition of importance."""
    pages = [dict(b) for b in blocks]
    out = []
    for page in pages:
        kept = []
        for c, t in page.items():
            having = [p[c] for p in pages if c in p]
            m, n = len(having), sum(x == t for x in having)
            h = math.log(n) / math.log(m) if m > 1 and n > 1 else 0.0
            h = h if h >= html.LEAST_ENTROPY else 0.0
            if m < 2 or 1 - h * m / (m + html.DOUBT) >= html.IMPORTANCE:
                kept.append(t)
        out.append(" ".join(kept or page.values()))
    return out


def test_importance_equals_brute_force(spark):
    r, blocks = random.Random(8), []
    for i in range(60):
        page = [("c0", prose(i, 20))]
        for k in range(1, 9):  # from blocks that never change to blocks that always do
            if r.random() < 0.8:
                page.append((f"c{k}", prose(1000 * k + (0 if r.random() > k / 8 else r.randrange(1, 4 * k)), 6)))
        blocks.append(page)
    blocks += [blocks[0]] * 5  # repeated pages count once
    got = texts(spark, site(65, lambda i: "".join(block(c, t) for c, t in blocks[i])))
    want = brute(blocks[:60])
    assert [got[i] for i in range(60)] == want and all(got[i] == want[0] for i in range(60, 65))
    gone = Counter(c for page, text in zip(blocks[:60], want) for c, t in page if t not in text)
    assert gone["c1"] > 20 and not gone["c0"] and not gone["c8"]


def test_entropies_are_those_of_the_tree(spark):
    pages = site(40, lambda i: block("x", "the same on every page") + block("y", "one of two" if i % 2 else "two of two") + block("z", prose(i, 9)))
    df = spark.createDataFrame([("a.example", h) for _, _, h in pages], "host string, html string")
    found = defaultdict(list)
    for row in html.style_tree(df).collect():
        found[row["kind"]].append(round(row["h"], 6))
        assert row["m"] == 40
    assert sorted(found[1]) == [round(math.log(20) / math.log(40), 6)] * 2 + [1.0]
    assert len(found[0]) == 5  # html, body and the three blocks look alike everywhere


def test_importance_decides_where_class_names_say_nothing(spark):
    part = lambda i: block("q1", "Home About Products Contact") + block("q2", f"<h2>{prose(i, 4)}</h2><p>{prose(i + 500, 30)}</p><p class='k'>Text under the terms of this site</p>") + block("q3", "All rights reserved")
    got = texts(spark, site(40, part))
    assert all(got[i] == f"{prose(i, 4)} {prose(i + 500, 30)}" for i in range(40))


def test_importance_decides_where_class_names_mislead(spark):
    part = lambda i: block("article-body", "Home About Products Contact") + block("sidebar promo", f"<p>{prose(i, 30)}</p>") + block("content", "All rights reserved")
    got = texts(spark, site(40, part))
    assert all(got[i] == prose(i, 30) for i in range(40))


def test_wrappers_keep_their_article(spark):
    a = f"<article><p>{prose(1, 30)}</p></article>"
    pages = ["<div class='has-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div class='sidebar'>%s</div>", "<form>%s<input><button>go</button></form>", "<nav>menu</nav><div class='ad'>buy</div>%s<footer>foot</footer><div class='comments'><article>reader</article></div>"]
    got = texts(spark, [(i, f"http://h{i}.example/", p % a) for i, p in enumerate(pages)] + [(9, "http://h9.example/", f"<main><p>{prose(2, 30)}</p></main><article>a teaser</article>"), (10, "http://h10.example", "a<img>b")])
    assert all(got[i] == prose(1, 30) for i in range(5)) and got[9] == prose(2, 30) and got[10] == "ab"


def test_copies_keep_their_text(spark):
    """Pages that all say the same differ in a number only: what is left of them is their text, not nothing."""
    got = texts(spark, site(30, lambda i: f"<article id='n{i}'><p>{prose(1, 30)}</p></article>"))
    assert set(got.values()) == {prose(1, 30)}


def test_joined_trees_equal_broadcast_ones(spark, monkeypatch):
    pages = site(40, lambda i: block("x", "the same on every page") + block("z", prose(i, 9))) + [(99, None, None), (100, "http://b.example", "")]
    want = texts(spark, pages)
    monkeypatch.setattr(html, "BROADCAST_ROWS", 0)
    assert texts(spark, pages) == want


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.example", "<p>one</p>", "h", "t", "x", 5)], "page_id long, url string, html string, __host string, __text string, __tree string, text long")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "html", "__host", "__text", "__tree", "text"]
    assert tuple(got.first()) == (1, "http://a.example", "<p>one</p>", "h", "t", "x", "one")
