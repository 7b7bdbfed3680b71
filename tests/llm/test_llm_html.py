"""Main text of pages: the tree, exact marginals, held-out layouts, hand-written pages."""

import html as H
import itertools
import random
import re

import numpy as np
import pytest

from casegrain.llm import html_content as C
from casegrain.llm import queries
from casegrain.llm.html_layouts import Layout, Parts, own_labels
from casegrain.llm.html_tree import parse

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return C.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def runs(html):
    t = parse(html)
    return [(t.tag[t.parent[i]], x) for i, x in enumerate(t.text) if not t.tag[i]]


@pytest.mark.parametrize("html,want", [
    ("<p>a<p>b<div>c</div>d", [("p", "a"), ("p", "b"), ("div", "c"), ("html", "d")]),
    ("<p title='x > y'>a &amp b &am; &#233;&#x1F600;&nbsp;c</p>", [("p", "a & b &am; é😀 c")]),
    ("<!-- a <p>no</p> --><p>x<!-- > -->y</p><script>var t='</p><p>no';</script>", [("p", "xy")]),
    ("<style>p{a:'<p>'}</style><p>a<br>b<br/>c</p>", [("p", "a b c")]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>e", [("td", "a"), ("td", "b"), ("p", "c"), ("html", "e")]),
    ("<head><title>no</title><body><p>a", [("p", "a")]),
    ("<head><title>no</title><p>a", [("p", "a")]),
    ("</div></p>a</b>b<b>c<p>d</b>e", [("html", "abc"), ("p", "de")]),
    ("<h1>a</h2>b<h2>c<h3>d", [("h1", "a"), ("html", "b"), ("h2", "c"), ("h3", "d")]),
    ("<p>a<button>no<p>no</p></button>b</p>", [("p", "a b")]),
    ("<p>a <select><option>no</select> 3 < 4 & 5", [("p", "a 3 < 4 & 5")]),
    ("<div>a<textarea><p>no</textarea>b</div><svg><text>no</text></svg>", [("div", "a b")]),
    ("plain text\n\n of   a page", [("html", "plain text of a page")]),
    ("", []), ("<", [("html", "<")]), ("<p", []), ("<![CDATA[x]]>a", [("html", "a")]),
])
def test_tree(html, want):
    assert runs(html) == want


def test_links_are_counted_and_long_pages_stay_linear():
    t = parse("<p>ab <a href=x>cd e</a> f</p><p><a>g</p><p>h</p>")
    assert [(t.text[i], t.linked[i]) for i in range(len(t.tag)) if not t.tag[i]] == [("ab cd e f", 4), ("g", 1), ("h", 0)]
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert len(C.pages([parse(deep)]).bounds) == 20_002
    assert len(runs("<p>word " * 50_000)) == 50_000
    assert runs("<b>" * 30_000 + "x") == [("html", "x")]


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(4)
    trees = [parse(x) for x in ("<div><p>a</p><p>b c</p></div><nav><a>x</a></nav>", "<p>one</p>", "", "<ul><li>a<li>b</ul>")]
    p = C.pages(trees)
    m = C.Model(rng.normal(size=C.N_FEATURES), rng.normal(size=(2, 2, C.N_EDGE)))
    one, joint, z = C.messages(p, m)
    one, joint, x, e = one[p.back], joint[p.back], p.x[p.back], p.e[p.back]
    first = 0
    total = 0.0
    for t in trees:
        n = len(t.tag)
        score = {}
        for y in itertools.product((0, 1), repeat=n):
            s = sum(y[i] * (x[first + i] @ m.node) for i in range(n))
            s += sum(m.edge[y[t.parent[i]], y[i]] @ e[first + i] for i in range(1, n))
            score[y] = np.exp(s)
        norm = sum(score.values())
        total += np.log(norm)
        for i in range(n):
            assert one[first + i] == pytest.approx(sum(v for y, v in score.items() if y[i]) / norm)
            if i:
                for a, b in itertools.product((0, 1), repeat=2):
                    assert joint[first + i, a, b] == pytest.approx(sum(
                        v for y, v in score.items() if (y[t.parent[i]], y[i]) == (a, b)) / norm)
        first += n
    assert z == pytest.approx(total)


def test_held_out_layouts(model):
    r, parts = random.Random(5), Parts([])
    trees = [parse(Layout(r, parts).page()) for _ in range(150)]
    found = C.main_blocks(trees, model)
    right = total = 0
    for t, own in zip(trees, found):
        want = [t.text[i] for i in range(len(t.tag)) if not t.tag[i] and t.label[i]]
        every = sum(not x for x in t.tag)
        got = [b["text"] for b in own]
        wrong = len([x for x in got if x not in want]) + len([x for x in want if x not in got])
        right, total = right + every - wrong, total + every
    assert right / total > .95


S = ["The harbour was quiet on Monday, when the first boats came back from the north with their nets full.",
     "Fishermen say that the season, which began late this year, could still be a good one.",
     "Prices at the market fell by a tenth. Traders expect them to fall further before the weekend."]
PAGES = {
    "landmarks": f"""<body><header><h1>The Daily</h1><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header><main><article>
      <h1>Boats are back</h1><p>{S[0]}</p><aside><h3>Related</h3><a href=/x>More boats</a></aside><p>{S[1]}</p><p>{S[2]}</p></article>
      <section id="comments"><h2>2 comments</h2><div class="comment"><p>I saw the boats on Monday, and it was a great sight, as every year.</p></div></section></main>
      <footer><p>© 2023 The Daily. All rights reserved.</p></footer></body>""",
    "named boxes": f"""<body><div class="cookie-banner"><p>We use cookies to make this site better. Please accept them.</p><button>OK</button></div>
      <div id="header"><a href=/>Harbour Blog</a></div><div id="nav"><a href=1>One</a> <a href=2>Two</a></div>
      <div id="content"><div class="post"><h2>Boats are back</h2><div class="entry"><p>{S[0]}</p><div class="advert"><p>Cheap nets, only today!</p></div><p>{S[1]}
      <p>{S[2]}</div></div><ol class="commentlist"><li>Nice post, I liked it a lot, thank you for the photographs.</li></ol>
      <form class="reply"><p>Leave a reply</p><input></form></div><div id="sidebar"><h3>Archive</h3><ul><li><a href=a>May</a><li><a href=b>June</a></ul></div>
      <div id="footer">Copyright Harbour Blog</div></body>""",
    "plain boxes": f"""<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>About</a></div><div><h1>Boats are back</h1><p>{S[0]}</p><p>{S[1]}</p>
      <p>{S[2]}</p></div><div><a href=5>Imprint</a> <a href=6>Privacy</a></div></body>""",
    "table": f"""<table><tr><td><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Shop</a></li></ul></td><td><h1>Boats are back</h1><p>{S[0]}</p>
      <p>{S[1]}</p><p>{S[2]}</p></td></tr></table>""",
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(model, name):
    (got,) = C.main_blocks([parse(PAGES[name])], model)
    assert [b["text"] for b in got] == ["Boats are back", *S]


def test_query_finds_the_whole_article_of_every_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op13_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(x for x in blocks if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_odd_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGES["landmarks"]), (3, "u", PAGES["landmarks"]), (3, "u", PAGES["landmarks"]),
            (4, "u", "<article><p>" + S[0] * 5000 + "</p></article>"), (5, "u", "\x00<p>" + S[1])]
    df = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op13_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == 7 and {(r["page_id"], r["n_chars"]) for r in got if r["page_id"] in (1, 2)} == {(1, 0), (2, 0)}
    assert next(r for r in got if r["page_id"] == 4)["text"] == S[0] * 5000
    assert len({r["text"] for r in got if r["page_id"] in (3, None)}) == 1
    assert C.extract(df.limit(0), C.fit(df.limit(0))).count() == 0


def test_labels_of_given_pages():
    t = parse("<nav>a</nav><article><p>b</p></article>")
    assert own_labels(t) and [t.label[i] for i in range(len(t.tag)) if not t.tag[i]] == [0, 1]
    assert not own_labels(parse("<article>a</article><article>b</article>")) and not own_labels(parse("<p>a"))
