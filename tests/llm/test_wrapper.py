from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import wrapper as W

PAGES = "page_id long, url string, html string"


def blocks(page):
    tree = W.fold(W.parse(page))
    return [t for _, t in sorted((b[0], b[1]) for node in W.slots(tree) for b in node.blocks)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<p>b", ["a", "b"]),
        ("<p>a<br>b</p> c <div>d</div>", ["a b", "c", "d"]),
        ("<p> a\n\t b&amp;&eacute;&#x41;&nbsp;c </p>", ["a b&éA c"]),
        ("<p><b>a</b>b <i>c</i></p>", ["ab c"]),
        ("<p><b>a<p>b</b></p>", ["a", "b"]),
        ("<script>var x='<p>no</p>';</script><style>p{}</style><p>a", ["a"]),
        ("<!-- <p>no</p> --><p>1 < 2 <3 a</p>", ["1 < 2 <3 a"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ("<p title='a > b'>x</p><p title=\"it's\">y", ["x", "y"]),
        ("<h1>t</h1><p>a</p></div></p><p>b", ["t", "a", "b"]),
        ("text only", ["text only"]),
        ("<p>a<", ["a<"]),
        ("<![CDATA[x]]><P CLASS=q>Y</P>", ["x", "Y"]),
        ("", []),
    ],
)
def test_blocks_of_a_page(page, want):
    assert blocks(page) == want


def brute_match(a, b):
    """Largest number of nodes matched in order, by trying all ways."""
    if a.label != b.label:
        return 0

    def forests(x, y):
        if not x or not y:
            return 0
        return max(forests(x[1:], y), forests(x, y[1:]), forests(x[1:], y[1:]) + brute_match(x[0], y[0]))

    return 1 + forests(a.children, b.children)


@pytest.mark.parametrize("a,b", [("(r(a)(b(c)(d))(e))", "(r(b(d))(a)(e(c)))"), ("(r(a)(a(b))(c))", "(r(a(b)(b))(c)(a))"), ("(r)", "(q)")])
def test_tree_matching(a, b):
    a, b = W.Shape.read(a), W.Shape.read(b)
    n, pairs = W.tree_match(a, b)
    assert n == brute_match(a, b) == len(pairs)


def page(k, *, article, extra=""):
    return (
        f"<html><head><title>t{k}</title></head><body><nav><a href=/{k}>menu {k}</a></nav>"
        f"<div class='cookie-notice'>We use cookies {k}</div><div class=top>Site name</div>"
        f"<div class=main>{article}<div class=tools>Print this page</div>{extra}</div>"
        f"<div id=comments><p>nice {k}</p></div><form>Name <input></form><footer>(c) {k}</footer></body></html>"
    )


def test_constant_nodes_are_template_and_slots_are_content(spark):
    articles = [f"<h1>Head {k}</h1><p>First part of {k}, long enough to be the text.</p><p>Second {k}</p>" for k in range(6)]
    rows = [(k, f"http://User@A.Example:80/x/{k}", page(k, article=articles[k])) for k in range(5)]
    # A rare shape of the host is aligned with the frequent one.
    rows.append((5, "https://a.example/y", page(5, article=articles[5], extra="<ul><li>one<li>two</ul>")))
    got = {r["page_id"]: r for r in W.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(5):
        assert got[k]["text"] == f"Head {k}\n\nFirst part of {k}, long enough to be the text.\n\nSecond {k}"
        assert got[k]["n_chars"] == len(got[k]["text"]) and got[k]["url"] == rows[k][1]
    assert got[5]["text"].startswith("Head 5\n\nFirst part") and "Print this page" not in got[5]["text"]
    assert "one" in got[5]["text"]


def test_copies_on_one_host_keep_their_article(spark):
    html = "<body><nav>menu</nav><article><h1>T</h1><p>Same text everywhere.</p></article><footer>f</footer></body>"
    rows = [(k, "http://b.example/", html) for k in range(40)]
    got = W.extract(spark.createDataFrame(rows, PAGES).repartition(7)).collect()
    assert len(got) == 40 and {r["text"] for r in got} == {"T\n\nSame text everywhere."}


def test_article_without_side_parts(spark):
    html = (
        "<body><article><h1>T</h1><p>One <a href=x>two</a> three.</p><aside>side</aside><div class='ad'>buy</div>"
        "<div class='share-buttons'>share</div><p hidden>no</p><p>€ ünï 😀</p><section id='comments'><p>c</p></section></article></body>"
    )
    got = W.extract(spark.createDataFrame([(1, None, html)], PAGES)).collect()[0]
    assert got["text"] == "T\n\nOne two three.\n\n€ ünï 😀" and got["n_chars"] == len(got["text"])


def test_nulls_empty_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>{'word ' * 50}{k}</p>" for k in range(3000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "http://", "<"), (None, "http://c.d/", long), (4, "http://c.d/", "<nav>only menu</nav>")] * 2
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("x")).withColumn("shape", F.lit(1))
    got = W.extract(pages).collect()
    assert len(got) == 10
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[4]["text"] == "" and by[1]["n_chars"] == 0
    assert by[3]["text"] == "<"
    assert by[None]["text"].count("\n\n") == 2999
    assert W.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_a_large_wrapper_is_joined_alike(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}/", f"<article><p>text {k}</p></article>") for k in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    want = sorted(map(tuple, W.extract(pages).collect()))
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, W.extract(pages).collect())) == want


def test_copies_do_not_agree_with_each_other(spark):
    copy = "<body><nav>{k}</nav><article><h1>Title</h1><p>First part.</p><ul><li>an item</ul><p>Second part.</p></article></body>"
    other = "<body><nav>{k}</nav><article><h1>Head {k}</h1><p>Text of page {k}.</p></article></body>"
    rows = [(k, f"http://d.example/{k}", copy.format(k=k)) for k in range(40)]
    rows += [(k, f"http://d.example/{k}", other.format(k=k)) for k in range(40, 60)]
    got = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert {got[k] for k in range(40)} == {"Title\n\nFirst part.\n\nan item\n\nSecond part."}
    assert all(got[k] == f"Head {k}\n\nText of page {k}." for k in range(40, 60))


WORDY = " ".join(f"word{k}" for k in range(40))


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div class='content with-sidebar'><h1>T{k}</h1><p>{k} {t}</p></div>", "T{k}\n\n{k} {t}"),
        ("<div class='has-header'><nav>{k}</nav><article><p>{k} {t}</p></article></div>", "{k} {t}"),
        ("<form id=page><div class=comments-enabled><p>{k} {t}</p><select><option>{k}</select></div></form>", "{k} {t}"),
        ("<article><div class=no-sidebar><p>{k} {t}</p></div></article><div class=related><article>see {k}</article></div>", "{k} {t}"),
        ("<h1>T{k}</h1><p>Lead {k}</p><div><p>{k} {t} {t}</p></div><div>Site name</div><ul><li><a href=/>next {k}</a></ul>", "T{k}\n\nLead {k}\n\n{k} {t} {t}"),
        ("<article><p>{k} {t}</p></article><div>Between</div><main><p>More {k}</p></main>", "{k} {t}\n\nMore {k}"),
        ("<p>{k} one two three</p><div class=comments>c {k}</div><div hidden>{k} {t}</div><footer>{k} {t}</footer>", "{k} one two three"),
    ],
)
def test_content_is_not_cut_by_names_or_sizes(spark, html, want):
    rows = [(k, "http://e.example/", f"<body>{html.format(k=k, t=WORDY)}</body>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: want.format(k=k, t=WORDY) for k in range(5)}


@pytest.mark.parametrize("tag", ["div", "b", "font", "span", "li", "td", "p", "a", "x-y"])
def test_elements_nested_to_any_depth(tag):
    for page in (f"<{tag}>" * 30_000 + "text", f"<{tag}>" * 30_000 + "text" + f"</{tag}>" * 30_000):
        tree = W.fold(W.parse(page))
        assert [b[1] for n in W.slots(tree) for b in n.blocks] == ["text"]
        shape = W.Shape.read(tree.shape())
        assert W.tree_match(shape, W.Shape.read(tree.shape()))[0] == len(shape.nodes())
        assert W.page_mark(tree)


@pytest.mark.parametrize("page", ["<a " * 50_000, "<a '" * 50_001 + ">", "<![CDATA[" * 50_000 + ">", "<" * 50_000, "<!" * 50_000, "<!--" * 50_000])
def test_tags_left_open(page):
    start = time.monotonic()
    W.fold(W.parse(page))
    assert time.monotonic() - start < 5


def test_an_odd_page_leaves_the_others(spark):
    rows = [(i, "http://h.example/", f"<body><article><p>text {i}</p></article></body>") for i in range(5)]
    rows += [(5, "http://h.example/", "<div>" * 5_000 + "deep"), (6, "http://h.example/", "<a " * 5_000), (7, None, "<b>" * 5_000)]
    found = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == 8 and found[3] == "text 3"


def many_shapes(rng, n):
    """Pages of one host whose articles hold odd orders of elements, so that hardly two have one shape."""
    rows = []
    for k in range(n):
        parts = [f"<{t}>{t} {k} {j}</{t}>" for j, t in enumerate(rng.choice(["p", "h2", "pre", "blockquote"], int(rng.integers(3, 9))))]
        body = "".join(parts)
        if k % 3 == 0:
            html = f"<body><table><tr><td>Fixed line</td><td>{body}</td></tr></table><center>Imprint of the host</center></body>"
        else:
            html = f"<body><div class=top>Site name</div><div class=main>{body}<div class=tools>Print this page</div></div></body>"
        rows.append((k, "http://many.example/", html))
    return rows


def test_a_host_of_many_shapes_is_aligned_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = many_shapes(rng, 300)
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    want = {r["page_id"]: r["text"] for r in W.extract(pages).collect()}
    assert all(f"{k} 0" in t and "Print this page" not in t and "Imprint" not in t and "Fixed line" not in t for k, t in want.items())
    for size in (40, 7):
        monkeypatch.setattr(W, "PART_SHAPES", size)
        assert {r["page_id"]: r["text"] for r in W.extract(pages).collect()} == want


def test_templates_match_none_of_each_other(spark, monkeypatch):
    monkeypatch.setattr(W, "PART_SHAPES", 16)
    shapes = sorted({W.fold(W.parse(html)).shape() for _, _, html in many_shapes(np.random.default_rng(4), 200)})
    held = spark.createDataFrame([("h", s, 1) for s in shapes], "host string, shape string, pages long")
    found = [r["shape"] for r in W._templates(held).collect()]
    trees = [W.Shape.read(s) for s in found]
    assert len(shapes) > 100 and len(found) <= 16
    assert all(W._share(a, b)[0] < W.LEAST_MATCH for i, a in enumerate(trees) for b in trees[:i])
    got = W._aligned(held).collect()
    assert sorted(r["shape"] for r in got) == shapes
    for row in got:
        tree = W.Shape.read(row["shape"])
        best = 2.0 if row["shape"] in found else max(W._share(t, tree)[0] for t in trees)
        assert len(row["at"]) == tree.size
        if row["shape"] in found:
            assert row["cluster"] == row["shape"]
        elif best >= W.LEAST_MATCH:
            assert W._share(W.Shape.read(row["cluster"]), tree)[0] == best
