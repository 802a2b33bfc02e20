"""Main text of pages: parser cases, alignment against brute force, wrappers of hosts, the query against its SQL."""

import random
from functools import lru_cache

import pytest
from compare import connect, same

from ledgerloom.llm import markup, wrappers
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    same(QUERIES["op11_pages"](spark, at), connect(at), ORACLE_SQL["op11_pages"])


@pytest.mark.parametrize(
    "page, texts",
    [
        ("", []),
        ("just  a\n line", ["just a line"]),
        ("<p>one<p>two<br>three", ["one", "two three"]),
        ("<p><b>bold<p>next</b> goes on", ["bold", "next goes on"]),
        ("<article><p>a &amp; b &lt;i&gt; &eacute;&nbsp;&#x41; &amp c &am</p></article>", ["a & b <i> é A & c &am"]),
        ("<article>in<!-- a <p> comment --> one</article><p>out</p>", ["in one"]),
        ("<script>var a = '</p><p>no';</script><style>p{}</style><p>yes</p>", ["yes"]),
        ("<body class='has-sidebar'><div class='sidebar'>no</div><div class='cookie-notice'>no</div><p>yes</p></body>", ["yes"]),
        ("<header>site</header><main><header><h1>Title</h1></header><p>text</p><footer>by</footer></main>", ["Title", "text"]),
        ("<article><p>text</p><section id='comments'><article class='comment'><p>no</p></article></section></article>", ["text"]),
        ("<form><article><p>held by a form</p></article></form><form>no</form>", ["held by a form"]),
        ("<ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul><ul><li>an <a href=/>item</a> of text</ul>", ["an item of text"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article>", ["a", "b", "c"]),
        ('<p title="a > b">x</p><p class="unclosed>y</p>', ["x", "y"]),
        ("<div role=navigation>no</div><DIV>Yes</DIV></p></td>", ["Yes"]),
        ("<p>a < b and 1<2</p>", ["a < b and 1<2"]),
        ("<title>no</title><textarea><p>no</textarea><p>cut <i", ["cut"]),
    ],
)
def test_blocks(page, texts):
    assert markup.blocks(page).texts == texts


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert markup.blocks(deep).texts == ["core"]
    many = "".join(f"<p>line {i}</p>" for i in range(20000))
    assert len(markup.blocks(f"<article>{many}</article>").texts) == 20000
    assert markup.blocks("<a '" * 2000 + "<p>end</p>").texts[-1:] != ["<"]


def score(a: str, b: str) -> int:
    (la, ka), (lb, kb) = markup.tree(a), markup.tree(b)

    @lru_cache(None)
    def nodes(x, y):
        if la[x].split(".")[0] != lb[y].split(".")[0]:
            return 0
        return 2 + (la[x] == lb[y]) + forest(tuple(ka[x]), tuple(kb[y]))

    @lru_cache(None)
    def forest(x, y):
        if not x or not y:
            return 0
        return max(forest(x[1:], y), forest(x, y[1:]), nodes(x[0], y[0]) + forest(x[1:], y[1:]))

    return nodes(0, 0)


def some_tree(rnd, depth=0):
    label = rnd.choice(("div", "div.a", "div.b", "p", "ul"))
    return label + "(" + "".join(some_tree(rnd, depth + 1) for _ in range(rnd.randrange(4) if depth < 3 else 0)) + ")"


def test_alignment_is_a_largest_one():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ("html(" + "".join(some_tree(rnd) for _ in range(3)) + ")" for _ in range(2))
        found, (la, ka), (lb, kb) = markup.aligned(a, b), markup.tree(a), markup.tree(b)
        assert len(set(found.values())) == len(found)
        up = lambda kids: {k: i for i, below in enumerate(kids) for k in below}
        ua, ub = up(ka), up(kb)
        for y, x in found.items():
            assert la[x].split(".")[0] == lb[y].split(".")[0] and (y == 0 or found[ub[y]] == ua[x])
        assert sum(2 + (la[x] == lb[y]) for y, x in found.items()) == score(a, b)


def plain_host(n, host="plain.example"):
    """Pages of nested division elements: site name, a line of links, a box that some lack, the text, a constant note."""
    rows = []
    for i in range(n):
        box = "<div><h3>Letters</h3>Our weekly letter</div>" if i % 3 else ""
        page = f"<div><div>The Site Name</div><div>Home and more</div></div>{box}<div><h2>Story {i}</h2><p>Text of {i}.</p><p>More on {i % 4}.</p></div><div><div>Call us any time</div></div>"
        rows.append((i, f"http://{host}/{i}", f"<html><body>{page}</body></html>"))
    return rows


def texts(spark, rows):
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    done = wrappers.main_text(df, "page_id", "url", "html")
    assert done.columns == ["page_id", "url", "text", "n_chars", "n_template"]
    return sorted(((r.page_id, r.text, r.n_template) for r in done.collect()), key=str)


def test_wrapper_tells_text_from_template(spark):
    got = texts(spark, plain_host(12))
    assert all(t == f"Story {i}\nText of {i}.\nMore on {i % 4}." for i, t, _ in got)
    assert {n for *_, n in got} == {3, 5}


def test_no_wrapper_from_few_or_equal_pages(spark):
    rows = plain_host(4) + [(100 + i, "http://copies.example/", plain_host(1)[0][2]) for i in range(30)]
    assert {n for *_, n in texts(spark, rows)} == {0}


def test_wrapper_inside_articles(spark):
    rows = [(i, "//User@News.Example:80/a", f"<article><h1>Title {i}</h1><div>Read our best stories</div><p>{'Words ' * 20}{i}</p></article>") for i in range(8)]
    near = [(50 + i, "http://near.example/", f"<article><p>{'The same long passage. ' * 9}</p><p>Page {i}</p></article>") for i in range(8)]  # near copies of each other
    got = dict((r[0], r[1:]) for r in texts(spark, rows + near))
    assert all(got[i] == (f"Title {i}\n{('Words ' * 20)}{i}", 1) for i in range(8))
    assert all(got[50 + i] == (f"{('The same long passage. ' * 9).strip()}\nPage {i}", 0) for i in range(8))


def test_odd_tables(spark):
    assert texts(spark, []) == []
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, "", "<p>a</p>"), (2, "no address", ""), (3, "http://h/", "<nav>menu</nav>")]
    assert texts(spark, rows) == sorted([(None, "", 0), (1, "a", 0), (1, "a", 0), (2, "", 0), (3, "", 0)], key=str)
