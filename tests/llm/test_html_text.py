import time

import numpy as np
import pytest

from docmill.llm import html_text

ARTICLE = "<h1>A title &amp; more</h1><p>First paragraph of the text, long enough to read.<p>Second\n one <b>bold</b> &eacute;nd<br>after.</p><ul><li>point one<li>point two</ul>"
TEXT = "A title & more\n\nFirst paragraph of the text, long enough to read.\n\nSecond one bold énd after.\n\npoint one\n\npoint two"
MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6)) + "</ul></nav>"
HEAD = '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>'


def page(body):
    return f"{HEAD}{body}</body></html>"


PAGES = {
    "plain": (page(f"{MENU}<!-- c --><div class='ad'>Buy now.</div><article>{ARTICLE}</article><footer>&copy; x</footer>"), TEXT),
    "main": (page(f"<header><h1>Site</h1></header>{MENU}<main>{ARTICLE}</main><aside><p>Other things to read, if you like.</p></aside>"), TEXT),
    "divs": (page(f"<div class='site-menu'><a href=1>Home</a> <a href=2>News</a></div><div id=content>{ARTICLE}</div><div class=sidebar><p>Most read</p></div>"), TEXT),
    "comments": (page(f"<article>{ARTICLE}</article><section id='comments'><p>I liked this text very much, thank you.</p><p>So did I.</p></section>"), TEXT),
    "notice": (page(f"<div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div><article>{ARTICLE}<form><p>Subscribe here</p><input></form></article>"), TEXT),
    "cut": (f"{HEAD}{MENU}<article>{ARTICLE}", TEXT),
    "empty": ("", ""),
    "none": (None, ""),
    "bare": (page(MENU), ""),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "u", html, 1.0, "x") for i, (html, _) in enumerate(PAGES.values())]
    plain = PAGES["plain"][0]
    rows += [(100 + i, "u", plain.replace("First", f"First {i}"), 1.0, "x") for i in range(40)]
    rows += [(200, None, plain.replace("First", "word " * 50_000), 1.0, "x")]
    rows += [(None, None, plain, 1.0, "x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text double, n_chars string")
    return html_text.extract(df).collect()


@pytest.mark.parametrize("name", PAGES)
def test_main_text(found, name):
    row = next(r for r in found if r.page_id == list(PAGES).index(name))
    assert row.text == PAGES[name][1] and row.n_chars == len(row.text)


def test_repeats_and_long_pages(found):
    assert len(found) == len(PAGES) + 43
    assert [r.text for r in found if r.page_id is None] == [TEXT] * 2
    long = next(r for r in found if r.page_id == 200)
    assert long.text.count("word") == 50_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(df).collect() == []


def test_parser_is_forgiving():
    for source in ("<p>a<p>b</div></p>c", "<a href='x>y", "<<<>>><p", "a<b>c<i>d</b>e", "<table><tr><td>1<td>2<tr><td>3", "<script>never ends"):
        parsed = html_text.parse(source)
        assert all(parsed.parents[i] < i for i in range(len(parsed.tags)))
    cells = [t for _, t, _ in html_text.parse("<table><tr><td>1<td>2<tr><td>3</table>").blocks]
    assert cells == ["1", "2", "3"]
    assert [t for _, t, _ in html_text.parse("x<p>a <b>b<br>c</p>\n&lt;tag&gt;&nbsp;y").blocks] == ["x", "a b c", "<tag> y"]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = 9
        parents = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        page = html_text.Page(["div"] * n, parents, [frozenset()] * n, [0] * n, [])
        odds = rng.standard_normal(n) * 3
        best, value = None, -np.inf
        for mask in range(1 << (n - 1)):
            kept = [True] + [bool(mask >> i & 1) for i in range(n - 1)]
            if any(kept[i] and not kept[parents[i]] for i in range(1, n)):
                continue
            total = sum(odds[i] for i in range(n) if kept[i])
            total -= html_text.SWITCH * sum(kept[parents[i]] and not kept[i] for i in range(1, n))
            if total > value:
                best, value = kept, total
        assert html_text.decode(page, odds) == best


@pytest.mark.parametrize("opened", ["<div>", "<b>", "<div><b>", "<li>", "<p><b>", "<table><td>", "<tr><td>", "<a>"])
def test_deep_nesting_takes_linear_time(opened):
    started = time.process_time()
    deep = html_text.parse(opened * 100_000 + "text")
    assert deep.blocks[-1][1] == "text"
    closed = html_text.parse((opened + "</i></section>") * 50_000 + "text")
    assert closed.blocks[-1][1] == "text"
    assert time.process_time() - started < 20


def test_kept_columns_with_the_names_of_results(spark):
    df = spark.createDataFrame([(1, "x", "<p>Some text, here.")], "page_id long, text string, html string")
    row = html_text.extract(df, keep=("page_id", "text")).collect()[0]
    assert set(row.asDict()) == {"page_id", "text", "n_chars"} and row.text != "x"
